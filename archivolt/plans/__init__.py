"""Registered queries and their oracle SQL, one module for each part of the inventory."""
