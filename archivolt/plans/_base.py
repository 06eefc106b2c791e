"""Collecting queries and oracles of a module by function name."""

from __future__ import annotations


def collector():
    queries, oracles = {}, {}

    def query(oracle: str | None = None):
        def add(function):
            queries[function.__name__] = function
            if oracle:
                oracles[function.__name__] = oracle
            return function

        return add

    return queries, oracles, query
