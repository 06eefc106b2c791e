"""All queries of the library, by name, with their oracle SQL."""

from __future__ import annotations

from archivolt.plans import aggregates, catalogue, ingest, joins, places, records, reports, samples, scalars, searches, sets, states, videos, visual, windows

MODULES = (aggregates, catalogue, ingest, joins, places, records, reports, samples, scalars, searches, sets, states, videos, visual, windows)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
