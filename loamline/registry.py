"""All registered queries with their DuckDB equivalents."""

from __future__ import annotations

from .plans import graphs, inherited, keys, tables, values

QUERIES: dict = {**tables.QUERIES, **values.QUERIES, **keys.QUERIES, **inherited.QUERIES, **graphs.QUERIES}
ORACLES: dict = {**tables.ORACLES, **values.ORACLES, **keys.ORACLES, **inherited.ORACLES, **graphs.ORACLES}
