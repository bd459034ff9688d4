"""All registered queries of the library proper and their SQL."""

from __future__ import annotations

from heedstream.plans import queries_data, queries_logs, queries_returns, queries_stats, queries_streams

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (queries_returns, queries_stats, queries_data, queries_logs, queries_streams):
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
