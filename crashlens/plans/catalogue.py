"""All queries of the reference's operators, with their SQL."""

from __future__ import annotations

from crashlens.plans import event_queries, graph_queries, log_queries, lookup_queries, report_queries, stream_queries, summary_queries, text_queries
from crashlens.plans.base import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _module in (event_queries, graph_queries, log_queries, lookup_queries, text_queries, report_queries, stream_queries, summary_queries):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
