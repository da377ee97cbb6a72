"""Queries that run a stream to its end; SQL gives the same rows from the table."""

from __future__ import annotations

from crashlens.plans.base import Query
from crashlens.streaming import watch

QUERIES: dict[str, Query] = {"latest_status_stream": watch.latest_status, "watch_resumed": watch.resumed, "stop_on_match_stream": watch.stop_on_match}
ORACLES: dict[str, str] = {
    "latest_status_stream": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(ts) AS latest FROM events GROUP BY 1",
    "watch_resumed": "SELECT event_type || '|' || json_extract_string(props, '$.k') AS state, count(*) AS n, (SELECT count(*) FROM events) AS rows, (SELECT min(ts) FROM events) AS first, (SELECT max(ts) FROM events) AS latest FROM events GROUP BY 1 ORDER BY n DESC, state LIMIT 5",
    "stop_on_match_stream": "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND value > 9 ORDER BY 1 LIMIT 1",
}
