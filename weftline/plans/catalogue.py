"""All registered queries over the reference's operators, with their SQL."""

from __future__ import annotations

from weftline.plans import chat_queries, corpus_queries, event_queries, likelihood_queries, metric_queries, stream_queries

_PARTS = [corpus_queries, chat_queries, metric_queries, event_queries, likelihood_queries, stream_queries]

QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL: dict = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
