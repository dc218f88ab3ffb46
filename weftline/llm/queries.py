"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from weftline.llm import queries_decontaminate, queries_hnsw, queries_jaccard, queries_langid, queries_merkle, queries_mixing, queries_quality, queries_runs, queries_secrets, queries_tokens, queries_warc

_PARTS = [queries_decontaminate, queries_hnsw, queries_jaccard, queries_langid, queries_merkle, queries_mixing, queries_quality, queries_runs, queries_secrets, queries_tokens, queries_warc]

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
