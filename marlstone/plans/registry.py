"""The registered queries and their DuckDB twins."""

from __future__ import annotations

from marlstone.plans import answer_queries, corpus_queries, dialogue_queries, governance_queries, ingest_queries, record_queries, report_queries, retrieval_queries, tariff_queries, text_queries, title_queries

_MODULES = (retrieval_queries, text_queries, corpus_queries, answer_queries, report_queries, tariff_queries, governance_queries, record_queries, title_queries, ingest_queries, dialogue_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
