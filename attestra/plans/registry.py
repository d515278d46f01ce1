"""Every published query, and the SQL that gives the same rows."""

from __future__ import annotations

from . import answer_queries, appeal_queries, case_queries, citation_queries, corrective_queries, daily_queries, document_queries, draft_queries, graph_queries, relational_queries, research_queries, retrieval_queries, stream_queries, text_queries

FLAGSHIP = "bm25_topk"
MODULES = [retrieval_queries, graph_queries, appeal_queries, citation_queries, corrective_queries, daily_queries, document_queries, relational_queries, case_queries, stream_queries, research_queries, text_queries, draft_queries, answer_queries]
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
