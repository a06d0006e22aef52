"""The registered queries over the engine's own operators, with the SQL that checks them."""

from __future__ import annotations

from vellumgrid.plans import agent_queries, evidence_queries, filing_queries, index_queries, ingest_queries, search_queries, text_queries

FLAGSHIP = "hybrid_rrf"
QUERIES = text_queries.QUERIES | search_queries.QUERIES | evidence_queries.QUERIES | ingest_queries.QUERIES | filing_queries.QUERIES | index_queries.QUERIES | agent_queries.QUERIES
ORACLE_SQL = text_queries.ORACLE_SQL | search_queries.ORACLE_SQL | evidence_queries.ORACLE_SQL | ingest_queries.ORACLE_SQL | filing_queries.ORACLE_SQL | index_queries.ORACLE_SQL | agent_queries.ORACLE_SQL
