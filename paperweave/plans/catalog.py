"""All queries by name, and their SQL."""

from __future__ import annotations

from paperweave.plans import batch_queries, benchmark_queries, decision_queries, detail_queries, document_queries, identity_queries, label_queries, policy_queries, record_queries, review_queries, source_queries, text_queries, verdict_queries

QUERIES = document_queries.QUERIES | verdict_queries.QUERIES | text_queries.QUERIES | record_queries.QUERIES | decision_queries.QUERIES | identity_queries.QUERIES | policy_queries.QUERIES | batch_queries.QUERIES | review_queries.QUERIES | label_queries.QUERIES | source_queries.QUERIES | benchmark_queries.QUERIES | detail_queries.QUERIES
SQL = document_queries.SQL | verdict_queries.SQL | text_queries.SQL | record_queries.SQL | decision_queries.SQL | identity_queries.SQL | policy_queries.SQL | batch_queries.SQL | review_queries.SQL | label_queries.SQL | source_queries.SQL | benchmark_queries.SQL | detail_queries.SQL
