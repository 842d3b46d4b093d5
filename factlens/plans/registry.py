"""All registered queries of the core and their SQL."""

from __future__ import annotations

from factlens.plans import core_queries, fact_queries, snapshot_queries, table_queries

QUERIES = {**core_queries.QUERIES, **snapshot_queries.QUERIES, **fact_queries.QUERIES, **table_queries.QUERIES}
ORACLE = {**core_queries.ORACLE, **snapshot_queries.ORACLE, **fact_queries.ORACLE, **table_queries.ORACLE}
