"""All registered queries of the evidence engine and their SQL."""

from __future__ import annotations

from lexstrata.plans import admin_queries, oracles, outline_oracles, page_queries, queries

QUERIES = queries.QUERIES
SQL = oracles.oracle_sql() | admin_queries.oracle_sql() | outline_oracles.SQL | page_queries.oracle_sql()
