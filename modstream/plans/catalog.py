"""Queries over the tables, by name, and the SQL that says the same."""

from __future__ import annotations

from modstream.plans import catalog_tables, catalog_text

QUERIES = catalog_text.QUERIES | catalog_tables.QUERIES
ORACLE_SQL = catalog_text.ORACLE_SQL | catalog_tables.ORACLE_SQL
