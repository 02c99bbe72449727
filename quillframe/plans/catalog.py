"""Registered queries and the SQL that each is held against."""

from __future__ import annotations

from . import business, cleaning, documents, processing, records, scalars

FLAGSHIP = "sha256_dedup_keep_first"

QUERIES = documents.QUERIES | business.QUERIES | processing.QUERIES | cleaning.QUERIES | records.QUERIES | scalars.QUERIES

ORACLE_SQL = documents.ORACLE_SQL | business.ORACLE_SQL | processing.ORACLE_SQL | cleaning.ORACLE_SQL | records.ORACLE_SQL | scalars.ORACLE_SQL
