"""The registry of queries, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LEDGER = """
led AS (
  SELECT printf('P-%06d', user_id) AS project_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq,
         strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS occurred_at, upper(event_type) AS event_type,
         printf('E-%06d', event_id) AS object_id, replace(props, ' ', '') AS details, event_id, user_id FROM events
)"""
FILES = """
fil AS (
  SELECT printf('FILE-%06d', doc_id) AS file_id, source AS case_id, source || '/' || doc_id AS logical_path, sha256(text) AS content_digest,
         octet_length(encode(text)) AS size_bytes, lang, doc_id FROM documents
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
