"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: documents as fixed windows of words, for the SQL twins.
CHUNKS = r"""
ck_w AS (SELECT doc_id AS file_id, source, regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS ws FROM documents),
ck_n AS (SELECT file_id, source, ws, len(ws) AS n FROM ck_w),
ck_o AS (SELECT file_id, source, ws, n, unnest(range(0, CAST(greatest(0, ceil((n - 220) / 190.0)) AS BIGINT) + 1)) AS ord FROM ck_n),
chunks AS (SELECT file_id, source, CAST(ord AS INTEGER) AS ord, array_to_string(ws[ord * 190 + 1 : ord * 190 + 220], ' ') AS text FROM ck_o)
"""

FILES = """
files AS (SELECT doc_id AS file_id, source || '/' || doc_id AS path, sha256(text) AS sha256, n_chars AS bytes FROM documents)
"""


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under ``name``, with SQL that gives the same rows where there is some."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add
