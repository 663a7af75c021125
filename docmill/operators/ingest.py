"""Incremental ingest: what changed between a stored listing and a scan, and how to apply it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(stored: DataFrame, scan: DataFrame, versions: tuple[str, ...] = (), force: bool = False) -> DataFrame:
    """path, state (new, changed, unchanged, removed), digests of both sides. ``versions`` are further columns whose change
    counts as a change of the file; with ``force`` every known file that is still there counts as changed."""
    s = stored.select("path", F.col("sha256").alias("old_sha"), *[F.col(v).alias(f"old_{v}") for v in versions], F.lit(True).alias("was"))
    n = scan.select("path", F.col("sha256").alias("new_sha"), *versions, F.lit(True).alias("is_"))
    both = s.join(n, "path", "full_outer")
    same = F.col("old_sha").eqNullSafe(F.col("new_sha"))
    for v in versions:
        same = same & F.col(f"old_{v}").eqNullSafe(F.col(v))
    same = same & F.lit(not force)
    state = F.when(F.col("was").isNull(), "new").when(F.col("is_").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return both.select("path", state.alias("state"), "old_sha", "new_sha")


def upsert(stored: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """Rows of ``changed`` in place of those with the same key."""
    return stored.join(changed.select(key), key, "left_anti").unionByName(changed)


def cascade(stored: DataFrame, states: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """Rows that hang on files (chunks, postings) after an ingest: those of unchanged files stay, those of changed and removed ones go,
    and ``fresh`` has those of new and changed ones."""
    stays = states.filter("state = 'unchanged'").select(key)
    comes = states.filter("state IN ('new', 'changed')").select(key)
    return stored.join(stays, key, "left_semi").unionByName(fresh.join(comes, key, "left_semi"))
