"""Operator 2, exact dedup by a heavy-hitter split, DataFrame functions only.

1. Every text is normalised and digested once; the narrow digest table goes to the shared folder.
2. A frequent-items sketch of the Misra-Gries family (``approx_top_k``: mergeable counters, one bounded state per task)
   names at most ``TRACKED`` candidate digests; every digest that holds more than about ``4 / TRACKED`` of the rows is
   among them.
3. The candidates are verified by exact counting. Winners (at most ``HEAVY_MAX`` rows of fixed width) are broadcast and
   decide their rows on the map side, so a group with a third of all rows is never shuffled.
4. All other digests go through an ordinary shuffle: groups are counted and decided by partial aggregation, and their rows find
   the result by an equi-join, which Spark can split; a group of up to a thousandth of all rows isn't gathered in a task.

Defined cases: a null or empty text has the digest of the empty string, so all of them are one group; ties on length go
to the smallest id (a null id sorts first, as the smallest), and of rows that are equal in both exactly one stays; rows of one id with
different texts are judged each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WS_CLASS, documents, keep_rows, stash, text_of

#: Counters of the sketch, and the most winners that are broadcast (32-byte digest, id, count: under 100 KB).
TRACKED, HEAVY_MAX = 16384, 1000
#: A candidate with fewer rows isn't worth a broadcast.
HEAVY_MIN = 16


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(F.regexp_replace(text, f"[{WS_CLASS}]+", ""), "UTF-8"), 256))


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: its number, id, SHA-256 of the normalised text (binary), code points of the original text."""
    text = text_of(text_col)
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), _digest(text).alias("digest"), F.char_length(text).cast("long").alias("n_cp"))


def _best():
    return F.min(F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id"), F.col("row")))


def heavy_winners(table: DataFrame) -> DataFrame:
    """Verified winners of the frequent digests: digest, keep_id, keep_row, group_size; at most HEAVY_MAX rows."""
    sketch = table.agg(F.expr(f"approx_top_k(xxhash64(digest), {HEAVY_MAX}, {TRACKED})").alias("top"))
    candidates = sketch.select(F.explode("top").alias("t")).select(F.col("t.item").alias("h")).limit(HEAVY_MAX)
    found = table.withColumn("h", F.xxhash64("digest")).join(F.broadcast(candidates), "h", "left_semi")
    exact = found.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), _best().alias("best"))
    top = exact.filter(F.col("group_size") >= HEAVY_MIN).orderBy(F.desc("group_size"), "digest").limit(HEAVY_MAX)
    return top.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, digest, keep_id, keep_row, group_size of every row."""
    table = stash(digest_table(docs, id_col, text_col), "digests")
    winners = stash(heavy_winners(table), "digest-winners")
    hot = table.join(F.broadcast(winners), "digest").select("row", "doc_id", "digest", "keep_id", "keep_row", "group_size")
    rest = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    each = rest.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), _best().alias("best"))
    cold = rest.join(each.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "digest")
    return hot.unionByName(cold.select("row", "doc_id", "digest", "keep_id", "keep_row", "group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``. See the module for the cases."""
    return _judged(docs, id_col, text_col).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; its columns are unchanged."""
    judged = _judged(docs, id_col, text_col).select(F.col("doc_id").alias("id"), F.col("digest").alias("key"), (F.col("row") == F.col("keep_row")).alias("kept"))
    rows = stash(judged, "exact-judged")
    return keep_rows(docs, id_col, rows.select("id"), rows.filter("kept").select("id", "key"), _digest(text_of(text_col)))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP2_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), h AS (SELECT doc_id, n_cp, sha256(norm) AS text_sha256 FROM n)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) = 1 AS kept,
       text_sha256
FROM h
"""
