"""A stored inverted index of a table of texts, kept up to date by the row.

Postings (term, id, count, length of the row) lie in folders by a hash of the term, in runs sorted by term, in a ``Store``; beside them a row for each text
(id, digest, length), and in the log the number of texts and of their terms. A batch of questions reads the folders of its own terms and
nothing else. An upkeep compares digests, writes postings of new and changed texts and takes away those of changed and
removed ones, so it costs what has changed."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.scratch import folder, kept, stored
from docmill.store import Conflict, Store

from . import lexical

#: Folders of postings.
BUCKETS = 64
#: What stands in place of the folder's number in a row for a text.
TEXT = -1
#: To be raised when terms or columns are made in another way.
VERSION = 1
_TABLES = {"postings": "term string, doc_id long, tf int, dl int, bucket int", "files": "doc_id long, sha binary, dl int"}


def bucket(term: str):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def state_of(df: DataFrame) -> str:
    """A digest of the files behind a table: their paths, sizes and times."""
    leaf = df._jdf.queryExecution().optimizedPlan().collectLeaves().head()
    listed = leaf.relation().location().allFiles().mkString("\n")
    marks = sorted(re.findall(r"path=([^;]*);.*?length=(\d+);.*?modification_time=(\d+)", listed))
    return hashlib.sha256(repr(marks).encode()).hexdigest()


class TextIndex:
    """The index at ``path``; texts are rows (doc_id and the text columns)."""

    def __init__(self, spark: SparkSession, path: str, *text_cols: str):
        self.spark, self.text_cols = spark, text_cols or ("text",)
        self.store = Store(spark, path, "doc_id", "long", _TABLES, {"postings": "bucket"}, BUCKETS + 1)

    def _digest(self):
        parts = [F.coalesce(F.col(c), F.lit("")) for c in self.text_cols]
        return F.unhex(F.sha2(F.concat_ws("\0", *parts), 256))

    def apply(self, changed: DataFrame, removed: DataFrame | None = None, **note) -> None:
        """Postings of ``changed`` texts in place of those with their ids, none for the ids ``removed``; one commit."""
        with_digest = changed.select(F.col("doc_id").cast("long").alias("doc_id"), *self.text_cols, self._digest().alias("sha"))
        gone = with_digest.select("doc_id") if removed is None else with_digest.select("doc_id").unionByName(removed.select(F.col("doc_id").cast("long").alias("doc_id")))
        before = self.store.note()
        counts = F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("terms")
        lost = {"n": 0, "terms": 0}
        if before:
            gone = stored(gone.distinct(), "gone-ids")
            lost = self.store.rows("files").join(gone, "doc_id", "left_semi").agg(*counts).first()
        # Each task lays out its own postings and rows of texts in one pass: no shuffle, no sort of its own, and nothing stands on disk twice.
        flat = lexical.flat_rows(with_digest, "doc_id", *self.text_cols, more=("sha",))
        laid = flat.withColumn("bucket", F.when(F.col("term").isNull(), F.lit(TEXT)).otherwise(bucket("term")))

        def sizes(new: dict[str, DataFrame]) -> dict:
            fresh = new["files"].agg(*counts).first() if "files" in new else {"n": 0, "terms": 0}
            return {c: before.get(c, 0) - lost[c] + fresh[c] for c in ("n", "terms")}

        self.store.commit({"postings": laid}, gone if before else None, note, aside={"postings": ("files", TEXT)}, counted=sizes)
        self.store.compact_if_long()

    def refresh(self, docs: DataFrame, **note) -> None:
        """Bring the index to the state of ``docs``."""
        if not self.store.exists():
            return self.apply(docs, **note)
        scan = docs.select(F.col("doc_id").cast("long").alias("doc_id"), self._digest().alias("now"))
        both = self.store.rows("files").select("doc_id", "sha").join(scan, "doc_id", "full_outer")
        states = stored(both.filter(~F.col("sha").eqNullSafe(F.col("now"))).select("doc_id", F.col("now").isNull().alias("removed")), "text-states")
        changed = docs.join(states.filter("NOT removed").select("doc_id"), "doc_id", "left_semi")
        return self.apply(changed, states.filter("removed").select("doc_id"), **note)

    def postings(self, terms: DataFrame) -> DataFrame:
        """doc_id, term, tf, dl of the given terms (term), from their folders only."""
        wanted = terms.select("term").distinct()
        size = wanted.agg(F.count(F.lit(1)).alias("n"), F.collect_set(bucket("term")).alias("at")).first()
        wanted = F.broadcast(wanted) if size["n"] <= lexical.BROADCAST_TERMS else wanted
        return self.store.rows("postings", F.col("bucket").isin(size["at"])).join(wanted, "term", "left_semi").select("doc_id", "term", "tf", "dl")

    def bm25(self, queries: DataFrame, **constants) -> DataFrame:
        """qid, doc_id, score of a batch of questions (qid, question)."""
        wanted = stored(lexical.query_terms(queries), "query-terms")
        note = self.store.note()
        return lexical.scores(wanted, self.postings(wanted), "doc_id", note["n"], note["terms"] / note["n"] if note["terms"] else 1.0, **constants)

    def top_k(self, queries: DataFrame, k: int, **constants) -> DataFrame:
        """qid, doc_id, score, rank of the ``k`` best texts for each question; what is written grows with postings and questions, not with their pairs."""
        wanted = stored(lexical.query_terms(queries), "query-terms")
        note = self.store.note()
        return lexical.best(wanted, self.postings(wanted), "doc_id", k, note["n"], note["terms"] / note["n"] if note["terms"] else 1.0, **constants)


def opened(spark: SparkSession, name: str, raw: DataFrame, docs: DataFrame, *text_cols: str) -> TextIndex:
    """The index of a table, made when it is first asked for and brought up to date when the files of ``raw`` have
    changed. ``docs`` has the rows (doc_id and text columns) that are made of ``raw``."""
    place = hashlib.sha256(name.encode()).hexdigest()[:24]
    index = TextIndex(spark, kept(spark, f"text-index-{VERSION}/{place}"), *text_cols)
    state = state_of(raw)
    if index.store.note().get("state") != state:
        try:
            index.refresh(docs, state=state)
        except Conflict:
            if index.store.note().get("state") != state:
                raise
    return index


def temporary(spark: SparkSession, *text_cols: str) -> TextIndex:
    """An index of its own in a new folder."""
    return TextIndex(spark, folder(spark, "text-index"), *text_cols)
