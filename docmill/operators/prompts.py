"""Texts that are put together from hits and file notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEGATIVES, CAP = 5, 200


def context_block(hits: DataFrame, path: str) -> DataFrame:
    """qid, context: numbered passages of each query, in rank order."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.col(path), F.lit(" p."), F.col("page").cast("string"), F.lit(")\n"), F.col("text"))
    one = hits.select("qid", "rank", head.alias("block"))
    return one.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"))


def wrapped(question: Column, prefix: Column, suffix: Column, negatives: Column) -> Column:
    """Prefix, question, suffix and what to avoid, blank lines between the parts that aren't empty."""
    cut = lambda c: F.nullif(F.substring(F.trim(c), 1, CAP), F.lit(""))
    few = F.slice(F.array_distinct(negatives), 1, NEGATIVES)
    avoid = F.when(F.size(few) > 0, F.concat(F.lit("Avoid: "), F.array_join(few, ", ")))
    return F.concat_ws("\n\n", cut(prefix), question, cut(suffix), avoid)


def in_scope(scope: Column, question: Column, topics: Column, rank: Column) -> Column:
    """Whether a file's notes apply: always, for its topics, or when the file is the first hit."""
    named = F.exists(topics, lambda t: F.contains(F.lower(question), F.lower(t)))
    return F.when(scope == "global", True).when(scope == "file-only", rank == 1).otherwise(named)


#: Topics and entities of a file that a brief names.
TOPICS, KNOWN = 5, 12


def brief(meta: DataFrame) -> DataFrame:
    """qid, brief: a paragraph for each file of a question's hits, at its best rank, whose scope applies and of which anything is known.
    meta: qid, rank, path, question, scope, title, description, topics, entities; a question has few hits."""
    once = meta.groupBy("qid", "path").agg(F.min_by(F.struct(*[c for c in meta.columns if c not in ("qid", "path")]), "rank").alias("m")).select("qid", "path", "m.*")
    known = (F.coalesce("title", F.lit("")) != "") | (F.size("topics") > 0) | (F.size("entities") > 0)
    fits = once.filter(in_scope(F.col("scope"), F.col("question"), F.col("topics"), F.col("rank")) & known)
    name = F.regexp_extract("path", "[^/]*$", 0)
    line = lambda before, text: F.when(text != "", F.concat(F.lit(before), text))
    topics = F.array_join(F.slice("topics", 1, TOPICS), ", ")
    entities = F.array_join(F.slice("entities", 1, KNOWN), ", ")
    parts = F.array(
        F.concat(F.lit("• "), name, F.lit(" — "), F.coalesce(F.nullif("title", F.lit("")), name), F.lit(".")), line("  ", F.coalesce("description", F.lit(""))),
        F.when(topics != "", F.concat(F.lit("  Topics: "), topics, F.lit("."))), F.when(entities != "", F.concat(F.lit("  Known entities: "), entities, F.lit("."))),
    )
    rows = fits.select("qid", F.struct("rank", F.array_join(F.array_compact(parts), "\n").alias("text")).alias("r"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["text"]), "\n\n").alias("brief"))
