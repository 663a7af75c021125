"""Metadata beside files: TOML that people edit, read tolerantly, and merged for the files of a question's hits."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prompts import in_scope

SCOPES = ("global", "topic-aware", "file-only")
#: Characters of merged texts and number of merged negatives.
LONGEST, MOST = 200, 5


def quoted(v: Column) -> Column:
    """A string of TOML: literal, or with escapes where it holds a single quote."""
    escaped = F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(F.contains(v, F.lit("'")), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), v, F.lit("'")))


def rendered(title: Column, scope: Column, topics: Column) -> Column:
    """The text of a sidecar."""
    listed = F.array_join(F.transform(topics, quoted), ", ")
    return F.concat(F.lit("# Edit freely; it is read at every question.\ntitle = "), quoted(title), F.lit("\nscope = "), quoted(scope), F.lit("\ntopics = ["), listed, F.lit("]\n"))


def read(files: DataFrame, key: str, text_col: str) -> DataFrame:
    """key, title, scope, topics, broken: fields of wrong kinds and unknown scopes take their defaults, as does a file that isn't TOML."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[text_col], strict=True):
                try:
                    found, broken = tomllib.loads(text or ""), False
                except tomllib.TOMLDecodeError:
                    found, broken = {}, True
                topics = found.get("topics")
                title, scope = found.get("title"), found.get("scope")
                rows.append((k, title if isinstance(title, str) else "", scope if scope in SCOPES else "topic-aware", [str(t) for t in topics] if isinstance(topics, list) else [], broken))
            yield pd.DataFrame(rows, columns=[key, "title", "scope", "topics", "broken"])

    kind = dict(files.dtypes)[key]
    return files.select(key, text_col).mapInPandas(run, f"{key} {kind}, title string, scope string, topics array<string>, broken boolean")


def merged(meta: DataFrame, prefix: str, suffix: str, negatives: list[str]) -> DataFrame:
    """qid, prefix, suffix, negatives: a workspace's modifiers and those of the files of a question's hits, each file once at its best
    rank, by scope. meta: qid, rank, path, question, scope, topics, prefix, suffix, negatives; a question has few hits.

    Texts that are already part of what was merged aren't added; negatives count without regard to case."""
    once = meta.groupBy("qid", "path").agg(F.min_by(F.struct("rank", "question", "scope", "topics", "prefix", "suffix", "negatives"), "rank").alias("m")).select("qid", "m.*")
    fits = once.filter(in_scope(F.col("scope"), F.col("question"), F.col("topics"), F.col("rank")))

    def added(have: Column, more: Column) -> Column:
        return F.when((F.coalesce(more, F.lit("")) == "") | F.contains(have, more), have).otherwise(F.trim(F.concat(have, F.lit(" "), more)))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.filter(F.transform(x["negatives"], lambda n: F.trim(n)), lambda n: (n != "") & ~F.exists(acc["negatives"], lambda o: F.lower(o) == F.lower(n)))
        return F.struct(added(acc["prefix"], x["prefix"]).alias("prefix"), added(acc["suffix"], x["suffix"]).alias("suffix"), F.concat(acc["negatives"], _first_forms(fresh)).alias("negatives"))

    start = F.struct(F.lit(prefix).alias("prefix"), F.lit(suffix).alias("suffix"), F.array(*map(F.lit, negatives)).cast("array<string>").alias("negatives"))
    folded = fits.groupBy("qid").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("rank", "prefix", "suffix", "negatives"))), start, step).alias("m"))
    return folded.select("qid", F.substring("m.prefix", 1, LONGEST).alias("prefix"), F.substring("m.suffix", 1, LONGEST).alias("suffix"), F.slice("m.negatives", 1, MOST).alias("negatives"))


def applied(question: Column, prefix: Column, suffix: Column, negatives: Column) -> Column:
    """The text that is embedded for a question: prefix, question, suffix with blanks between, then what to avoid."""
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    avoid = F.when(F.size(negatives) > 0, F.concat(F.lit("  Avoid: "), F.array_join(negatives, ", "))).otherwise("")
    return F.concat(F.concat_ws(" ", some(prefix), some(question), some(suffix)), avoid)


def modified(batch: DataFrame, meta: DataFrame, prefix: str, suffix: str, negatives: list[str]) -> DataFrame:
    """qid, question, searched: every question of a batch (qid, question) with the workspace's modifiers and those of its hits' files (``meta`` as in
    ``merged``); one without hits, or without files that apply, has the workspace's alone."""
    own = F.array(*map(F.lit, negatives[:MOST])).cast("array<string>")
    m = batch.select("qid", "question").join(merged(meta, prefix, suffix, negatives), "qid", "left")
    return m.select("qid", "question", applied(F.col("question"), F.coalesce("prefix", F.lit(prefix[:LONGEST])), F.coalesce("suffix", F.lit(suffix[:LONGEST])), F.coalesce("negatives", own)).alias("searched"))


def _first_forms(words: Column) -> Column:
    """Each word once without regard to case, in its first form."""
    low = F.transform(words, lambda n: F.lower(n))
    return F.transform(F.filter(F.transform(F.arrays_zip(words.alias("w"), low.alias("l")), lambda x, i: F.struct(x["w"].alias("w"), (F.array_position(low, x["l"]) == i + 1).alias("first"))), lambda x: x["first"]), lambda x: x["w"])
