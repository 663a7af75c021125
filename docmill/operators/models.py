"""Models as operators: texts to texts, texts to vectors, pairs to scores. A model is built once in each worker by a factory; batches
come by Arrow. What a model can't answer is empty (texts), missing (scores): a bad row never ends the job."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that are embedded at once.
EMBEDDED = 256


class TextModel(Protocol):
    def complete(self, prompt: str, max_tokens: int) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def completed(prompt: Column, factory: Callable[[], TextModel], max_tokens: int = 256, per_second: float | None = None) -> Column:
    """The model's reply to each prompt, "" where it fails. ``per_second`` limits the calls of one worker."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, last = factory(), 0.0
        for batch in batches:
            out = []
            for text in batch:
                if per_second:
                    time.sleep(max(0.0, last + 1 / per_second - time.monotonic()))
                    last = time.monotonic()
                try:
                    out.append(model.complete(text, max_tokens) or "" if text is not None else "")
                except Exception:  # the contract of a model call: no reply is an empty reply
                    out.append("")
            yield pd.Series(out, dtype=object)

    return run(prompt)


@lru_cache(1 << 16)
def _number(word: str) -> int:
    """The number of a word; those of frequent words are kept, as texts repeat them."""
    return int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:4], "big")


class Hashed:
    """The default embedder: words are dealt to ``width`` places by a digest, with a sign; vectors have length 1, without words 0."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts, strict=True):
            places = [_number(word) % (2 * self.width) for word in re.findall(r"[a-z0-9]+", text.lower())]
            if places:  # places of words that count, then of those that count against
                of = np.bincount(places, minlength=2 * self.width)
                row[:] = of[: self.width] - of[self.width :]
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)


def embedded(text: Column, factory: Callable[[], Embedder] = Hashed) -> Column:
    """The vector of each text; a missing text counts as an empty one. A model sees EMBEDDED texts at once, and only these are copied out of their Arrow
    batch, so what a worker holds doesn't grow with the size of batches."""

    def vectors(model: Embedder, texts: pa.Array) -> pa.Array:
        found = np.asarray(model.embed([t or "" for t in texts.to_pylist()]), float)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for batch in batches:
            some = [vectors(model, batch.slice(at, EMBEDDED)) for at in range(0, len(batch), EMBEDDED)]
            yield pa.concat_arrays(some) if some else pa.array([], pa.list_(pa.float64()))

    return run(text)


def pair_scores(question: Column, text: Column, factory: Callable[[], PairScorer]) -> Column:
    """A score for each pair; missing for all pairs of a question for which the model fails."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for a, b in batches:
            out = pd.Series([None] * len(a), dtype=float)
            for _, rows in pd.DataFrame({"q": a, "t": b}).reset_index(drop=True).groupby("q", sort=False, dropna=False):
                try:
                    out[rows.index] = model.score(list(zip(rows["q"], rows["t"], strict=True)))
                except Exception:  # the caller keeps its own order for pairs without a score
                    continue
            yield out

    return run(question, text)


def reranked(hits: DataFrame, batch: DataFrame, text: str, factory: Callable[[], PairScorer], k: int) -> DataFrame:
    """hits in the order of the model's scores; a question for which the model failed keeps its order."""
    from pyspark.sql import Window

    scored = hits.join(batch.select("qid", "question"), "qid").withColumn("pair_score", pair_scores(F.col("question"), F.col(text), factory)).drop("question")
    whole = Window.partitionBy("qid")
    usable = F.count("pair_score").over(whole) == F.count(F.lit(1)).over(whole)
    order = whole.orderBy(F.when(F.col("usable"), F.round("pair_score", 9)).desc_nulls_last(), "rank")
    return scored.withColumn("usable", usable).withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= k).drop("usable")


def backend(wanted: Column, running: list[tuple[str, Column]]) -> Column:
    """The first provider in order that runs and is wanted by name or by ``auto``; ``none`` where there isn't any."""
    out = F.lit("none")
    for name, alive in reversed(running):
        out = F.when(wanted.isin("auto", name) & alive, name).otherwise(out)
    return out


def centroid(vectors: DataFrame, by: str, vec_col: str) -> DataFrame:
    """by, n, center: the mean vector of each group, from partial sums by place."""
    each = vectors.select(by, F.posexplode(vec_col).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    return each.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("center"))
