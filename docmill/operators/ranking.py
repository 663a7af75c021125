"""Rank lists: fusion, diversification, reranking, attention order, relevance diversification by vectors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.scratch import stored

from .lexical import terms
from .models import PairScorer, reranked

RRF = 60
#: Hits up to which they are broadcast (some 50 MB).
BROADCAST_HITS = 500_000


def with_rows(hits: DataFrame, rows: DataFrame, *on: str) -> DataFrame:
    """hits with the columns of their rows. A batch has few hits, which go to the rows, so no whole texts are shuffled for them."""
    held = stored(hits, "hits")
    return (F.broadcast(held) if held.count() <= BROADCAST_HITS else held).join(rows, list(on))


def rrf(lists: list[DataFrame], key: str, k: int = RRF) -> DataFrame:
    """qid, key, rrf: reciprocal ranks summed over lists of (qid, key, rank)."""
    all_ = reduce(DataFrame.unionByName, [x.select("qid", key, "rank") for x in lists])
    return all_.groupBy("qid", key).agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("rrf"))


def top(scored: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """The k best rows of each query with their rank; scores equal to twelve places are ties, which go by key."""
    order = Window.partitionBy("qid").orderBy(F.round(score, 12).desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse(vec: DataFrame, fts: DataFrame, key: str, k: int, constant: int = RRF) -> DataFrame:
    """Two ranked lists (qid, key, rank, score) as one: rank, rrf, both ranks, score and kind of the hit.

    The score is the better one of both, 0 for a list that lacks the hit; the kind goes by which scores are positive (to nine places). Ties keep
    the order of insertion: hits of the vector list first, then those of the text list alone."""
    v = vec.select("qid", key, F.col("rank").alias("vec_rank"), F.col("score").alias("vec_score"))
    f = fts.select("qid", key, F.col("rank").alias("fts_rank"), F.col("score").alias("fts_score"))
    both = v.join(f, ["qid", key], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (constant + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf", part("vec_rank") + part("fts_rank"))
    order = Window.partitionBy("qid").orderBy(F.round("rrf", 12).desc(), F.col("vec_rank").isNull(), F.coalesce("vec_rank", "fts_rank"))
    by_vec, by_fts = (F.coalesce(F.round(c, 9), F.lit(0.0)) for c in ("vec_score", "fts_score"))
    kind = F.when((by_vec > 0) & (by_fts > 0), "hybrid").when(by_vec > 0, "vec").otherwise("fts")
    score = F.greatest(F.coalesce("vec_score", F.lit(0.0)), F.coalesce("fts_score", F.lit(0.0)))
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("kind", kind).withColumn("score", score)


def diversify(hits: DataFrame, path: str, cap: int, k: int) -> DataFrame:
    """At most ``cap`` hits of each path in rank order, then the others in rank order, up to ``k``; 0 switches it off."""
    if cap <= 0:
        return hits
    seen = F.row_number().over(Window.partitionBy("qid", path).orderBy("rank"))
    order = Window.partitionBy("qid").orderBy(F.col("__n") > cap, "rank")
    return hits.withColumn("__n", seen).withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= k).drop("__n")


def attention_order(hits: DataFrame) -> DataFrame:
    """position: best hits at both ends, the weakest in the middle; two hits or fewer keep their order."""
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    i = F.col("rank") - 1
    place = F.when(n <= 2, i).when(i % 2 == 0, F.floor(i / 2)).otherwise(n - 1 - F.floor((i - 1) / 2))
    return hits.withColumn("position", place.cast("long"))


def rerank(hits: DataFrame, queries: DataFrame, text: str, k: int, factory: Callable[[], PairScorer] | None = None) -> DataFrame:
    """new_rank and overlap by the scores of a model of pairs, or by its stand-in: the share of the question's distinct terms that the text
    holds. A question for which the model fails keeps its order."""
    if factory is not None:
        return reranked(hits, queries, text, factory, k).withColumnRenamed("pair_score", "overlap")
    q = queries.select("qid", F.array_distinct(terms(F.col("question"))).alias("asked"))
    scored = hits.join(q, "qid").withColumn("overlap", F.size(F.array_intersect("asked", terms(F.col(text)))) / F.greatest(F.lit(1), F.size("asked")))
    order = Window.partitionBy("qid").orderBy(F.desc("overlap"), "rank")
    return scored.drop("asked").withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= k)


def mmr(hits: DataFrame, key: str, vec: str, k: int, balance: float) -> DataFrame:
    """qid, key, new_rank: greedy maximal marginal relevance. Sequential by nature; a group is one query's few candidates."""
    schema = f"qid {dict(hits.dtypes)['qid']}, {key} {dict(hits.dtypes)[key]}, new_rank int"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        rel = pdf["score"].to_numpy(float)
        m = np.stack(pdf[vec].to_numpy()).astype(float)
        m /= np.linalg.norm(m, axis=1, keepdims=True) + 1e-12
        left, out = list(range(len(pdf))), []
        if len(pdf) <= k:
            out = left
        else:
            near = np.full(len(pdf), -np.inf)
            while left and len(out) < k:
                gain = [balance * rel[i] - (1 - balance) * near[i] if out else rel[i] for i in left]
                best = left.pop(int(np.argmax(np.round(gain, 9))))  # equal to nine places is a tie, which goes by rank
                out.append(best)
                near = np.maximum(near, m @ m[best])
        return pd.DataFrame({"qid": pdf["qid"].iloc[out].to_numpy(), key: pdf[key].iloc[out].to_numpy(), "new_rank": range(1, len(out) + 1)})

    return hits.groupBy("qid").applyInPandas(pick, schema)
