"""Vectors: cosine, normalisation, padding, nearest vectors of a query set."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12
#: Queries that are multiplied with a batch of vectors at once.
BLOCK = 1024


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays zero."""
    return F.zip_with(v, F.array_repeat(norm(v) + TINY, F.size(v)), lambda x, n: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + TINY) * (norm(b) + TINY))


def padded(v: Column, width: int) -> Column:
    """v cut or filled with zeros to ``width``."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), width)), 1, width)


def top_k(vectors: DataFrame, queries: DataFrame, key: str, k: int, vec_col: str = "embedding", block: int = BLOCK, part: int = 8192) -> DataFrame:
    """qid, key, score, rank: the k nearest vectors of every query by cosine, among all of them; ties to nine places go by key.

    Vectors are dealt to parts, by a hash of their ids; every part meets the queries in a task, which multiplies matrices of
    bounded size and hands on the k best for each query, so the shuffle of results is small and nothing passes the driver."""
    from .vector_index import met

    one = F.lit(0).alias("list")
    q = queries.select(F.col("qid").cast("long").alias("qid"), doubles(F.col("qvec")).alias("v"), one)
    v = vectors.select(F.col(key).cast("long").alias(key), doubles(F.col(vec_col)).alias("v"), one)
    return best(met(v, q, key, k, block, part), key, k)


def best(found: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.asc(key))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(qids: np.ndarray, q: np.ndarray, keys: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(qid, key, score) of the ``k`` best rows of ``v`` by cosine for each row of ``q``; ties to nine places go by key."""
    found = (v / (np.linalg.norm(v, axis=1, keepdims=True) + TINY)) @ (q / (np.linalg.norm(q, axis=1, keepdims=True) + TINY)).T
    out: list[list[np.ndarray]] = [[], [], []]
    for j, qid in enumerate(qids):
        rounded = np.round(found[:, j], 9)
        at = np.arange(len(keys))
        if len(at) > k:  # all that tie with the k-th stay until ties are broken by key
            at = np.flatnonzero(rounded >= np.partition(rounded, len(at) - k)[len(at) - k])
        at = at[np.lexsort((keys[at], -rounded[at]))][:k]
        for x, y in zip(out, (np.full(len(at), qid), keys[at], found[at, j]), strict=True):
            x.append(y)
    return tuple(np.concatenate(x) for x in out)


def first_k(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best of several lists of (qid, key, score) for each query, by score to nine places, then by key."""
    qid, key, score = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((key, -np.round(score, 9), qid))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(qid[order]) != 0])) if len(order) else order
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    kept = order[place < k]
    return qid[kept], key[kept], score[kept]
