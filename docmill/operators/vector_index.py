"""Nearest vectors by inverted lists: a stored index that a batch of queries reads in part, and the exact search as all of its lists.

Centroids are trained on a bounded sample; every vector, sampled or not, lies in the list of its nearest centroid, in folders by list of a
``Store`` that is kept up to date by the row. A query probes the lists of its nearest centroids. Queries and vectors meet by a shuffle on
(list, part, block): lists of many vectors are dealt to parts, queries of a list to blocks of bounded size, so a task multiplies two
matrices of bounded size whatever the table's, and nothing of the batch or the vectors passes the driver. Each hands on its k best for each query. How many lists are probed is measured on the
sample when the index is built: vectors without clusters need most of them, and then the exact search costs little more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.scratch import folder, stored
from docmill.store import Store

from .vectors import BLOCK, TINY, best, doubles, first_k, nearest

#: Vectors that the centroids are trained on (the first by a hash of their id), the most lists, and rounds of training.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 4096, 8
#: Vectors of a list that are multiplied at once.
PART = 8192
#: Parts of a list for each core, parts of PART vectors that a task walks at most (some 70 MB at 64 places), and blocks of queries that it holds (32 MB).
TASKS, WALKED, BLOCKS = 2, 16, 64
#: Share of the nearest vectors that the number of probes is set for, how many are counted, and queries of the sample that it is measured on.
RECALL, NEAREST, MEASURED = 0.95, 20, 256


def trained(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of length 1: rounds of clustering by cosine from evenly chosen vectors; one that loses all its vectors takes the worst placed."""
    x = sample / (np.linalg.norm(sample, axis=1, keepdims=True) + TINY)
    centres = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near = x @ centres.T
        own = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = x[np.argsort(near.max(1), kind="stable")[: len(empty)]]
        centres = sums / (np.linalg.norm(sums, axis=1, keepdims=True) + TINY)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray) -> int:
    """The least number of probes by which vectors of the sample find RECALL of their nearest ones in it."""
    x = sample / (np.linalg.norm(sample, axis=1, keepdims=True) + TINY)
    own = (x @ centres.T).argmax(1)
    at = np.unique(np.linspace(0, len(x) - 1, min(len(x), MEASURED)).astype(int))
    near = x[at] @ x.T
    near[np.arange(len(at)), at] = -np.inf
    k = min(NEAREST, len(x) - 1)
    if k < 1:
        return len(centres)
    best_ = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(x[at] @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, own[best_], axis=1).ravel())
    return int(needed[int(np.ceil(RECALL * len(needed))) - 1]) + 1


def placed(vectors: DataFrame, key: str, centres: np.ndarray, probes: int) -> DataFrame:
    """key, v, list: each vector with each of its ``probes`` nearest lists; ties go to the lower number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), centres.shape[1])
            near = np.round((v / (np.linalg.norm(v, axis=1, keepdims=True) + TINY)) @ centres.T, 12)
            at = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            rows = np.repeat(np.arange(len(v)), at.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(at.ravel().astype(np.int32))], names=[key, "v", "list"])

    return vectors.select(key, "v").mapInArrow(run, f"{key} long, v array<double>, list int")


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(lists) * width:
        raise ValueError(f"vectors differ in width (the index has {width})")
    return flat.reshape(len(lists), width)


def met(vectors: DataFrame, queries: DataFrame, key: str, k: int, block: int = BLOCK, part: int = PART) -> DataFrame:
    """qid, key, score: the ``k`` best of every list for every query that probes it. vectors: key, v, list; queries: qid, v, list.

    A task multiplies ``part`` vectors and ``block`` queries at a time, and walks several of both: a list is dealt to no more parts than the cores
    can use, unless each would have more than WALKED times ``part``, so vectors go through the shuffle once and queries a number of times that goes by the cores."""
    cores = TASKS * vectors.sparkSession.sparkContext.defaultParallelism
    n = F.count(F.lit(1))
    parts = stored(vectors.groupBy("list").agg(F.least(F.ceil(n / F.lit(part)), F.greatest(F.lit(cores), F.ceil(n / F.lit(part * WALKED)))).alias("parts")), "list-parts")
    blocks = stored(queries.groupBy("list").agg(F.ceil(n / F.lit(block * BLOCKS)).alias("blocks")), "list-blocks")
    cells = F.broadcast(parts.join(blocks, "list"))  # a row for each list that is probed
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    some = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    v = vectors.join(cells, "list").select("list", some(key, "parts").alias("part"), each("blocks").alias("block"), key, "v")
    q = queries.join(cells, "list").select("list", each("parts").alias("part"), some("qid", "blocks").alias("block"), "qid", "v")

    def run(_: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), key: pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        qv = right.column("v").combine_chunks()
        width = len(qv.flatten()) // right.num_rows
        qids, q, keys, v = right.column("qid").to_numpy(), _matrix(qv, width), left.column(key).to_numpy(), _matrix(left.column("v").combine_chunks(), width)
        whole = []
        for i in range(0, len(qids), block):
            some = [nearest(qids[i : i + block], q[i : i + block], keys[j : j + part], v[j : j + part], k) for j in range(0, len(keys), part)]
            whole.append(first_k(some, k))
        found = tuple(map(np.concatenate, zip(*whole, strict=True)))
        return pa.table({"qid": pa.array(found[0]), key: pa.array(found[1]), "score": pa.array(found[2])})

    by = ["list", "part", "block"]
    return v.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(run, f"qid long, {key} long, score double")


class VectorIndex:
    """The index at ``path`` of rows (doc_id, embedding)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.store = Store(spark, path, "doc_id", "long", {"lists": "doc_id long, v array<double>, list int", "centres": "list int, centre array<double>"}, {"lists": "list"})

    def build(self, vectors: DataFrame, sample: int = SAMPLE, lists: int | None = None) -> None:
        """Train centroids (about the root of the number of vectors) and place every vector."""
        plain = stored(self._plain(vectors), "vectors")
        n = plain.count()
        if not n:
            return
        rows = plain.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("v").collect()
        centres = trained(np.array([r["v"] for r in rows], float), min(len(rows), lists or max(1, min(MOST_LISTS, round(n**0.5)))))
        table = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
        probes = probes_for(np.array([r["v"] for r in rows], float), centres)
        self.store.commit({"lists": self._laid(plain, centres), "centres": table}, None, {"lists": len(centres), "probes": probes})

    def apply(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """Vectors in place of those with their ids, none for the ids ``removed``; the centroids stay."""
        plain = stored(self._plain(changed), "vectors")
        gone = plain.select("doc_id")
        gone = gone if removed is None else gone.unionByName(removed.select(F.col("doc_id").cast("long").alias("doc_id")))
        self.store.commit({"lists": self._laid(plain, self.centres())}, gone, self.store.note())
        self.store.compact_if_long()

    def centres(self) -> np.ndarray:
        # A centre's key is no id, so no commit takes it away.
        folders = [f"{self.store.path}/rows/centres/part={e['rows']['centres']}" for e in self.store.log() if "centres" in e["rows"]]
        rows = self.spark.read.schema("list int, centre array<double>").parquet(folders[-1]).orderBy("list").collect()
        return np.array([r["centre"] for r in rows], float)

    def top_k(self, queries: DataFrame, k: int, probes: int | None = 0) -> DataFrame:
        """qid, doc_id, score, rank of the nearest vectors of each query (qid, qvec) in the lists that it probes: as many as the sample asked for
        when the index was built, unless told otherwise; None probes all: the exact search."""
        if not self.store.exists():
            return best(self.spark.createDataFrame([], "qid long, doc_id long, score double"), "doc_id", k)
        centres = self.centres()
        probes = self.store.note()["probes"] if probes == 0 else probes
        asked = queries.select(F.col("qid").cast("long").alias("qid"), doubles(F.col("qvec")).alias("v"))
        probing = stored(placed(asked, "qid", centres, min(probes or len(centres), len(centres))), "probes")
        at = [r["list"] for r in probing.select("list").distinct().collect()]  # at most MOST_LISTS numbers
        return best(met(self.store.rows("lists", F.col("list").isin(at)), probing, "doc_id", k), "doc_id", k)

    def _plain(self, vectors: DataFrame) -> DataFrame:
        return vectors.select(F.col("doc_id").cast("long").alias("doc_id"), doubles(F.col("embedding")).alias("v")).filter("v IS NOT NULL")

    def _laid(self, plain: DataFrame, centres: np.ndarray) -> DataFrame:
        return placed(plain, "doc_id", centres, 1).hint("rebalance", "list")


def temporary(spark: SparkSession) -> VectorIndex:
    return VectorIndex(spark, folder(spark, "vector-index"))
