"""Versioned tables, the stored indexes on them, and watched folders."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import lexical, models, text_index, vector_index, vectors
from docmill.operators.vector_store import VectorStore, WidthMismatch
from docmill.scratch import folder
from docmill.store import Conflict, Store
from docmill.streaming import events as st


def size_of(path):
    root = path.removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet"))


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def state(store):
    return sorted((r["k"], r["v"]) for r in store.rows("t").collect())


def store_of(spark, path=None):
    return Store(spark, path or folder(spark, "store"), "k", "long", {"t": "k long, v string"})


def test_commits_replace_and_remove(spark):
    s = store_of(spark)
    assert not s.exists() and state(s) == [] and s.note() == {}
    assert s.commit({"t": frame(spark, [(1, "a"), (2, "b"), (3, "c")])}, None, {"x": 1}) == 0
    s.commit({"t": frame(spark, [(2, "B"), (4, "d")])}, frame(spark, [(2, ""), (4, "")]).select("k"), {"x": 2})
    s.commit({}, frame(spark, [(1, "")]).select("k"), {"x": 3})
    s.commit({"t": frame(spark, [(1, "again")])}, None, {"x": 4})
    want = [(1, "again"), (2, "B"), (3, "c"), (4, "d")]
    assert state(s) == want and s.note() == {"x": 4} and len(s.log()) == 4
    s.compact()
    assert state(s) == want and len(s.log()) == 1 and s.note() == {"x": 4} and len(s._files("rows/t")) == 1 and s._files("gone") == []
    s.commit({}, frame(spark, [(3, "")]).select("k"), {})
    assert state(s) == [w for w in want if w[0] != 3]
    s.drop()
    assert not s.exists()


def test_a_commit_that_fails_is_never_seen(spark):
    s = store_of(spark)
    s.commit({"t": frame(spark, [(1, "a")])}, None, {})
    with pytest.raises(ZeroDivisionError):  # after the rows were written, before the log entry
        s.commit({"t": frame(spark, [(2, "b")])}, frame(spark, [(1, "")]).select("k"), lambda: 1 / 0)
    assert state(s) == [(1, "a")]
    other = store_of(spark, s.path)

    def overtaken():
        other.commit({"t": frame(spark, [(5, "e")])}, None, {})
        return {}

    with pytest.raises(Conflict):
        s.commit({"t": frame(spark, [(6, "f")])}, None, overtaken)
    assert state(s) == [(1, "a"), (5, "e")]


def test_a_commit_writes_its_change_only(spark):
    s = store_of(spark)
    s.commit({"t": spark.range(50_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))}, None, {})
    before = size_of(s.path)
    s.commit({"t": frame(spark, [(7, "x")])}, frame(spark, [(7, "")]).select("k"), {})
    assert before > 2_000_000 and size_of(s.path) - before < 20_000
    assert s.rows("t").count() == 50_000


TEXTS = [(1, "the cat sat"), (2, "a dog and a cat"), (3, "Élan vital"), (4, ""), (5, None), (6, "dog dog dog")]


def hits(found):
    return sorted((r["qid"], r["doc_id"], round(r["score"], 9)) for r in found.collect())


def test_index_gives_what_a_scan_gives_after_every_change(spark):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "cat dog"), (2, "elan"), (3, "nothing"), (4, "!!")], "qid long, question string")
    index = text_index.temporary(spark)
    now = dict(TEXTS)
    index.refresh(docs(TEXTS))
    assert hits(index.bm25(asked)) == hits(lexical.bm25(docs(list(now.items())), asked, "doc_id"))
    now |= {2: "a bird", 7: "cat cat"}
    del now[6]
    index.refresh(docs(list(now.items())))
    assert hits(index.bm25(asked)) == hits(lexical.bm25(docs(list(now.items())), asked, "doc_id"))
    assert len(index.store.log()) == 2 and index.store.rows("files").count() == 6
    index.apply(docs([(8, "dog elan")]), docs([(1, "")]).select("doc_id"))
    now |= {8: "dog elan"}
    del now[1]
    assert hits(index.bm25(asked)) == hits(lexical.bm25(docs(list(now.items())), asked, "doc_id"))
    # What changed is all that an upkeep adds: three postings of two texts.
    token = index.store.log()[1]["rows"]["postings"]
    assert sorted(r["term"] for r in spark.read.parquet(f"{index.store.path}/rows/postings/part={token}").collect()) == ["a", "bird", "cat"]
    index.store.compact()
    assert hits(index.bm25(asked)) == hits(lexical.bm25(docs(list(now.items())), asked, "doc_id"))


def test_a_search_reads_no_text_and_only_its_buckets(spark, data):
    from docmill.plans import retrieval

    index = retrieval.index_of(spark, data)
    assert retrieval.index_of(spark, data).store.log() == index.store.log()  # nothing has changed
    asked = spark.createDataFrame([(1, "that")], "qid long, question string")
    found = index.postings(lexical.query_terms(asked))
    read = found.inputFiles()
    assert 0 < len(read) and {f.split("bucket=")[1].split("/")[0] for f in read if "bucket=" in f} <= {str(b) for b in range(text_index.BUCKETS)}
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "[bucket") or "bucket" in plan.split("PartitionFilters:")[1][:200]
    assert len([f for f in index.store.rows("postings", F.col("bucket").isin([1])).inputFiles()]) >= 1
    scanned = found.select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r["f"].split("bucket=")[1].split("/")[0] for r in scanned}) == 1
    assert "documents" not in plan


def test_in_row_counts(spark):
    rows = [(1, ["b", "a", "b", ""]), (2, []), (3, None), (4, ["x"])]
    df = spark.createDataFrame(rows, "i int, ts array<string>").select("i", lexical.counted(F.col("ts")).alias("c"))
    assert {r["i"]: [tuple(x) for x in r["c"]] for r in df.collect()} == {1: [("", 1), ("a", 1), ("b", 2)], 2: [], 3: [], 4: [("x", 1)]}


def exact(v, queries, k):
    unit = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
    near = np.round(unit @ unit.T, 9)
    return {i: sorted(range(len(v)), key=lambda j: (-near[i, j], j))[:k] for i in queries}


def test_vector_index(spark):
    rnd = np.random.default_rng(4)
    middle = rnd.normal(size=(12, 16))
    v = middle[rnd.integers(0, 12, 900)] + 0.4 * rnd.normal(size=(900, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, embedding array<double>")
    asked = df.filter("doc_id % 50 = 0").selectExpr("doc_id AS qid", "embedding AS qvec")
    index = vector_index.temporary(spark)
    assert index.top_k(asked, 5).count() == 0
    index.build(df, sample=300)
    want = exact(v, range(0, 900, 50), 10)
    got = lambda found: {(r["qid"], r["rank"]): r["doc_id"] for r in found.collect()}
    assert got(index.top_k(asked, 10, probes=None)) == {(i, n + 1): j for i, js in want.items() for n, j in enumerate(js)}
    some = got(index.top_k(asked, 10, probes=6))
    assert sum(j in want[i] for (i, _), j in some.items()) >= 0.9 * 10 * len(want)
    lists = index.store.rows("lists").groupBy("doc_id").count()
    assert lists.count() == 900 and lists.filter("count > 1").count() == 0
    v[3], gone = -v[3], [5, 50]
    index.apply(spark.createDataFrame([(3, v[3].tolist())], "doc_id long, embedding array<double>"), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    v2 = v.copy()
    v2[gone] = 0
    unit = v2 / (np.linalg.norm(v2, axis=1, keepdims=True) + 1e-12)
    now = got(index.top_k(asked.filter("qid <> 50"), 3, probes=None))
    for i in range(0, 900, 50):
        if i != 50:
            near = np.round((v[i] / np.linalg.norm(v[i])) @ unit.T, 9)
            assert [now[i, n + 1] for n in range(3)] == sorted((j for j in range(900) if j not in gone), key=lambda j: (-near[j], j))[:3]


def test_recall_of_the_vector_index_on_a_table(spark):
    """Ids divisible by 50 against all rows, with the number of probes that queries use."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS doc_id", "embedding")
    asked = e.filter("doc_id % 50 = 0").selectExpr("doc_id AS qid", "embedding AS qvec")
    index = vector_index.temporary(spark)
    index.build(e)
    found = {(r["qid"], r["doc_id"]) for r in index.top_k(asked, 20).collect()}
    want = {(r["qid"], r["doc_id"]) for r in vectors.top_k(e, asked, "doc_id", 20).collect()}
    assert len(found & want) >= 0.9 * len(want)


def test_texts_are_embedded_once(spark):
    path = folder(spark, "vectors")
    seen = spark.sparkContext.accumulator(0)

    class Counting(models.Hashed):
        def embed(self, texts):
            seen.add(len(texts))
            return super().embed(texts)

    store = VectorStore(spark, "counting", Counting, path)
    texts = spark.createDataFrame([(1, "one two"), (2, "three"), (3, "one two"), (4, None)], "id int, text string")
    plain = {i: v for i, v in zip((1, 2, 3, 4), models.Hashed().embed(["one two", "three", "one two", ""]).tolist(), strict=True)}
    assert {r["id"]: r["v"] for r in store.vectors(texts, "id", "text").collect()} == plain and seen.value == 3
    assert {r["id"]: r["v"] for r in VectorStore(spark, "counting", Counting, path).vectors(texts, "id", "text").collect()} == plain and seen.value == 3
    store.vectors(spark.createDataFrame([(9, "new")], "id int, text string"), "id", "text").count()
    assert seen.value == 4
    with pytest.raises(WidthMismatch):
        VectorStore(spark, "counting", lambda: models.Hashed(32), path).vectors(spark.createDataFrame([(9, "wide")], "id int, text string"), "id", "text")


def test_a_watch_goes_on_where_it_was(spark):
    """A run that is stopped behind a commit, before its stream has noted the batch, is started again."""
    path = folder(spark, "watch")
    schema = "path string, sha256 string, bytes long"
    rows = [[("a", "1", 1), ("b", "1", 1)], [("b", "2", 2)], [("c", "1", 1)]]
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    store = st.listing(spark, f"{path}/listing")
    store.commit({"files": spark.createDataFrame([("b", "0", 0), ("z", "1", 1)], schema)}, None, {})
    plain, calls = store.commit, []

    def once(*args, **more):
        out = plain(*args, **more)
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return out

    store.commit = once
    with pytest.raises(Exception, match="stopped"):
        st.watch(stream(), store, f"{path}/state")
    store.commit = plain
    st.watch(stream(), store, f"{path}/state")
    assert sorted(map(tuple, store.rows("files").collect())) == [("a", "1", 1), ("b", "2", 2), ("c", "1", 1), ("z", "1", 1)]
    assert [e["note"].get("batch") for e in store.log()] == [None, 0, 1, 2]
