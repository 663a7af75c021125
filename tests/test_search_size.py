"""What searches and their index write grows with texts and questions, not with the product of both."""

from pyspark.sql import functions as F

from docmill.operators import lexical, text_index


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def crowd(spark, docs, asked):
    word = F.element_at(F.array(*map(F.lit, ("red", "green", "blue", "grey"))), (F.col("id") % 4 + 1).cast("int"))
    texts = spark.range(docs).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("one two three"), word, F.repeat(F.lit(" two"), (F.col("id") % 9).cast("int"))).alias("text"))
    return texts, spark.range(asked).select(F.col("id").alias("qid"), F.concat_ws(" ", F.lit("one two two"), word).alias("question"))


def test_a_search_shuffles_no_pairs_of_question_and_text(spark):
    texts, asked = crowd(spark, 4_000, 400)
    index = text_index.temporary(spark)
    before = shuffled(spark)
    index.refresh(texts)
    assert shuffled(spark) - before < 20_000  # postings are laid out where they are made
    before = shuffled(spark)
    assert index.top_k(asked, 5).count() == 2_000
    assert shuffled(spark) - before < 1_000_000  # 1.6 million pairs


def test_the_best_rows_are_those_of_all_scores(spark):
    texts, asked = crowd(spark, 300, 6)
    texts = texts.unionByName(texts.filter("doc_id % 50 = 1"))  # rows that share an id
    index = text_index.temporary(spark)
    index.refresh(texts)
    for constants in ({}, {"k1": 1.5, "plus_one": True}):
        want = lexical.top_k(index.bm25(asked, **constants), "doc_id", 7)
        for group in (50, 10_000):
            got = index.top_k(asked, 7, group=group, **constants)
            assert sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in got.collect()) == sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in want.collect())
    assert index.top_k(asked.filter("qid < 0"), 7).count() == 0
    assert index.top_k(asked.select("qid", F.lit("unheard").alias("question")), 7).count() == 0


def test_a_search_shuffles_a_few_bytes_a_posting(spark):
    word = F.element_at(F.array(*map(F.lit, ("red", "green", "blue", "grey"))), (F.xxhash64("id") % 4 + 4).cast("int") % 4 + 1)
    texts = spark.range(60_000).select(F.xxhash64("id", F.lit(1)).alias("doc_id"), F.concat_ws(" ", F.lit("one two three"), word, F.repeat(F.lit(" two"), F.pmod(F.xxhash64("id"), F.lit(9)).cast("int"))).alias("text"))
    asked = spark.range(4).select(F.col("id").alias("qid"), F.lit("one two three red green blue grey").alias("question"))
    index = text_index.temporary(spark)
    index.refresh(texts)
    before = shuffled(spark)
    assert index.top_k(asked, 5).count() == 20
    assert shuffled(spark) - before < 12 * 240_000  # ids are random here, so eight of these are the id


def test_packed_columns_come_back():
    import numpy as np
    import pyarrow as pa

    columns = [np.array([-(2**63), 2**63 - 1, 0, 5], np.int64), np.array([0.1, -1e300, 0.0, 2.0])]
    blocks = pa.table({"n": [4, 4], "block": [lexical.packed(columns)] * 2})
    back = lexical.unpacked(blocks, "if")
    assert [list(c) for c in back] == [list(c) * 2 for c in columns]
    assert [len(c) for c in lexical.unpacked(blocks.slice(0, 0), "if")] == [0, 0]


def written(path) -> int:
    import os

    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(path) for name in names)


def test_an_index_is_written_once_and_without_a_sort(spark):
    from docmill.scratch import run_dir

    texts, _ = crowd(spark, 4_000, 1)
    before = written(run_dir(spark).removeprefix("file://"))
    plans, index = [], text_index.temporary(spark)
    plain = index.store._write
    index.store._write = lambda name, df, path: (plans.append(name), plain(name, df, path))
    index.refresh(texts)
    assert plans == ["postings"]  # rows of texts come out of the same pass
    assert written(run_dir(spark).removeprefix("file://")) - before <= written(index.store.path.removeprefix("file://"))  # nothing beside the index
    assert index.store.rows("files").count() == 4_000 and index.store.note()["n"] == 4_000
    assert index.store.rows("postings").filter("term IS NULL").count() == 0
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_questions_and_best_rows_grow_with_tasks_and_not_with_parts(spark, monkeypatch):
    texts, asked = crowd(spark, 2_000, 400)
    index = text_index.temporary(spark)
    index.refresh(texts)
    sent = []
    for group in (2_000, 40):  # some four, then some 200 parts
        monkeypatch.setattr(lexical, "TASKS", 1)
        before = shuffled(spark)
        got = index.top_k(asked, 5, group=group)
        rows = sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in got.collect())
        sent.append((rows, shuffled(spark) - before))
    assert sent[0][0] == sent[1][0]
    assert sent[1][1] < 4 * sent[0][1]


def test_vectors_are_shuffled_once_whatever_the_questions(spark):
    from docmill.operators import vectors

    place = lambda seed: F.array(*[F.sin(F.col("id") * (i + seed)) for i in range(16)])
    v = spark.range(6_000).select(F.col("id").alias("doc_id"), place(1).alias("embedding"))
    sent = []
    for n in (64, 512):
        q = spark.range(n).select(F.col("id").alias("qid"), place(2).alias("qvec"))
        before = shuffled(spark)
        some = vectors.top_k(v, q, "doc_id", 3, block=32, part=200).collect()
        sent.append(shuffled(spark) - before)
        whole = vectors.top_k(v, q, "doc_id", 3).collect()
        assert sorted((r["qid"], r["rank"], r["doc_id"]) for r in some) == sorted((r["qid"], r["rank"], r["doc_id"]) for r in whole) and len(some) == 3 * n
    assert sent[1] < 3 * 6_000 * 16 * 8  # sixteen blocks of questions


def test_texts_are_not_shuffled_for_their_hits(spark):
    from docmill.operators import ranking

    texts = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2((F.col("id") * 100 + i).cast("string"), 256) for i in range(20)]).alias("text"))
    path = text_index.folder(spark, "texts")
    texts.write.parquet(path)
    hits = spark.range(40).select((F.col("id") % 4).alias("qid"), (F.col("id") * 70).alias("doc_id"))
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert ranking.with_rows(hits, spark.read.parquet(path), "doc_id").count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled(spark) - before < 100_000


def test_a_store_of_vectors_shuffles_no_lone_text(spark):
    from docmill.operators import models
    from docmill.operators.vector_store import VectorStore

    long = F.concat_ws(" ", *[F.sha2((F.col("id") % 2_990 * 100 + i).cast("string"), 256) for i in range(20)])
    texts = spark.range(3_000).select("id", long.alias("text"))  # ten texts twice
    before = shuffled(spark)
    store = VectorStore(spark, "test", models.Hashed, text_index.folder(spark, "vectors"))
    store._learn(texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text"))
    assert shuffled(spark) - before < 1_000_000  # texts are 3.9 MB
    assert store.store.rows("vectors").count() == store.store.rows("vectors").select("digest").distinct().count() == 2_990


def test_figures_of_terms_leave_python_once_a_batch(spark):
    texts, _ = crowd(spark, 3_000, 1)
    texts = texts.unionByName(spark.createDataFrame([(9_000, None), (9_001, "!!"), (9_002, "ten two ten")], "doc_id long, text string"))
    posted = lexical.postings(texts, "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").cast("long").alias("max_tf"))
    got = lexical.term_figures(texts, "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, posted.collect()))
    made = got._jdf.queryExecution().executedPlan()
    python = [x for x in _nodes(made) if "MapInArrow" in x.nodeName()]
    assert len(python) == 1 and python[0].metrics().apply("pythonNumRowsReceived").value() < 200  # 15,000 postings


def test_accents_are_taken_from_terms_as_from_texts(spark):
    import unicodedata

    assert all(unicodedata.category(c)[0] == "L" for c in "".join(lexical._accents()))  # so runs of letters are the same with and without
    texts = spark.createDataFrame([(1, "Élan elan ÉLAN über uber 1a é"), (2, "ﬁ Straße İstanbul e\u0301 ǆ"), (3, None)], "doc_id long, text string")
    want = texts.select("doc_id", F.explode(lexical.all_terms("text")).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    got = lexical.postings(texts, "doc_id", "text").select("doc_id", "term", "tf")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.filter("term = 'elan' AND tf = 3").count() == 1


def _nodes(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _nodes(plan.executedPlan())
    below = [plan.plan()] if plan.nodeName().endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan, *[x for b in below for x in _nodes(b)]]


def test_many_questions_go_in_blocks(spark):
    """Blocks of questions give the same rows as all questions at once."""
    texts, asked = crowd(spark, 300, 40)
    index = text_index.temporary(spark)
    index.refresh(texts)
    rows = [sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in index.top_k(asked, 7, group=100, block=n).collect()) for n in (7, 1_000)]
    assert rows[0] == rows[1] and len(rows[0]) == 40 * 7


def test_citations_answer_every_question(spark, data):
    """Whatever a user says, in any conversation, has its citations."""
    from docmill.plans import QUERIES
    from docmill.sources.tables import table

    asked = {r[0] for r in table(spark, data, "conversations").filter("role = 'user'").select(F.col("conv_id") * 1000 + F.col("turn")).collect()}
    assert {r["qid"] for r in QUERIES["citations"](spark, data).select("qid").collect()} == asked


def test_a_word_is_hashed_once(monkeypatch):
    """Texts repeat their words; a vector is that of one digest for each distinct word."""
    import hashlib
    from types import SimpleNamespace

    import numpy as np

    from docmill.operators import models

    asked = []
    monkeypatch.setattr(models, "hashlib", SimpleNamespace(md5=lambda raw, **rest: asked.append(raw) or hashlib.md5(raw, **rest)))
    words = [f"zq{k}" for k in range(40)]
    texts = [" ".join(words[: k % 41] * 3) for k in range(200)] + ["", "é"]
    found = models.Hashed().embed(texts)
    assert len(asked) == 40
    want = np.zeros((len(texts), 64))
    for row, text in zip(want, texts, strict=True):
        for word in text.split():
            if word != "é":
                number = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
                row[number % 64] += 1 if number // 64 % 2 == 0 else -1
    size = np.linalg.norm(want, axis=1, keepdims=True)
    assert (found == want / np.where(size == 0, 1, size)).all()
