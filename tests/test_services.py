"""Operators around the index that SQL can't express, against plain Python; interfaces of models."""

import numpy as np
import pytest

from docmill.operators import models, passes, retrieve, services, sidecars, vectors
from docmill.operators.prefix import running
from docmill.sources import paged


def events():
    return [(k, i, (i * 7919 * (k + 1)) % 1000) for k in range(4) for i in range(60)]


def by_key(rows):
    for k in sorted({r[0] for r in rows}):
        yield k, sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))


def test_throttle_and_cache(spark):
    rows = events()
    df = spark.createDataFrame(rows, "key long, id long, at long")
    sent, hits = [], []
    for _, mine in by_key(rows):
        last = loaded = None
        for n, r in enumerate(mine):
            if last is None or r[2] - last >= 90 or n == len(mine) - 1:
                sent.append(r)
                last = r[2] if last is None or r[2] - last >= 90 else last
            hit = loaded is not None and r[2] - loaded < 50
            loaded = loaded if hit else r[2]
            hits.append((r[0], r[1], hit))
    assert sorted(map(tuple, services.throttled(df, "key", "at", "id", 90).collect())) == sorted(sent)
    assert sorted(map(tuple, services.cached(df, "key", "at", "id", 50).collect())) == sorted(hits)


def test_merged_modifiers(spark):
    rows = [
        (1, 2, "b", "what of the fee", "global", ["x"], "In b", "briefly", ["No", "yes"]), (1, 1, "a", "what of the fee", "file-only", [], "In a", "", ["no", "maybe", "Maybe"]),
        (1, 3, "b", "what of the fee", "global", [], "again", "again", ["again"]), (1, 4, "c", "what of the fee", "topic-aware", ["FEE"], "In", None, ["p", "q", "r", "s"]),
        (1, 5, "d", "what of the fee", "file-only", [], "never", "never", ["never"]), (2, 1, "d", "plain", "topic-aware", ["fee"], "never", "never", ["never"]),
    ]
    meta = spark.createDataFrame(rows, "qid long, rank int, path string, question string, scope string, topics array<string>, prefix string, suffix string, negatives array<string>")
    (found,) = sidecars.merged(meta, "Answer:", "", ["none"]).collect()
    assert tuple(found) == (1, "Answer: In a In b", "briefly", ["none", "no", "maybe", "yes", "p"])


def test_archive_refuses_to_overwrite(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    services.export({"t": spark.range(5)}, path)
    assert [tuple(r) for r in services.manifest(spark, path).collect()] == [("t", 5)]
    with pytest.raises(FileExistsError):
        services.export({"t": spark.range(5)}, path)


def test_running_sums_by_ranges(spark):
    rows = [(k, i, i % 5) for k in ("a", "b", None) for i in range(-30, 200, 3)]
    df = spark.createDataFrame(rows, "g string, i long, v int")
    got = {(r["g"], r["i"]): (r["s"], r["s_all"]) for r in running(df, "g", "i", width=16, s="v").collect()}
    assert got == {(g, i): (sum(v for h, j, v in rows if h == g and j <= i), sum(v for h, _, v in rows if h == g)) for g, i, _ in rows}


def test_nearest_vectors_by_blocks(spark):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(200, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>").repartition(5)
    q = df.filter("id % 20 = 3").selectExpr("id AS qid", "embedding AS qvec")
    got = sorted((r["qid"], r["rank"], r["id"]) for r in vectors.top_k(df, q, "id", 4, block=3).collect())
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T
    assert got == sorted((i, n + 1, int(j)) for i in range(3, 200, 20) for n, j in enumerate(sorted(range(200), key=lambda j: (-round(near[i, j], 9), j))[:4]))


def test_models_fail_softly(spark):
    class Failing:
        def complete(self, prompt, max_tokens):
            if "bad" in prompt:
                raise ValueError
            return prompt.upper()

        def score(self, pairs):
            if any("bad" in t for _, t in pairs):
                raise ValueError
            return [len(t) for _, t in pairs]

    df = spark.createDataFrame([(1, "good"), (2, "bad one"), (3, None)], "id int, t string").coalesce(1)
    got = {r["id"]: r["x"] for r in df.select("id", models.completed(df["t"], Failing).alias("x")).collect()}
    assert got == {1: "GOOD", 2: "", 3: ""}
    batch = spark.createDataFrame([(1, "q"), (2, "q")], "qid int, question string")
    for texts, want in ((["a", "abc", "ab"], [2, 3, 1]), (["a", "bad", "ab"], [1, 2, 3])):
        hits = spark.createDataFrame([(1, k, k, t) for k, t in enumerate(texts, 1)], "qid int, doc_id int, rank int, text string").coalesce(1)
        assert [r["doc_id"] for r in models.reranked(hits, batch, "text", Failing, 3).orderBy("new_rank").collect()] == want


def test_list_config():
    c = retrieve.Config(window=2, chapter_chars=9000).for_lists()
    assert (c.top_k, c.chapter_chars, c.window, c.fetch) == (16, 4000, 0, 38)
    assert retrieve.Config(mmr=True, per_source=0).fetch == 24 and retrieve.Config(per_source=0).fetch == 8


def test_scans_and_corrections(spark):
    ok = "a readable page of text that holds enough words to be judged at all, and some more "
    pages = [(1, 1, "", ok), (1, 2, "", " "), (2, 1, ok * 2, "x"), (2, 2, ok.replace("a", "\\").replace("e", "\\"), ok), (2, 3, " ", ok), (3, 1, "", "")]
    df = spark.createDataFrame(pages, "file_id int, page int, text string, ocr string")
    got = sorted((r["file_id"], r["page"], r["origin"]) for r in passes.recovered(df).collect())
    assert got == [(1, 1, "scan"), (2, 1, "layer"), (2, 2, "recognised")]


def test_recursive_chunks_keep_all_words(spark, data):
    """Pieces hold at most the limit of words, and in order they are the text's words, once the repeated tails are taken off."""
    from docmill.operators.chunking import recursive_chunks

    texts = {r["doc_id"]: (r["text"] or "").split() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    pieces: dict[int, list[list[str]]] = {}
    for r in recursive_chunks(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text", 128, 32, 16).orderBy("doc_id", "ord").collect():
        pieces.setdefault(r["doc_id"], []).append(r["text"].split())
    assert {k for k, t in texts.items() if t} == set(pieces)
    for key, parts in pieces.items():
        words, last = [], []
        for i, part in enumerate(parts):
            tail = min(24, len(last)) if i else 0
            assert part[:tail] == last[len(last) - tail :]
            last = part[tail:]
            assert 0 < len(last) <= 96
            words += last
        # A mark at which a text is split, as the end of a sentence, goes with the split.
        bare = lambda ws: [w.rstrip(".?!;") for w in ws]
        assert bare(words) == bare(texts[key])


def test_section_chunks_go_on(spark):
    from docmill.operators.chunking import section_chunks, split_words

    rows = [(f, s, " ".join(f"w{f}.{s}.{k}" for k in range(n))) for f, s, n in ((1, 0, 50), (1, 1, 10), (1, 2, 40), (2, 0, 5))]
    got = section_chunks(spark.createDataFrame(rows, "f int, s int, t string"), "f", "s", "t", 27, 8, 6).orderBy("f", "ord").collect()
    want = []
    for f in (1, 2):
        place = 0
        for g, s, t in rows:
            if g == f:
                parts = split_words(t, 20)
                for i, p in enumerate(parts):
                    want.append((f, s, i, place, (" ".join(parts[i - 1].split()[-6:]) + " " if i else "") + p))
                    place += 1
    assert [tuple(r) for r in got] == want


def test_page_recovery_tells_pages_once(spark):
    """Counts of a page are made below the shuffle and once: no pattern for white space at the ends is left, and the filter behind the window tests flags."""
    df = spark.createDataFrame([(1, 1, " a\u00a0\x0b\n", "b")], "file_id long, page int, text string, ocr string")
    plan = passes.recovered(df)._jdf.queryExecution().optimizedPlan().toString()
    assert r"^\s+|\s+$" not in plan
    assert plan.count(r"[^\p{L}\p{N}\s]+") == 2  # of the text and of its recognition


def test_recognition_is_dealt_to_all_cores(spark, tmp_path):
    asked = spark.createDataFrame([(f"f{k}", 1) for k in range(64)], "path string, page int")
    assert paged.recognised(asked, str(tmp_path), lambda: bytes.decode).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_embedding_copies_a_few_texts_at_a_time(spark):
    from pyspark.sql import functions as F

    class Counting:
        def embed(self, texts):
            return np.full((len(texts), 3), [len(texts), len(texts[-1]), float(all(isinstance(t, str) for t in texts))])

    texts = spark.range(0, 3_000, 1, 1).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE repeat('x', CAST(id % 5 AS INT)) END AS text")
    rows = texts.select("id", models.embedded(F.col("text"), Counting).alias("v")).collect()
    assert len(rows) == 3_000 and max(r["v"][0] for r in rows) <= 256 and {r["v"][2] for r in rows} == {1.0}
    plain = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, text string").select("id", models.embedded(F.col("text")).alias("v"))
    want = models.Hashed().embed(["a b", "", ""])
    assert [r["v"] for r in plain.orderBy("id").collect()] == [list(v) for v in want]
