"""Every stage of the pipeline against plain Python, each on what the one before kept."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from test_dedup import brute_near
from test_mixing import brute_targets

from docmill.llm import bpe, quality_model


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.fixture(scope="module")
def stages(spark, data):
    """Rows of the input and of every stage's result; the input has nulls, an empty text and repeated rows."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame([(None, "no id at all", "en", "s", 1), (10**9, None, "en", None, 0), (10**9 + 1, "", None, "s", 0)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.filter("doc_id % 40 = 0"))
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
        out.append(docs.collect())
    return [*out, corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()]


def test_quality_stage(spark, data, stages):
    docs = spark.createDataFrame(stages[0], "doc_id long, text string, lang string, source string, n_chars long")
    model = quality_model.fit(*quality_model.training_rows(docs, spark.read.parquet(f"{data}/labels.parquet")))
    scored = quality_model.score_rows(docs, model).collect()
    assert Counter(tuple(r)[:5] for r in scored if r["score"] >= 0.5) == Counter(map(tuple, stages[1]))


def test_exact_stage(stages):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    want = {}
    for r in stages[1]:
        rank = (-len(r["text"] or ""), r["doc_id"] is not None, r["doc_id"] or 0)
        want[norm(r["text"])] = min(want.get(norm(r["text"]), (rank, r["doc_id"])), (rank, r["doc_id"]), key=lambda x: x[0])
    assert Counter(r["doc_id"] for r in stages[2]) == Counter(i for _, i in want.values())


def test_near_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2]]
    want = [w[0] for w in brute_near(rows, 5) if w[0] == w[2]]
    assert Counter(r["doc_id"] for r in stages[3]) == Counter(want)


def test_mixing_stage(stages):
    size, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in stages[3]:
        size[r["source"]] += words(r["text"])
        largest[r["source"]] = max(largest[r["source"]], words(r["text"]))
    for r in stages[4]:
        taken[r["source"]] += words(r["text"])
    targets = brute_targets(size)
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in size)
    before, after = Counter(map(tuple, stages[3])), Counter(map(tuple, stages[4]))
    assert all(n <= 2 * before[r] for r, n in after.items())
    assert all(after[r] == n for r, n in before.items() if not words(r[1]))


def test_token_stage(stages):
    import public_tokenizers

    core = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).core
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in stages[4]:
        ids = core.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode())))
    assert Counter(tuple(r)[:4] for r in stages[5]) == Counter(want)


def test_stages_take_textual_ids(spark, data):
    """Every stage runs on ids that are no numbers, and keeps as many rows as on numbers where ids only name rows."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    from docmill.llm.shared import stash

    docs = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id < 90 OR doc_id % 7 = 0")
    kept = {}
    for kind, column in (("number", F.col("doc_id")), ("text", F.concat(F.lit("a-"), F.col("doc_id").cast("string")))):
        now = docs.withColumn("doc_id", column)
        for name, stage in corpus_pipeline.STAGES[1:]:
            left = stash(stage(spark, now, data), f"textual-{name}")
            kept[kind, name] = left.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert left.columns == now.columns and left.schema["doc_id"].dataType == now.schema["doc_id"].dataType
                now = left
    names = [n for n, _ in corpus_pipeline.STAGES[1:]]
    assert [kept["text", n] for n in names[:2]] == [kept["number", n] for n in names[:2]] and all(kept["text", n] > 0 for n in names)
