"""The mix against its constraints and a brute-force reading of the targets; the pipeline end to end."""

from math import exp

import pytest
from pyspark.sql import functions as F

from docmill.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), total=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), total * sum(sizes.values())
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, "w " * (1 + i * 7 % 90), ("a", "b", "c", "ä", "Z")[min(4, i % 9)]) for i in range(400)]
    return out + [(500, None, "a"), (501, "", None), (502, "x y z", None), (None, "no id", "b"), (3, "w " * 22, "c"), (600, "q " * 3000, "b")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "k") for r in rows], "doc_id long, text string, source string, size int, skey string")


def test_mix(spark, rows):
    got = mixing.mix(frame(spark, rows)).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    assert sorted({round(x, 6) for x in got.target}) == sorted({round(float(x), 6) for x in want.values()})
    assert (got.taken <= 2 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    per = got.groupby("target").agg(taken=("taken", "sum"), largest=("size", "max"))
    # All sources here have small documents to fill up with.
    assert (abs(per.taken - per.index) <= 25).all()
    again = mixing.mix(frame(spark, rows[::-1])).toPandas()
    by = lambda x: sorted(x[["doc_id", "size", "taken"]].fillna(-1).itertuples(index=False, name=None))
    assert by(got) == by(again)


def test_apply(spark, rows):
    docs = frame(spark, rows)
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.filter("doc_id = 500").count() == 1


def test_rates_tilt(spark):
    """Without rounding, the rates meet the target: their logarithms are in proportion to sizes, up to the cap."""
    hist = spark.createDataFrame([("sa", 1, 10), ("sa", 5, 10), ("sa", 50, 2)], "skey string, size int, docs long")
    for target in (0.5, 120.0, 160.0, 250.0, 319.9):
        targets = spark.createDataFrame([("sa", 160, target)], "skey string, source_size int, target double")
        p = mixing.solve_dual(hist, targets).first()
        rate = lambda size: min(2, exp(p["lam"] * size / p["scale"]))  # noqa: E731, B023
        assert abs(sum(n * s * rate(s) for s, n in ((1, 10), (5, 10), (50, 2))) - target) < 1e-5 * target


def test_unsolved_dual_is_an_error(spark, rows, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    with pytest.raises(RuntimeError):
        mixing.mix(frame(spark, rows))


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1, 2, 3), (2, "c d", "x", 4, 5, 6)], "doc_id long, text string, source string, id_0 int, copies_0 int, copy_0 int")
    assert mixing.apply_mix(docs).columns == docs.columns and mixing.apply_mix(docs).count() == 3


def test_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0


def test_pipeline(spark, data):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, data).toPandas(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0
    good = spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1").count()
    assert sizes[1] >= good
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == sizes[4]
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, data) if none.columns[-1] == "n_chars" else none
    assert none.count() == 0


def test_no_document_is_taken_more_than_twice_in_a_large_table(spark):
    """Documents at the cap are whole copies already: the threshold that rounds the others must not add a third one."""
    size = (F.xxhash64("id").bitwiseAND(F.lit(15)) + 1) * F.when(F.col("id") % 3 == 0, 12).otherwise(1)
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), size.cast("int")).alias("text"), (F.col("id") % 40).cast("string").alias("source"))
    found = mixing.mix(docs)
    assert found.filter("copies > 2 OR taken > 2 * size").count() == 0
    ends = found.groupBy((F.col("doc_id") % 40).alias("source")).agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert ends.filter("abs(taken - target) > 25").count() == 0
