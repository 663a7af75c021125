"""Evaluation analytics: metrics, rollups, percentiles, energy, recommendations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.operators import evaluation as ev
from docmill.operators import sketches
from docmill.operators.prefix import running
from docmill.scratch import folder
from docmill.sources.tables import table

from .registry import query

#: Judged cells: documents joined to labels; a missing label is an error.
CELLS = """WITH cells AS (SELECT d.doc_id, d.source AS model, d.lang AS embedder, CASE WHEN CAST(substr(d.source, 4) AS INTEGER) < 10 THEN 'small' ELSE 'large' END AS family, CAST(substr(d.source, 4) AS INTEGER) + 1 AS params,
  CASE WHEN l.quality IS NULL THEN 'error' ELSE '' END AS err, coalesce(l.quality, 0) * 6 + coalesce(l.toxic, 0) * 3 AS total, d.n_chars / 1000e0 AS seconds, CAST(d.doc_id % 10 AS INTEGER) AS question, CASE WHEN d.doc_id % 10 < 4 THEN 'fact' WHEN d.doc_id % 10 < 8 THEN 'list' ELSE 'open' END AS category
  FROM documents d LEFT JOIN labels l USING (doc_id))
"""


def cells(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    no = F.substring("source", 4, 9).cast("int")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.col("source").alias("model"), F.col("lang").alias("embedder"), F.when(no < 10, "small").otherwise("large").alias("family"), (no + 1).alias("params"),
        F.when(F.col("quality").isNull(), "error").otherwise("").alias("err"), (F.coalesce("quality", F.lit(0)) * 6 + F.coalesce("toxic", F.lit(0)) * 3).alias("total"),
        (F.col("n_chars") / 1000.0).alias("seconds"), (F.col("doc_id") % 10).cast("int").alias("question"),
        F.when(F.col("doc_id") % 10 < 4, "fact").when(F.col("doc_id") % 10 < 8, "list").otherwise("open").alias("category"),
    )


@query("judge_summary", CELLS + "SELECT model, count(*) AS n, CAST(count(*) FILTER (err <> '') AS BIGINT) AS errs, round(coalesce(sum(total) FILTER (err = ''), 0) / greatest(1, count(*) FILTER (err = ''))::DOUBLE, 6) AS score, round(avg(seconds), 9) AS secs FROM cells GROUP BY model")
def judge_summary(spark, d):
    return cells(spark, d).groupBy("model").agg(*ev.summary())


@query("bench_grouping_sets", CELLS + "SELECT model, embedder, family, category, question, count(*) AS n, count(DISTINCT model) AS models, count(*) FILTER (err <> '') AS errs, round(coalesce(sum(total) FILTER (err = ''), 0) / greatest(1, count(*) FILTER (err = ''))::DOUBLE, 6) AS score, round(avg(seconds), 9) AS secs FROM cells GROUP BY GROUPING SETS ((model), (embedder), (family), (category), (question), (model, category), (model, question), (model, embedder))")
def bench_grouping_sets(spark, d):
    sets = [["model"], ["embedder"], ["family"], ["category"], ["question"], ["model", "category"], ["model", "question"], ["model", "embedder"]]
    cols = ["model", "embedder", "family", "category", "question"]
    c = cells(spark, d).withColumn("whose", F.col("model"))
    return c.groupingSets([[F.col(x) for x in s] for s in sets], *cols).agg(*ev.summary(), F.count_distinct("whose").alias("models"))


@query("latency_percentiles", CELLS + "SELECT model, round(quantile_cont(seconds, 0.5), 6) AS p50, round(quantile_cont(seconds, 0.95), 6) AS p95, round(quantile_cont(seconds, 0.99), 6) AS p99 FROM cells GROUP BY model")
def latency_percentiles(spark, d):
    return cells(spark, d).groupBy("model").agg(*[F.round(F.percentile("seconds", q), 6).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


@query("latency_sketches", "WITH t AS (SELECT unnest([0.5, 0.9, 0.99])::DOUBLE AS q) SELECT event_type, q, count(*) AS n, true AS close FROM events CROSS JOIN t GROUP BY ALL")
def latency_sketches(spark, d):
    """Quantiles from sketches by day, some days sketched anew, rolled up: whether the share of rows up to each is within the sketch's bound of its rank."""
    e = table(spark, d, "events").select(F.col("event_type").alias("grp"), F.to_date("ts").alias("day"), "value")
    stored_ = sketches.DaySketches(spark, folder(spark, "sketches"))
    stored_.update(e.withColumn("value", F.when(F.dayofmonth("day") % 4 == 0, -1.0).otherwise(F.col("value"))))
    stored_.update(e.filter(F.dayofmonth("day") % 4 == 0))
    ranks = [0.5, 0.9, 0.99]
    found = stored_.rollup(ranks).select("grp", F.explode(F.arrays_zip(F.array(*map(F.lit, ranks)).alias("q"), F.col("q").alias("v"))).alias("x")).select("grp", "x.q", "x.v")
    # All quantiles of a group are few; rows meet them by the group.
    off = lambda more: F.sum(F.when(F.col("value") < F.col("v") if more else F.col("value") <= F.col("v"), 1).otherwise(0)) / F.count(F.lit(1))
    near = (off(True) <= F.col("q") + sketches.BOUND) & (off(False) >= F.col("q") - sketches.BOUND)
    return e.join(F.broadcast(found), "grp").groupBy(F.col("grp").alias("event_type"), "q").agg(F.count(F.lit(1)).alias("n"), near.alias("close"))


@query("ratio_metrics", CELLS + "SELECT model, round(sum(total) / nullif(sum(seconds), 0), 6) AS per_second, round(100e0 * count(*) FILTER (total > 0) / greatest(1, count(*)), 1) AS gold_pct, round(avg(seconds) FILTER (seconds > 0), 6) AS mean_positive FROM cells GROUP BY model")
def ratio_metrics(spark, d):
    c = F.col
    return cells(spark, d).groupBy("model").agg(F.round(F.try_divide(F.sum("total").cast("double"), F.sum("seconds")), 6).alias("per_second"), F.round(100.0 * F.count_if(c("total") > 0) / F.greatest(F.lit(1), F.count(F.lit(1))), 1).alias("gold_pct"), F.round(F.avg(F.when(c("seconds") > 0, c("seconds"))), 6).alias("mean_positive"))


@query("heatmap_pivot", CELLS + "SELECT model, round(avg(total) FILTER (embedder = 'en' AND err = ''), 6) AS en, round(avg(total) FILTER (embedder = 'de' AND err = ''), 6) AS de, round(avg(total) FILTER (embedder = 'fr' AND err = ''), 6) AS fr, round(avg(total) FILTER (embedder = 'es' AND err = ''), 6) AS es FROM cells GROUP BY model")
def heatmap_pivot(spark, d):
    good = F.avg(F.when(F.col("err") == "", F.col("total")))
    return cells(spark, d).groupBy("model").pivot("embedder", ["en", "de", "fr", "es"]).agg(F.round(good, 6))


@query("heatmap_questions", CELLS + "SELECT model, " + ", ".join(f"round(avg(total) FILTER (question = {k} AND err = ''), 6) AS q{k}" for k in range(10)) + " FROM cells GROUP BY model")
def heatmap_questions(spark, d):
    good = F.round(F.avg(F.when(F.col("err") == "", F.col("total"))), 6)
    wide = cells(spark, d).groupBy("model").pivot("question", list(range(10))).agg(good)
    return wide.select("model", *[F.col(str(k)).alias(f"q{k}") for k in range(10)])


@query("speed_band", CELLS + "SELECT model, CASE WHEN avg(seconds) < 2 THEN 'fast' WHEN avg(seconds) < 15 THEN 'fair' ELSE 'slow' END AS band FROM cells GROUP BY model")
def speed_band(spark, d):
    s = F.avg("seconds")
    return cells(spark, d).groupBy("model").agg(F.when(s < 2, "fast").when(s < 15, "fair").otherwise("slow").alias("band"))


@query("finding_gaps", CELLS + """, m AS (SELECT model, any_value(params) AS params, avg(total) FILTER (err = '') AS score FROM cells GROUP BY model), e AS (SELECT embedder, avg(total) FILTER (err = '') AS score FROM cells GROUP BY embedder)
SELECT round(avg(score) FILTER (params % 2 = 1) - avg(score) FILTER (params % 2 = 0), 6) AS reasoning_gap, (SELECT round(max(score) - min(score), 6) FROM e) AS embedder_spread, (SELECT max(score) - min(score) >= 0.5 FROM e) AS spread_matters FROM m""")
def finding_gaps(spark, d):
    """Models that reason (here those of odd size) against the others, and how far embedders lie apart."""
    return ev.gaps(cells(spark, d).withColumn("reasons", F.col("params") % 2 == 1))


PER = CELLS + ", m AS (SELECT model, family, min(params) AS params, round(coalesce(sum(total) FILTER (err = ''), 0) / greatest(1, count(*) FILTER (err = ''))::DOUBLE, 6) AS score, round(100e0 * count(*) FILTER (total > 0) / count(*), 6) AS gold FROM cells GROUP BY model, family)"


def models(spark, d):
    """One row per model: family, params, score, gold."""
    return ev.per_model(cells(spark, d))


@query("knee", PER + ", b AS (SELECT *, max(score) OVER () AS best FROM m) SELECT model, params, score, best FROM b WHERE score >= 0.9 * best ORDER BY params, model LIMIT 1")
def knee(spark, d):
    return ev.knee(models(spark, d), 0.9).select("model", "params", "score", "best")


@query("model_rank", PER + " SELECT model, score, row_number() OVER (ORDER BY score DESC, model) AS place, count(*) OVER () AS of FROM m")
def model_rank(spark, d):
    w = Window.partitionBy().orderBy(F.desc("score"), "model")
    return models(spark, d).select("model", "score", F.row_number().over(w).cast("long").alias("place"), F.count(F.lit(1)).over(Window.partitionBy()).alias("of"))


@query("efficiency_rank", PER + " SELECT model, round(score / greatest(0.1, params), 6) AS per_param, row_number() OVER (ORDER BY score / greatest(0.1, params) DESC, model) AS place FROM m")
def efficiency_rank(spark, d):
    per = F.col("score") / F.greatest(F.lit(0.1), F.col("params"))
    return models(spark, d).select("model", F.round(per, 6).alias("per_param"), F.row_number().over(Window.partitionBy().orderBy(per.desc(), "model")).cast("long").alias("place"))


@query("findings", PER + """, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, model) AS place FROM m), f AS (SELECT family, avg(score) AS s FROM m GROUP BY family), top AS (SELECT family, count(*) AS n FROM t WHERE place <= 5 GROUP BY family)
SELECT round(max(s) - min(s), 6) AS family_gap, max(s) - min(s) >= 0.5 AS gap_matters, (SELECT max(n) / 5e0 >= 0.5 FROM top) AS dominated, (SELECT count(*) FROM m WHERE params <= 1 AND score < 0.5 * (SELECT max(score) FROM m)) AS tiny_weak FROM f""")
def findings(spark, d):
    return ev.findings(models(spark, d))


@query("recommendation_card", PER + """, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, model) AS place, count(*) OVER () AS n, max(score) OVER () AS best FROM m),
a AS (SELECT *, row_number() OVER (ORDER BY params, score DESC, model) AS i FROM r WHERE place <= greatest(3, least(5, n // 5))), g AS (SELECT model, gold FROM m ORDER BY gold DESC, model LIMIT 1),
t AS (SELECT *, row_number() OVER (ORDER BY params, model) AS i FROM r WHERE score >= 0.8 * best AND model <> (SELECT model FROM a WHERE i = 1))
SELECT (SELECT model FROM a WHERE i = 1) AS pick, (SELECT model FROM g) AS gold_leader, (SELECT gold FROM g) - (SELECT gold FROM a WHERE i = 1) > 8 AS caveat, (SELECT model FROM t WHERE i = 1) AS tight""")
def recommendation_card(spark, d):
    return ev.recommendation(models(spark, d))


@query("dimension_argmax", """WITH s AS (SELECT l_returnflag || l_linestatus AS model, avg(l_quantity) / 10 AS addresses, avg(l_discount) * 50 AS specificity, avg(l_tax) * 60 AS grounded, 2e0 AS on_topic FROM lineitem GROUP BY 1),
u AS (SELECT model, unnest(['addresses', 'specificity', 'grounded', 'on_topic']) AS dim, unnest([1, 2, 3, 4]) AS pos, unnest([addresses, specificity, grounded, on_topic]) AS v FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(v, 9) DESC, pos) AS hi, row_number() OVER (PARTITION BY model ORDER BY round(v, 9), pos) AS lo, sum(v) OVER (PARTITION BY model) AS total FROM u)
SELECT model, max(CASE WHEN hi = 1 THEN dim END) AS strongest, max(CASE WHEN lo = 1 THEN dim END) AS weakest, CASE WHEN max(total) >= 9.5 THEN 'great' WHEN max(total) >= 8.5 THEN 'good' WHEN max(total) >= 7 THEN 'fair' ELSE 'weak' END AS verdict FROM r GROUP BY model""")
def dimension_argmax(spark, d):
    li = table(spark, d, "lineitem")
    s = li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("model")).agg((F.avg("l_quantity") / 10).alias("addresses"), (F.avg("l_discount") * 50).alias("specificity"), (F.avg("l_tax") * 60).alias("grounded"), F.lit(2.0).alias("on_topic"))
    return ev.dimensions(s, ["addresses", "specificity", "grounded", "on_topic"])


@query("retrieval_metrics", """WITH r AS (SELECT o_orderpriority AS config, o_orderkey % 12 AS gold_rank, o_totalprice AS ms FROM orders)
SELECT config, count(*) AS n, CAST(count(*) FILTER (gold_rank = 1) AS BIGINT) AS top1, count(*) FILTER (gold_rank BETWEEN 1 AND 5) AS at5, count(*) FILTER (gold_rank BETWEEN 1 AND 10) AS at10, round(100e0 * count(*) FILTER (gold_rank = 1) / greatest(1, count(*)), 1) AS top1_pct, round(avg(ms), 4) AS mean_ms FROM r GROUP BY config""")
def retrieval_metrics(spark, d):
    """Recall at several depths of a list of gold ranks (0: not found)."""
    r = table(spark, d, "orders").select(F.col("o_orderpriority").alias("config"), (F.col("o_orderkey") % 12).alias("gold_rank"), F.col("o_totalprice").alias("ms"))
    g, n = F.col("gold_rank"), F.count(F.lit(1))
    return r.groupBy("config").agg(n.alias("n"), F.count_if(g == 1).alias("top1"), F.count_if(g.between(1, 5)).alias("at5"), F.count_if(g.between(1, 10)).alias("at10"), F.round(100.0 * F.count_if(g == 1) / F.greatest(F.lit(1), n), 1).alias("top1_pct"), F.round(F.avg("ms"), 4).alias("mean_ms"))


@query("gold_rank", "SELECT conv_id, min(turn) FILTER (role = 'assistant') AS first_answer, count(*) AS turns FROM conversations GROUP BY conv_id")
def gold_rank(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("first_answer"), F.count(F.lit(1)).alias("turns"))


@query("config_matrix", CELLS + "SELECT embedder, count(*) FILTER (total > 0) AS hits, round(avg(seconds), 6) AS secs, array_to_string(list_sort(list(DISTINCT CAST(question AS VARCHAR)) FILTER (err = '' AND total = 0)), ',') AS failing FROM cells GROUP BY embedder")
def config_matrix(spark, d):
    """Hits, mean seconds and the questions that some cell fails; a set of questions is small and fixed."""
    bad = F.array_sort(F.collect_set(F.when((F.col("err") == "") & (F.col("total") == 0), F.col("question").cast("string"))))
    return cells(spark, d).groupBy("embedder").agg(F.count_if(F.col("total") > 0).alias("hits"), F.round(F.avg("seconds"), 6).alias("secs"), F.nullif(F.array_join(bad, ","), F.lit("")).alias("failing"))


@query("rag_vs_raw", CELLS + "SELECT family, count(*) FILTER (total > 0 AND embedder = 'en') AS with_, count(*) FILTER (total > 0 AND embedder <> 'en') AS without_, round(avg(seconds) FILTER (embedder = 'en'), 6) AS secs_with, round(avg(seconds) FILTER (embedder <> 'en'), 6) AS secs_without, array_to_string(list_filter([CASE WHEN count(*) FILTER (err <> '') > 0 THEN 'errors' END, CASE WHEN avg(seconds) FILTER (embedder = 'en') > avg(seconds) FILTER (embedder <> 'en') THEN 'slower' END, CASE WHEN avg(total) FILTER (embedder = 'en') < avg(total) FILTER (embedder <> 'en') THEN 'worse' END], lambda x: x IS NOT NULL), ',') AS issues FROM cells GROUP BY family")
def rag_vs_raw(spark, d):
    on, hit = F.col("embedder") == "en", F.col("total") > 0
    return cells(spark, d).groupBy("family").agg(F.count_if(hit & on).alias("with_"), F.count_if(hit & ~on).alias("without_"), F.round(F.avg(F.when(on, F.col("seconds"))), 6).alias("secs_with"), F.round(F.avg(F.when(~on, F.col("seconds"))), 6).alias("secs_without"), ev.issues(on).alias("issues"))


@query("answerable_questions", "SELECT item_id FROM benchmark WHERE item_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def answerable_questions(spark, d):
    gold = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("item_id"))
    return table(spark, d, "benchmark").join(gold, "item_id", "left_semi").select("item_id")


@query("eval_grid", "SELECT r_name AS model, n_name AS question, row_number() OVER (ORDER BY r_regionkey, n_nationkey) AS cell FROM region CROSS JOIN nation")
def eval_grid(spark, d):
    """Every model with every question: two stated, small sets."""
    grid = table(spark, d, "region").crossJoin(F.broadcast(table(spark, d, "nation")))
    return grid.select(F.col("r_name").alias("model"), F.col("n_name").alias("question"), F.row_number().over(Window.orderBy("r_regionkey", "n_nationkey")).cast("long").alias("cell"))


POWER = "WITH p AS (SELECT event_type AS segment, CAST(user_id % 2 AS INTEGER) AS gpu, event_id, ts, value AS watts, CAST(user_id % 100 AS DOUBLE) AS util, CAST(event_id % 24000 AS BIGINT) AS mem FROM events), s AS (SELECT *, lag(ts) OVER w AS t0, lag(watts) OVER w AS w0 FROM p WINDOW w AS (PARTITION BY segment, gpu ORDER BY ts, event_id))"


@query("power_segments", POWER + " SELECT segment, gpu, round(sum((watts + w0) / 2 * (epoch_us(ts) - epoch_us(t0)) / 1e6), 2) AS joules, round(avg(watts), 6) AS mean_w, round(max(watts), 6) AS peak_w, count(*) AS samples, round(avg(util), 6) AS mean_util, max(mem) AS peak_mem, CASE WHEN segment = 'click' THEN 3600e0 ELSE round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) END AS secs FROM s GROUP BY segment, gpu")
def power_segments(spark, d):
    p = table(spark, d, "events").select(F.col("event_type").alias("segment"), (F.col("user_id") % 2).cast("int").alias("gpu"), "event_id", "ts", F.col("value").alias("watts"), (F.col("user_id") % 100).cast("double").alias("util"), (F.col("event_id") % 24000).cast("long").alias("mem"))
    log = spark.createDataFrame([("click", 3600.0)], "segment string, logged double")
    return ev.energy(p, ["segment", "gpu"], log)


@query("energy_by_model", POWER + ", e AS (SELECT 'answer.' || segment || '.' || gpu AS label, sum((watts + w0) / 2 * (epoch_us(ts) - epoch_us(t0)) / 1e6) AS joules FROM s GROUP BY segment, gpu) SELECT string_split(label, '.')[3] AS model, round(sum(round(joules, 2)), 1) AS joules, count(*) AS segments FROM e GROUP BY 1")
def energy_by_model(spark, d):
    e = power_segments(spark, d).withColumn("label", F.concat_ws(".", F.lit("answer"), "segment", F.col("gpu").cast("string")))
    return e.groupBy(F.split("label", r"\.", 3)[2].alias("model")).agg(F.round(F.sum("joules"), 1).alias("joules"), F.count(F.lit(1)).alias("segments"))


@query("throughput_summary", "WITH r AS (SELECT l_shipdate IS NULL AS x, l_returnflag AS variant, l_extendedprice / l_quantity AS tps FROM lineitem), a AS (SELECT variant, median(tps) AS med, coalesce(stddev_samp(tps), 0) AS sd, count(*) AS n FROM r GROUP BY variant) SELECT variant, round(med, 6) AS med, round(sd, 6) AS sd, n, round(100 * (med - first_value(med) OVER (ORDER BY variant)) / first_value(med) OVER (ORDER BY variant), 6) AS delta_pct FROM a")
def throughput_summary(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("variant"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("tps"))
    a = r.groupBy("variant").agg(F.median("tps").alias("med"), F.coalesce(F.stddev_samp("tps"), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("n"))
    base = F.first("med").over(Window.orderBy("variant"))
    return a.select("variant", F.round("med", 6).alias("med"), F.round("sd", 6).alias("sd"), "n", F.round(100 * (F.col("med") - base) / base, 6).alias("delta_pct"))


@query("strategy_summary", CELLS + "SELECT family, question, round(avg(total) / 9, 6) AS ratio, round(avg(seconds), 6) AS secs, count(*) FILTER (err <> '') AS errs FROM cells GROUP BY family, question")
def strategy_summary(spark, d):
    return cells(spark, d).groupBy("family", "question").agg(F.round(F.avg("total") / 9, 6).alias("ratio"), F.round(F.avg("seconds"), 6).alias("secs"), F.count_if(F.col("err") != "").alias("errs"))


@query("failure_cutoff", CELLS + ", f AS (SELECT model, doc_id, err, coalesce(sum(CASE WHEN err <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY model ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cells) SELECT model, doc_id, CASE WHEN before >= 2 THEN 'skipped' WHEN err <> '' THEN 'failed' ELSE 'done' END AS state FROM f")
def failure_cutoff(spark, d):
    r = running(cells(spark, d).select("model", "doc_id", "err"), "model", "doc_id", failed="CAST(err <> '' AS INT)")
    before = F.col("failed") - F.when(F.col("err") != "", 1).otherwise(0)
    return r.select("model", "doc_id", F.when(before >= 2, "skipped").when(F.col("err") != "", "failed").otherwise("done").alias("state"))


@query("tok_rate", "SELECT o_orderkey, round(o_totalprice / nullif(o_custkey % 5, 0), 6) AS rate FROM orders")
def tok_rate(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(F.try_divide(F.col("o_totalprice"), F.col("o_custkey") % 5), 6).alias("rate"))
