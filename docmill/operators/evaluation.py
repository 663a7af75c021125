"""Aggregations of judged cells and of sampled power."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary() -> list[Column]:
    """Cells, errors, mean total over the cells without error, mean seconds over all."""
    fine = F.col("err") == ""
    score = F.coalesce(F.sum(F.when(fine, F.col("total"))), F.lit(0)) / F.greatest(F.lit(1), F.count_if(fine))
    return [F.count(F.lit(1)).alias("n"), F.count_if(~fine).alias("errs"), F.round(score, 6).alias("score"), F.round(F.avg("seconds"), 9).alias("secs")]


def per_model(cells: DataFrame) -> DataFrame:
    fine = F.col("err") == ""
    score = F.coalesce(F.sum(F.when(fine, F.col("total"))), F.lit(0)) / F.greatest(F.lit(1), F.count_if(fine))
    return cells.groupBy("model", "family").agg(F.min("params").alias("params"), F.round(score, 6).alias("score"), F.round(100.0 * F.count_if(F.col("total") > 0) / F.count(F.lit(1)), 6).alias("gold"))


def knee(models: DataFrame, share: float) -> DataFrame:
    """The smallest model whose score is at least ``share`` of the best."""
    best = models.agg(F.max("score").alias("best"))
    return models.crossJoin(F.broadcast(best)).filter(F.col("score") >= share * F.col("best")).orderBy("params", "model").limit(1)


def findings(models: DataFrame) -> DataFrame:
    """Gap between families and whether it matters, whether one holds half of the top five, and weak tiny models."""
    family = models.groupBy("family").agg(F.avg("score").alias("s"))
    gap = family.agg((F.max("s") - F.min("s")).alias("gap"))
    top = models.orderBy(F.desc("score"), "model").limit(5).groupBy("family").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / 5 >= 0.5).alias("dominated"))
    best = models.agg(F.max("score").alias("best"))
    weak = models.crossJoin(F.broadcast(best)).agg(F.count_if((F.col("params") <= 1) & (F.col("score") < 0.5 * F.col("best"))).alias("tiny_weak"))
    return gap.crossJoin(top).crossJoin(weak).select(F.round("gap", 6).alias("family_gap"), (F.col("gap") >= 0.5).alias("gap_matters"), "dominated", "tiny_weak")


def recommendation(models: DataFrame) -> DataFrame:
    """The smallest of the best few, the leader by gold share with a caveat when far ahead, and a smaller way out."""
    whole = Window.partitionBy()
    n = F.count(F.lit(1)).over(whole)
    r = models.withColumn("place", F.row_number().over(whole.orderBy(F.desc("score"), "model"))).withColumn("n", n).withColumn("best", F.max("score").over(whole))
    few = F.greatest(F.lit(3), F.least(F.lit(5), F.floor(F.col("n") / 5)))
    pick = r.filter(F.col("place") <= few).orderBy("params", F.desc("score"), "model").limit(1).select(F.col("model").alias("pick"), F.col("gold").alias("pick_gold"))
    lead = models.orderBy(F.desc("gold"), "model").limit(1).select(F.col("model").alias("gold_leader"), F.col("gold").alias("lead_gold"))
    tight = r.filter(F.col("score") >= 0.8 * F.col("best")).crossJoin(pick).filter("model <> pick").orderBy("params", "model").limit(1).select(F.col("model").alias("tight"))
    return pick.crossJoin(lead).join(tight, how="left").select("pick", "gold_leader", (F.col("lead_gold") - F.col("pick_gold") > 8).alias("caveat"), "tight")


def dimensions(scores: DataFrame, dims: list[str]) -> DataFrame:
    """Strongest and weakest dimension of each model, the first of equals, and a verdict on the sum."""
    def first(best: Column) -> Column:
        return F.element_at(F.filter(F.array(*[F.struct(F.round(d, 9).alias("v"), F.lit(d).alias("d")) for d in dims]), lambda x: x["v"] == best), 1)["d"]

    rounded = [F.round(d, 9) for d in dims]
    total = sum((F.col(d) for d in dims[1:]), F.col(dims[0]))
    band = F.when(total >= 9.5, "great").when(total >= 8.5, "good").when(total >= 7, "fair").otherwise("weak")
    return scores.select("model", first(F.greatest(*rounded)).alias("strongest"), first(F.least(*rounded)).alias("weakest"), band.alias("verdict"))


#: Samples of a segment are cut at hours, so that no window holds more than an hour of one device.
HOUR = 3_600_000_000


def energy(samples: DataFrame, keys: list[str], log: DataFrame | None = None) -> DataFrame:
    """Joules by trapezoids between samples in time order, mean and peak power, mean utilisation, peak memory, samples, seconds: those
    that the segment log (segment, logged) has, else from the first sample to the last.

    Trapezoids run inside hours; the last sample of an hour is carried into the next hour that has one, which are few rows."""
    micros = F.unix_micros("ts")
    cut = samples.withColumn("at", micros).withColumn("hour", F.floor(micros / F.lit(HOUR)))
    inside = Window.partitionBy(*keys, "hour").orderBy("at", "event_id")
    step = (F.col("watts") + F.lag("watts").over(inside)) / 2 * (F.col("at") - F.lag("at").over(inside)) / 1e6
    per = cut.withColumn("joules", step).groupBy(*keys, "hour").agg(
        F.sum("joules").alias("joules"), F.sum("watts").alias("watts"), F.max("watts").alias("peak"), F.sum("util").alias("util"), F.max("mem").alias("mem"), F.count(F.lit(1)).alias("n"),
        F.min(F.struct("at", "event_id", "watts")).alias("head"), F.max(F.struct("at", "event_id", "watts")).alias("tail"),
    )
    last = F.lag("tail").over(Window.partitionBy(*keys).orderBy("hour"))
    edge = (F.col("head.watts") + last["watts"]) / 2 * (F.col("head.at") - last["at"]) / 1e6
    whole = per.withColumn("edge", edge).groupBy(*keys).agg(
        F.round(F.coalesce(F.sum("joules"), F.lit(0.0)) + F.coalesce(F.sum("edge"), F.lit(0.0)), 2).alias("joules"), F.round(F.sum("watts") / F.sum("n"), 6).alias("mean_w"), F.round(F.max("peak"), 6).alias("peak_w"),
        F.sum("n").alias("samples"), F.round(F.sum("util") / F.sum("n"), 6).alias("mean_util"), F.max("mem").alias("peak_mem"), F.round((F.max("tail.at") - F.min("head.at")) / 1e6, 6).alias("secs"),
    )
    if log is None:
        return whole
    return whole.join(F.broadcast(log), keys[0], "left").withColumn("secs", F.coalesce("logged", "secs")).drop("logged")


def gaps(cells: DataFrame) -> DataFrame:
    """Mean scores of models that reason less those of the others, the spread of embedders, and whether that matters."""
    fine = F.avg(F.when(F.col("err") == "", F.col("total")))
    model = cells.groupBy("model", "reasons").agg(fine.alias("score")).agg((F.avg(F.when(F.col("reasons"), F.col("score"))) - F.avg(F.when(~F.col("reasons"), F.col("score")))).alias("gap"))
    spread = cells.groupBy("embedder").agg(fine.alias("score")).agg((F.max("score") - F.min("score")).alias("spread"))
    return model.crossJoin(spread).select(F.round("gap", 6).alias("reasoning_gap"), F.round("spread", 6).alias("embedder_spread"), (F.col("spread") >= 0.5).alias("spread_matters"))


def issues(on: Column) -> Column:
    """What speaks against the side where ``on`` holds: errors anywhere, more seconds, a lower score."""
    mean = lambda c, side: F.avg(F.when(side, F.col(c)))
    found = F.array(F.when(F.count_if(F.col("err") != "") > 0, "errors"), F.when(mean("seconds", on) > mean("seconds", ~on), "slower"), F.when(mean("total", on) < mean("total", ~on), "worse"))
    return F.array_join(F.array_compact(found), ",")
