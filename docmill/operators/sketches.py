"""Quantiles by sketches that merge: one sketch a group and day, stored, rolled up over any days without a look at the rows.

A sketch (KLL) keeps some hundreds of numbers however many went in; the rank of a quantile that it gives is off by ``BOUND`` at most, with
a chance of 99 in 100. Days that change are sketched anew and take the place of what was stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.store import Store

#: Size of a sketch, and the largest error of a rank that goes with it.
SIZE, BOUND = 400, 0.012


class DaySketches:
    """Sketches at ``path`` of a number by group and day."""

    def __init__(self, spark: SparkSession, path: str, group_type: str = "string"):
        self.store = Store(spark, path, "day", "date", {"days": f"grp {group_type}, day date, n long, low double, high double, sketch binary"})

    def update(self, rows: DataFrame) -> None:
        """rows (grp, day, value): the whole of every day that they touch."""
        value = F.col("value").cast("double")
        days = rows.groupBy("grp", "day").agg(F.count("value").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.kll_sketch_agg_double(value, F.lit(SIZE)).alias("sketch"))
        self.store.commit({"days": days}, rows.select("day"), {})
        self.store.compact_if_long()

    def rollup(self, ranks: list[float], where: Column | None = None) -> DataFrame:
        """grp, n, low, high, q (array of the quantiles at ``ranks``) over the stored days, or those that ``where`` chooses."""
        merged = self.store.rows("days", where).filter("n > 0").groupBy("grp").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", F.lit(SIZE)).alias("sketch"))
        return merged.select("grp", "n", "low", "high", F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, ranks))).alias("q"))
