"""Running sums over long groups without one task for a group: ids are cut into ranges, sums of ranges run first, then rows inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids in a range.
RANGE = 65_536


def running(df: DataFrame, by: str, order: str, width: int = RANGE, **sums: str) -> DataFrame:
    """``df`` with a column for each of ``sums`` (name: expression): its running sum by group up to the row, and ``<name>_all``, that of
    the group. ``order`` is a whole number that is unique in a group. A window never holds more than ``width`` rows, or the ranges
    of one group, which are one row each."""
    cut = df.withColumn("range", F.floor(F.col(order) / F.lit(width)).cast("long"))
    for name, expression in sums.items():
        cut = cut.withColumn(name, F.expr(expression))
    per = cut.groupBy(by, "range").agg(*[F.sum(n).alias(f"{n}_in") for n in sums])
    before = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    heads = per.select(by, "range", *[F.coalesce(F.sum(f"{n}_in").over(before), F.lit(0)).alias(f"{n}_before") for n in sums], *[F.sum(f"{n}_in").over(Window.partitionBy(by)).alias(f"{n}_all") for n in sums])
    inside = Window.partitionBy(by, "range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.select(*df.columns, "range", *[F.sum(n).over(inside).alias(n) for n in sums])
    heads = heads.withColumnRenamed(by, "group").withColumnRenamed("range", "group_range")
    joined = rows.join(heads, rows[by].eqNullSafe(heads["group"]) & (rows["range"] == heads["group_range"]))
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"{n}_before")).alias(n) for n in sums], *[F.col(f"{n}_all") for n in sums])
