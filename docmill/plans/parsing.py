"""Parser queries over pages and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.sources.tables import table

from .registry import query
from .texts import values


@query("parse_html")
def parse_html(spark, d):
    from docmill.sources.parsers import html_to_text

    return table(spark, d, "pages").select("page_id", "url", html_to_text("html").alias("text"))


@query("ocr_join_lines", "SELECT l_orderkey, string_agg(l_returnflag || l_partkey, chr(10) ORDER BY round_even(l_quantity / 12, 0), l_extendedprice, l_linenumber) AS text FROM lineitem GROUP BY l_orderkey")
def ocr_join_lines(spark, d):
    """Boxes of a page in reading order: by line (height over 12, rounded half to even), then from the left."""
    box = F.struct(F.bround(F.col("l_quantity") / 12, 0).alias("line"), F.col("l_extendedprice").alias("x"), "l_linenumber", F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("t"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(box)), lambda b: b["t"]), "\n").alias("text"))


DEVICES = ((1, "0, RTX 9, 8192, 12, 55"), (2, "1, RTX 5, 4096, [N/A], 60"), (3, "bad line"))


@query("vendor_csv", f"SELECT id, TRY_CAST(trim(string_split(line, ',')[1]) AS INTEGER) AS idx, trim(string_split(line, ',')[2]) AS name, TRY_CAST(trim(string_split(line, ',')[3]) AS INTEGER) AS mb, TRY_CAST(trim(string_split(line, ',')[4]) AS INTEGER) AS util FROM ({values(*DEVICES)}) AS t(id, line) WHERE len(string_split(line, ',')) = 5")
def vendor_csv(spark, d):
    """Lines of a device tool; a cell that isn't a number is missing."""
    c = F.split("line", ",")
    number = lambda i: F.trim(c[i]).try_cast("int")
    return spark.createDataFrame(DEVICES, "id int, line string").filter(F.size(c) == 5).select("id", number(0).alias("idx"), F.trim(c[1]).alias("name"), number(2).alias("mb"), number(3).alias("util"))


@query("power_csv", "SELECT event_id, printf('%.3f', epoch(ts)) || ',' || event_type || ',' || printf('%.2f', value) AS line FROM events")
def power_csv(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.concat_ws(",", stamp(F.unix_micros("ts")), "event_type", F.format_string("%.2f", "value")).alias("line"))


def stamp(micros):
    """Seconds with three places, as a floating-point second prints them: the nearest double of an instant from 2004 to 2038 is a multiple
    of 2^-22 s, and that exact number is rounded, halves to even. Whole numbers all through."""
    second, rest = F.floor(micros / F.lit(1_000_000)), F.pmod(micros, F.lit(1_000_000))
    units = F.floor((rest * 131072 + 15625) / F.lit(31250)).cast("long")  # nearest; never a half, as 15,625 is odd
    scaled = units * 125
    whole, left = F.floor(scaled / F.lit(524288)).cast("long"), F.pmod(scaled, F.lit(524288))
    up = (left > 262144) | ((left == 262144) & (whole % 2 == 1))
    total = second.cast("long") * 1000 + whole + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(total / F.lit(1000)).cast("long").cast("string"), F.lit("."), F.lpad(F.pmod(total, F.lit(1000)).cast("string"), 3, "0"))


@query("chat_lines", "SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY conv_id")
def chat_lines(spark, d):
    """Each conversation as lines of role and whole text, in order."""
    line = F.concat("role", F.lit(": "), "text")
    c = table(spark, d, "conversations").select("conv_id", "turn", line.alias("line"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("chat"))
