"""What tools and services send: JSON in several shapes, catalogue pages, streams of reply lines; as columns, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cards(raw: DataFrame, json_col: str, name_keys: list[str], total_key: str, used_key: str) -> DataFrame:
    """id, idx, name, total_mb, free_mb from a map of cards ({"card0": {...}, ...}); entries that aren't objects are left out, and an
    index or a size that isn't a number is 0."""
    each = raw.select("id", F.explode(F.from_json(json_col, "map<string,string>")).alias("key", "value"))
    info = each.select("id", "key", F.from_json("value", "map<string,string>").alias("m")).filter("m IS NOT NULL AND cardinality(m) > 0")
    mb = lambda k: F.floor(F.coalesce(F.expr("m")[k].try_cast("long"), F.lit(0)) / 1048576).cast("int")
    name = F.coalesce(*[F.nullif(F.col("m")[k], F.lit("")) for k in name_keys], F.lit("Unknown"))
    idx = F.coalesce(F.replace("key", F.lit("card"), F.lit("")).try_cast("int"), F.lit(0))
    return info.select("id", idx.alias("idx"), name.alias("name"), mb(total_key).alias("total_mb"), F.greatest(F.lit(0), mb(total_key) - mb(used_key)).alias("free_mb"))


def rows_of(raw: DataFrame, json_col: str, item: str, *fields: str) -> DataFrame:
    """One row for each object: the JSON is a list of objects, one object alone, or an object with the list in one of ``fields``."""
    one = f"array<struct<{item}>>"
    wrapped = [F.from_json(F.get_json_object(json_col, f"$.{f}"), one) for f in fields]
    alone = F.when(F.ltrim(F.col(json_col)).startswith("{"), F.array(F.from_json(json_col, f"struct<{item}>")))
    listed = F.when(F.ltrim(F.col(json_col)).startswith("["), F.from_json(json_col, one))
    return raw.withColumn("items", F.coalesce(*wrapped, listed, alone)).select(*[c for c in raw.columns if c != json_col], F.inline("items"))


def plain(html: Column) -> Column:
    """Without tags, white space as single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), r"\s+", " "))


#: The marks of a card's fields on the catalogue page.
ANCHOR = r'<a [^>]*href="/library/([A-Za-z0-9._\-]+)"'
FIELDS = {"caps": "x-test-capability", "sizes": "x-test-size", "pulls": "x-test-pull-count", "tags": "x-test-tag-count", "updated": "x-test-updated"}
DESCRIPTION = r'(?is)<p class="max-w-lg [^"]*">(.*?)</p>'


def library_cards(pages: DataFrame, html_col: str) -> DataFrame:
    """Cards of a catalogue page, one after the other: key columns, pos, name, description, lists of capabilities and sizes, and the
    pulls, tags and update time as they are written. A card goes from its anchor to the next one."""
    names = F.regexp_extract_all(html_col, F.lit(ANCHOR), F.lit(1))
    bodies = F.slice(F.split(html_col, ANCHOR), F.lit(2), F.greatest(F.lit(0), F.size(names)))
    each = pages.select(*[c for c in pages.columns if c != html_col], F.posexplode(F.arrays_zip(names.alias("name"), bodies.alias("body"))).alias("pos", "card"))
    found = lambda mark: F.transform(F.regexp_extract_all(F.col("card.body"), F.lit(rf"(?is){mark}[^>]*>(.*?)</span>"), F.lit(1)), plain)
    first = lambda mark: F.coalesce(F.get(found(mark), F.lit(0)), F.lit(""))
    return each.select(
        *[c for c in pages.columns if c != html_col], "pos", F.col("card.name").alias("name"), plain(F.regexp_extract("card.body", DESCRIPTION, 1)).alias("description"),
        found(FIELDS["caps"]).alias("caps"), found(FIELDS["sizes"]).alias("sizes"), *[first(FIELDS[k]).alias(k) for k in ("pulls", "tags", "updated")],
    )


def reply_events(lines: DataFrame, line_col: str) -> DataFrame:
    """Key columns, kind (thinking, content, error), text from lines of a streamed reply. Lines that aren't JSON say nothing; what comes
    after the first error or the line that says ``done`` is not read. ``lines`` has qid and pos."""
    from pyspark.sql import Window

    parsed = lines.withColumn("o", F.from_json(line_col, "message struct<thinking:string,content:string>, error string, done boolean"))
    stop = F.coalesce((F.col("o.error") != "") | F.col("o.done"), F.lit(False))
    before = Window.partitionBy("qid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    live = parsed.withColumn("over", F.coalesce(F.max(stop).over(before), F.lit(False))).filter("NOT over")
    said = F.when(F.coalesce(F.col("o.error"), F.lit("")) != "", F.array(F.struct(F.lit("error").alias("kind"), F.col("o.error").alias("text")))).otherwise(
        F.array(F.struct(F.lit("thinking").alias("kind"), F.col("o.message.thinking").alias("text")), F.struct(F.lit("content").alias("kind"), F.col("o.message.content").alias("text")))
    )
    return live.select("qid", "pos", F.inline(said)).filter("text <> ''")
