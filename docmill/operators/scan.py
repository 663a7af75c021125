"""The scan of a file for its sidecar, as a chain: sampled sections, a model's title, description and topics, its entities in batches, one list of them.

All files of a batch go through each step together. A model that fails, or says nothing that can be read, leaves its fields empty."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.text import strip, without_fences
from docmill.functions.tolerant import balanced
from docmill.scratch import discard, stored

from .lookups import stratified
from .models import TextModel, completed

#: Sections that are sampled, sections that a model sees for entities at once, characters of a section for topics and for
#: entities, lengths that fields are cut to, topics, and entities in a bucket.
SAMPLE, BATCH, TOPIC_CHARS, ENTITY_CHARS = 12, 4, 600, 400
TITLE, DESCRIPTION, TOPICS, ENTITIES = 200, 500, 10, 30
#: Kinds of entities.
BUCKETS = ("npcs", "classes", "items", "locations", "factions", "spells", "monsters", "custom_terms")
_TOPIC = "Sum up the document that these excerpts are from as a JSON object with title, description and topics (a list).\n\n"
_ENTITY = "List the names in these excerpts as a JSON object with the lists " + ", ".join(BUCKETS) + ".\n\n"


def _fields(reply: str | None) -> tuple[str, str, list[str]]:
    found = balanced(reply)
    obj = json.loads(found) if found else {}
    topics = obj.get("topics") or []
    kept = [t.strip() for t in topics if isinstance(t, str) and t.strip()] if isinstance(topics, list) else []
    return str(obj.get("title") or "")[:TITLE], str(obj.get("description") or "")[:DESCRIPTION], kept[:TOPICS]


def _named(reply: str | None) -> list[tuple[str, int, str]]:
    """(bucket, place, name) of a reply; what isn't a list of texts under a bucket's name is passed over."""
    found = balanced(reply)
    obj = json.loads(found) if found else {}
    return [(b, i, t.strip()) for b in BUCKETS if isinstance(obj.get(b), list) for i, t in enumerate(obj[b]) if isinstance(t, str) and len(t.strip()) > 1]


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("topics", T.ArrayType(T.StringType()))]))
def fields(replies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_fields(r) for r in replies], columns=["title", "description", "topics"])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("bucket", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("term", T.StringType())])))
def named(replies: pd.Series) -> pd.Series:
    return pd.Series([[{"bucket": b, "place": i, "term": t} for b, i, t in _named(r)] for r in replies], dtype=object)


def excerpts(samples: Column, chars: int) -> Column:
    """Texts of an ordered array of (place, text) as numbered excerpts, cut to ``chars``."""
    one = lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.when(F.length(x["text"]) > chars, F.concat(F.substring(x["text"], 1, chars), F.lit("…"))).otherwise(x["text"]))
    return F.array_join(F.transform(samples, one), "\n\n")


def sampled(sections: DataFrame, key: str, count: int) -> DataFrame:
    """key, i (from 1), text: ``count`` sections with text of each file, from head, tail and between."""
    return _sampled(_stripped(sections, key), key, count)


def _stripped(sections: DataFrame, key: str) -> DataFrame:
    return sections.select(key, "ord", strip(F.coalesce("text", F.lit(""))).alias("text"))


def _sampled(stripped: DataFrame, key: str, count: int) -> DataFrame:
    texty = stripped.filter("text <> ''")
    rows = stratified(texty.select(key, "ord"), key, "ord", count).select(key, "ord")
    place = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    return rows.withColumn("i", place).join(texty, [key, "ord"]).select(key, "i", "text")


def scan(sections: DataFrame, topics: Callable[[], TextModel], entities: Callable[[], TextModel], key: str = "file_id", count: int = SAMPLE, batch: int = BATCH) -> DataFrame:
    """key, title, description, topics, entities (array of bucket and terms, in the buckets' order) of every file; files without text have empty
    fields. sections: key, ord (a whole number, unique in a file), text. A file's sample is of bounded size, so its row holds it whole."""
    made = stored(_stripped(sections, key), "stripped-sections")  # four steps read them; they are made once
    files = stored(made.select(key).distinct(), "section-files")
    rows = stored(_sampled(made, key, count), "sampled-sections")
    discard(made)
    ordered = lambda: F.array_sort(F.collect_list(F.struct("i", "text")))
    whole = rows.groupBy(key).agg(ordered().alias("s"))
    told = whole.select(key, F.lower(F.array_join(F.transform("s", lambda x: x["text"]), "\n")).alias("seen"), completed(F.concat(F.lit(_TOPIC), excerpts(F.col("s"), TOPIC_CHARS)), topics, 300).alias("reply"))
    told = stored(told.select(key, "seen", fields(without_fences(F.col("reply"))).alias("f")), "topic-pass")
    parts = rows.groupBy(key, F.floor((F.col("i") - 1) / F.lit(batch)).alias("part")).agg(ordered().alias("s"))
    replies = parts.select(key, "part", completed(F.concat(F.lit(_ENTITY), excerpts(F.col("s"), ENTITY_CHARS)), entities, 400).alias("reply"))
    found = stored(replies.select(key, "part", F.explode(named(without_fences(F.col("reply")))).alias("e")).select(key, "part", "e.*").withColumn("low", F.lower("term")), "entity-pass")
    terms = found.groupBy(key).agg(F.collect_set("low").alias("terms"))  # of a bounded number of replies
    held = told.join(terms, key).select(key, F.explode(F.filter("terms", lambda t: F.contains(F.col("seen"), t))).alias("low"))
    counted = found.join(held, [key, "low"]).groupBy(key, "bucket", "low").agg(F.count(F.lit(1)).alias("n"), F.min_by("term", F.struct("part", "place")).alias("form"))
    place = F.row_number().over(Window.partitionBy(key, "bucket").orderBy(F.desc("n"), "low"))
    best = counted.withColumn("place", place).filter(F.col("place") <= ENTITIES)
    lists = best.groupBy(key, "bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "form"))), lambda x: x["form"]).alias("terms"))
    number = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    each = lists.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(number.alias("no"), "bucket", "terms"))), lambda x: F.struct(x["bucket"].alias("bucket"), x["terms"].alias("terms"))).alias("entities"))
    none = F.array().cast("array<string>")
    empty = F.array().cast("array<struct<bucket: string, terms: array<string>>>")
    out = files.join(told.select(key, "f.*"), key, "left").join(each, key, "left")
    return out.select(key, F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("topics", none).alias("topics"), F.coalesce("entities", empty).alias("entities"))
