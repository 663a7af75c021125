"""Lookups in small dimension tables: nearest match, priorities, cascades, sampling, ordered merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import device_name
from docmill.scratch import stored

from .prefix import running


def nearest_spec(probes: DataFrame, catalog: DataFrame) -> DataFrame:
    """probes (id, name, vram) with the catalogue row (pos, name, aliases, vram_gb) whose name or alias is theirs, the one
    nearest in memory; without a measure or on ties the first in the catalogue."""
    names = catalog.select("pos", F.col("name").alias("spec"), "vram_gb", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), device_name))).alias("key"))
    joined = probes.withColumn("key", device_name(F.col("name"))).join(F.broadcast(names), "key", "left")
    order = Window.partitionBy("id").orderBy(F.coalesce(F.abs(F.col("vram_gb") - F.col("vram")), F.lit(0)), "pos")
    return joined.withColumn("n", F.row_number().over(order)).filter("n = 1").select("id", "name", "spec", "vram_gb")


def assignment_for(wanted: DataFrame, assignments: DataFrame) -> DataFrame:
    """wanted (model, role) with a device: the exact role, else the role any, else the model's only assignment."""
    a = assignments.withColumn("only", F.count(F.lit(1)).over(Window.partitionBy("model")) == 1).withColumnRenamed("role", "has")
    order = F.when(F.col("has") == F.col("role"), 1).when(F.col("has") == "any", 2).when(F.col("only"), 3)
    best = wanted.join(F.broadcast(a), "model", "left").withColumn("prio", order)
    found = best.filter("prio IS NOT NULL").groupBy("model", "role").agg(F.min(F.struct("prio", "device")).alias("b"))
    return wanted.join(found, ["model", "role"], "left").select("model", "role", F.col("b.device").alias("device"))


def stratified(df: DataFrame, by: str, order: str, count: int) -> DataFrame:
    """``count`` rows of each group: two at the head, two at the tail, the rest at even steps between; small groups whole,
    and fewer than four rows spread evenly. ``order`` is a whole number that is unique in a group."""
    r = running(df, by, order, place="1L").withColumn("i", F.col("place") - 1).withColumnRenamed("place_all", "n").drop("place")
    if count < 4:
        wanted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.floor(k * F.col("n") / F.lit(float(count))))
        return r.filter((F.col("n") <= count) | F.array_contains(wanted, F.col("i").cast("long"))).drop("i", "n")
    middle = count - 4
    step = F.greatest(F.lit(1), F.floor((F.col("n") - 4) / F.lit(float(max(1, middle)))))
    at = F.col("i") - 2
    inside = (at >= 0) & (F.col("i") < F.col("n") - 2) & (at % step == 0) & (at / step < middle)
    return r.filter((F.col("n") <= count) | (F.col("i") < 2) | (F.col("i") >= F.col("n") - 2) | inside).drop("i", "n")


#: Characters at the head of a term by which it meets the texts that may hold it, and the words that may; rows up to which heads are broadcast.
GRAM, HEAD, BROADCAST_HEADS = 3, 5, 100_000
#: A run of letters and numbers: what is one lies within one of a text's longest ones.
_RUN = r"[\p{L}\p{N}]+"


def _pieces(column: str, *sizes: int):
    """The distinct stretches of these sizes from every place of a text."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]))


def _in_words(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """The keys (grp, key), runs of letters and numbers, that some text of their group holds: looked up in the group's distinct words. Keys under HEAD
    characters are looked up among the words' pieces, of which there are few different ones; words meet longer keys by the first HEAD."""
    words = stored(texts.select("grp", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_RUN), F.lit(0)))).alias("word")).distinct(), "words")
    place = lambda n: F.when(F.length("word") >= n, F.transform(F.sequence(F.lit(1), F.length("word") - (n - 1)), lambda p: F.substring("word", p, F.lit(n))))
    short, long = keys.filter(F.length("key") < HEAD), keys.filter(F.length("key") >= HEAD)
    parts = words.select("grp", F.explode(F.flatten(F.array_compact(F.array(*[place(n) for n in range(2, HEAD)])))).alias("key")).distinct()
    heads = long.select("grp", "key", F.substring("key", 1, HEAD).alias("head"))
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_HEADS else heads
    met = words.select("grp", "word", F.explode(F.array_distinct(place(HEAD))).alias("head")).join(heads, ["grp", "head"])
    return short.join(parts, ["grp", "key"], "left_semi").unionByName(met.filter(F.contains("word", "key")).select("grp", "key").distinct())


def _in_texts(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """The same for any keys: such a key meets the texts of its group that hold its first characters, and only those are searched for it."""
    keys = keys.withColumn("gram", F.substring("key", 1, GRAM))
    texts = texts.withColumn("digest", F.xxhash64("text"))
    grams = texts.select("grp", "digest", F.explode(_pieces("text", 2, GRAM)).alias("gram"))
    near = grams.join(keys.select("grp", "gram").distinct(), ["grp", "gram"], "left_semi").distinct()
    may = near.join(keys, ["grp", "gram"]).select("grp", "digest", "key")
    return texts.join(may, ["grp", "digest"]).filter(F.contains("text", "key")).select("grp", "key").distinct()


def consolidate(found: DataFrame, sampled: DataFrame, most: int = 30) -> DataFrame:
    """Terms (grp, bucket, pos, term) as frequent forms: those that some sampled text (grp, text; any number of rows in a group)
    holds, counted without regard to case, first form kept, at most ``most`` in a bucket by count and name. Where ``found`` has
    ``own``, one of the sampled texts or a part of it, only terms that it doesn't hold are looked up in the group's other texts.

    Forms are counted where they are read, so what is written grows with the number of different ones."""
    t = found.withColumn("term", F.trim("term")).filter(F.length("term") > 1).withColumn("key", F.lower("term"))
    own = F.coalesce(F.contains(F.lower("own"), F.col("key")), F.lit(False)) if "own" in found.columns else F.lit(False)
    # Numbers alone in the first step, which Spark sums up by hashing; texts are compared in the second one.
    forms = t.groupBy("grp", "bucket", "key", "term").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"), F.max(own.cast("int")).alias("sure"))
    g = forms.groupBy("grp", "bucket", "key").agg(F.sum("n").alias("n"), F.min_by("term", "pos").alias("form"), F.max("sure").alias("sure"))
    g = stored(g, "forms")
    terms = g.groupBy("grp", "key").agg(F.max("sure").alias("sure"))
    unsure = stored(terms.filter("sure = 0").select("grp", "key", F.regexp_like("key", F.lit(f"^{_RUN}\\z")).alias("word")), "unsure-terms")
    held = terms.filter("sure = 1").select("grp", "key")
    texts = sampled.select("grp", F.lower("text").alias("text")).filter("text IS NOT NULL")
    for kind, look in ((F.col("word"), _in_words), (~F.col("word"), _in_texts)):
        keys = unsure.filter(kind).select("grp", "key")
        if keys.limit(1).count():
            held = held.unionByName(look(keys, texts))
    g = g.join(held, ["grp", "key"], "left_semi")
    place = F.row_number().over(Window.partitionBy("grp", "bucket").orderBy(F.desc("n"), "key"))
    return g.withColumn("place", place).filter(F.col("place") <= most).select("grp", "bucket", "form", "n", "place")


def first_of(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key, the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
