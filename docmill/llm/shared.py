"""Storage, splitting and small column helpers that the operators of this subpackage share."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.scratch import folder
from docmill.sources.tables import dealt

#: White space of all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WS_CLASS = r"\x20\x09-\x0D"
WORD_RE = rf"[^{WS_CLASS}]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents; a small single file is dealt to all cores."""
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stashed table that nothing reads any more. Tables that a result still reads stay until the folder is emptied."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df.stash_path)
    path.getFileSystem(conf).delete(path, True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names for helper columns that no column in ``taken`` bears."""
    low = {c.lower() for c in taken}
    return [next(c for c in (f"{n}_{k}" for k in itertools.count()) if c.lower() not in low) for n in names]


def keep_rows(docs: DataFrame, id_col: str, ids: DataFrame, winners: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` that ``winners`` (id, key) name, columns unchanged. ``ids`` (id) has the id of every row of ``docs``; ``key`` tells the
    rows of one id apart, and of rows that agree in both, one stays. Ids are of any type and may be missing."""
    t_id, t_key, t_own = fresh(docs.columns, "id", "key", "own")
    repeated = stash(ids.groupBy("id").count().filter("count > 1").select(F.col("id").alias("twice")), "repeated-ids")
    if not repeated.limit(1).count():
        names = winners.select(F.col("id").alias(t_id))
        return docs.join(names, docs[id_col].eqNullSafe(names[t_id]), "left_semi")
    of = F.col("id").eqNullSafe(F.col("twice"))
    alone = winners.join(repeated, of, "left_anti").select(F.col("id").alias(t_id))
    several = winners.join(repeated, of, "left_semi").select(F.col("id").alias(t_id), F.col("key").alias(t_key))
    left = docs.join(alone, docs[id_col].eqNullSafe(alone[t_id]), "left_semi")
    rest = docs.withColumn(t_own, key).join(several, docs[id_col].eqNullSafe(several[t_id]) & (F.col(t_own) == F.col(t_key)))
    return left.unionByName(rest.dropDuplicates([id_col, t_key]).select(*docs.columns))


def text_of(col: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``: the word starts, without building the words."""
    return F.regexp_count(text, F.lit(WORD_RE)).cast("long")
