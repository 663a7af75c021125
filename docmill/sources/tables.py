"""Tables of a data folder, and the views of them that retrieval works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in a fixed window, and words that neighbours share.
WINDOW, OVERLAP = 220, 30


#: Bytes of a table between which its rows are dealt out where it has fewer files than there are cores.
DEAL = (4 << 20, 64 << 20)


def dealt(df: DataFrame) -> DataFrame:
    """A small table of long texts in as many partitions as there are cores. One small file is one row group and so one task, whatever its
    work; a table of any size has a task for each block and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not DEAL[0] <= size <= DEAL[1] or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; its time columns become timestamps in the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = dealt(df) if name in ("documents", "pages") else df
    return df.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in df.dtypes])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: file_id, path, sha256, bytes."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("bytes"))


def chunks(spark: SparkSession, sf_dir: str, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """documents as fixed word windows: file_id, source, ord, text. Per row, no shuffle."""
    from docmill.operators.chunking import fixed_windows

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "source", "text")
    return fixed_windows(d, "text", window, overlap)
