"""Tables and folders between steps, in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder, but only if driver and executors are one process: on a
    cluster each machine would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "docmill-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_marked: set[str] = set()


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder. It is deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/docmill-{spark.sparkContext.applicationId}"
    if path not in _marked:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _marked.add(path)
    return path


def folder(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(spark: SparkSession, name: str) -> str:
    """The folder of what is kept beyond a query, as indexes: below ``spark.docmill.index.dir`` where that is set, for as long as its owner
    keeps it; else for this application alone."""
    root = spark.conf.get("spark.docmill.index.dir", None) or f"{run_dir(spark)}/kept"
    return f"{root.rstrip('/')}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, lineage cut, survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a ``stored`` table that nothing reads any more."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
