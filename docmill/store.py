"""Versioned tables in a shared folder: a log of commits, each of which adds rows and takes keys away.

``rows/<name>/part=<token>`` holds the Parquet files that a commit added to a table, ``gone/<token>`` the keys that it took away from what was there
before, ``log/<number>.json`` says which tokens belong to it. A commit writes its files under new names first and appears with its log entry,
which is renamed into place only if there is none of that number; files of a commit that didn't get there are never read. So what a
commit writes grows with its change, a reader sees whole commits, and of two writers of one number the second one fails.

A row lives unless a later commit took its key away. Readers drop the others by an anti join with the keys, which are broadcast if the log
counts few of them. ``compact`` writes the living rows as one commit that replaces all earlier ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys taken away up to which they are broadcast (some 16 MB).
BROADCAST_KEYS = 500_000
#: Commits after which a writer compacts.
MOST_COMMITS = 24


class Conflict(Exception):
    """Another writer has made this commit."""


class Store:
    """Tables (name: schema) whose rows bear a key; ``by`` names a column that a table's files are laid out by. Where that column has at most ``folders``
    values, a task keeps a file open for each and needs no sort, which would spill; with 0, or more values, it sorts its rows."""

    def __init__(self, spark: SparkSession, path: str, key: str, key_type: str, tables: dict[str, str], by: dict[str, str] | None = None, folders: int = 0, codec: str = "snappy"):
        self.codec = "zstd" if by else codec
        self.spark, self.path, self.key, self.key_type, self.tables, self.by, self.folders = spark, path.rstrip("/"), key, key_type, tables, by or {}, folders

    # Files of the log, by Hadoop's file systems, so that the folder can be in any store that Spark writes to.

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _files(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, name: str) -> str:
        fs, p = self._fs(f"{self.path}/log/{name}")
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _publish(self, number: int, entry: dict) -> None:
        jvm = self.spark._jvm
        fs, temporary = self._fs(f"{self.path}/log/.{uuid.uuid4().hex}")
        stream = fs.create(temporary, False)
        stream.write(json.dumps(entry).encode())
        stream.close()
        final = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{number:08d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(temporary, final, self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as failed:
            fs.delete(temporary, False)
            if fs.exists(final):
                raise Conflict(f"commit {number} of {self.path}") from failed
            raise

    def log(self) -> list[dict]:
        """The commits that count, in order: those since the last one that replaced all before it."""
        entries = [json.loads(self._read(name)) | {"number": int(name[:-5])} for name in self._files("log") if name.endswith(".json") and not name.startswith(".")]
        whole = max((k for k, e in enumerate(entries) if e.get("replaces")), default=0)
        return entries[whole:]

    def exists(self) -> bool:
        return bool(self.log())

    def note(self) -> dict:
        """What the last commit noted."""
        log = self.log()
        return log[-1]["note"] if log else {}

    def _write(self, name: str, df: DataFrame, path: str) -> None:
        if name not in self.by:
            return df.write.option("compression", self.codec).parquet(path)
        writers, before = "spark.sql.maxConcurrentOutputFileWriters", self.spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
        self.spark.conf.set(writers, str(self.folders + 1 if self.folders else before))  # as many open files as are allowed make a task sort
        try:
            df.write.option("compression", self.codec).partitionBy(self.by[name]).parquet(path)
        finally:
            self.spark.conf.set(writers, before)

    def _moved(self, source: str, target: str) -> bool:
        """Whether there was a folder to give another name."""
        fs, p = self._fs(source)
        if not fs.exists(p):
            return False
        to = self.spark._jvm.org.apache.hadoop.fs.Path(target)
        fs.mkdirs(to.getParent())
        if not fs.rename(p, to):
            raise OSError(f"{source} can't become {target}")
        return True

    def commit(self, add: dict[str, DataFrame], gone: DataFrame | None, note: Callable[[], dict] | dict, replaces: bool = False, aside: dict[str, tuple[str, object]] | None = None, counted: Callable[[dict[str, DataFrame]], dict] | None = None) -> int:
        """Add rows to tables and take the keys ``gone`` away from all earlier commits; the number of the commit. ``note`` may be a function that
        is called once the rows are written; ``counted`` is called with the tables' new rows then and adds to it. ``aside`` (table: another table, a
        value) gives the rows that are laid out in a table's folder of that value to the other one, so both are written in one pass."""
        log = self.log()
        number = log[-1]["number"] + 1 if log else 0
        entry: dict = {"rows": {}, "replaces": replaces or not log}
        for name, df in add.items():
            token = uuid.uuid4().hex
            self._write(name, df.withColumn("at", F.lit(number)), f"{self.path}/rows/{name}/part={token}")
            entry["rows"][name] = token
            for other, value in [aside[name]] if aside and name in aside else []:
                if self._moved(f"{self.path}/rows/{name}/part={token}/{self.by[name]}={value}", f"{self.path}/rows/{other}/part={token}"):
                    entry["rows"][other] = token
        if gone is not None and log:
            token = uuid.uuid4().hex
            gone.select(F.col(self.key).cast(self.key_type)).distinct().withColumn("at", F.lit(number)).write.parquet(f"{self.path}/gone/{token}")
            entry |= {"gone": token, "n_gone": self.spark.read.parquet(f"{self.path}/gone/{token}").count()}
        entry["note"] = note() if callable(note) else note
        if counted is not None:
            entry["note"] |= counted({name: self.spark.read.schema(self.tables[name]).parquet(f"{self.path}/rows/{name}/part={token}") for name, token in entry["rows"].items()})
        self._publish(number, entry)
        return number

    def rows(self, name: str, where: Column | None = None) -> DataFrame:
        """The living rows of a table; ``where`` reaches the scan."""
        log, schema = self.log(), self.tables[name]
        root = f"{self.path}/rows/{name}"
        folders = [f"{root}/part={e['rows'][name]}" for e in log if name in e["rows"]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(f"{schema}, at int, part string").option("basePath", root).parquet(*folders).drop("part")
        found = found if where is None else found.filter(where)
        lost = [e for e in log if "gone" in e]
        if not lost:
            return found.drop("at")
        keys = self.spark.read.schema(f"{self.key} {self.key_type}, at int").parquet(*[f"{self.path}/gone/{e['gone']}" for e in lost])
        keys = keys.groupBy(F.col(self.key).alias("gone_key")).agg(F.max("at").alias("gone_at"))
        keys = F.broadcast(keys) if sum(e["n_gone"] for e in lost) <= BROADCAST_KEYS else keys
        return found.join(keys, (F.col(self.key) == F.col("gone_key")) & (F.col("at") < F.col("gone_at")), "left_anti").drop("at")

    def compact(self) -> int:
        """All living rows as one commit; files that nothing names any more are deleted."""
        number = self.commit({name: self.rows(name) for name in self.tables}, None, self.note(), replaces=True)
        live = {token for e in self.log() for token in [*e["rows"].values(), e.get("gone")]}
        for folder in [*[f"rows/{name}" for name in self.tables], "gone"]:
            for token in self._files(folder):
                if token.removeprefix("part=") not in live:
                    fs, p = self._fs(f"{self.path}/{folder}/{token}")
                    fs.delete(p, True)
        return number

    def compact_if_long(self, most: int = MOST_COMMITS) -> None:
        if len(self.log()) > most:
            self.compact()

    def drop(self) -> None:
        fs, p = self._fs(self.path)
        fs.delete(p, True)
