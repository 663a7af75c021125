"""Streaming operators over event tables: windows, sessions, dedup, joins, debounced health, stalls."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from docmill.scratch import folder, stored
from docmill.store import Store


#: Key and time of the row that closes a stream that is drained: the watermark passes all that is open.
MARKER, FAR = -1, "2200-01-01 00:00:00"


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return folder(spark, "stream")


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream of its files, time columns as timestamps."""
    schema = spark.read.parquet(path).schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)
    return df.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in df.dtypes])


def drain(stream: DataFrame, mode: str = "append", settings: dict[str, str] | None = None) -> DataFrame:
    """Run a stream over what there is now; its output as a table. Sink and progress are in the shared folder; ``settings`` hold while it starts."""
    spark = stream.sparkSession
    path = scratch(spark)
    schema = stream.schema
    was = {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
        if mode == "append":
            q = writer.format("parquet").option("path", f"{path}/out").start()
        else:
            q = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")).start()
        q.awaitTermination()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(schema).parquet(f"{path}/out")


def with_marker(stream: DataFrame, key: str) -> DataFrame:
    """The stream with a row of the marker's key at a time (``ts``) far ahead; its other columns are null."""
    spark = stream.sparkSession
    row = spark.range(1).select(*[F.lit(MARKER).cast(t).alias(c) if c == key else F.lit(FAR).cast(t).alias(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in stream.dtypes])
    path = folder(spark, "marker")
    row.write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """win_start, event_type, n, total of tumbling or sliding event-time windows, rows later than ``late`` dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("win_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """user_id, start, stop, n of sessions that a pause of ``gap`` ends."""
    s = F.session_window("ts", gap).alias("s")
    return events.withWatermark("ts", late).groupBy("user_id", s).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


def unique(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def health(probes: DataFrame, misses: int = 2) -> DataFrame:
    """device, seq, event: ``down`` at the second miss in a row, ``back`` at the first answer after it. Batch twin of ``health_stream``.

    A run of misses is down once it is ``misses`` long; what follows it is back."""
    w = Window.partitionBy("device").orderBy("seq")
    runs = probes.withColumn("run", F.sum(F.when(F.lag("ok").over(w).eqNullSafe(F.col("ok")), 0).otherwise(1)).over(w))
    k = F.row_number().over(Window.partitionBy("device", "run").orderBy("seq"))
    size = F.count(F.lit(1)).over(Window.partitionBy("device", "run"))
    marked = runs.withColumn("k", k).withColumn("size", size).withColumn("last_size", F.lag("size").over(w)).withColumn("last_ok", F.lag("ok").over(w))
    event = F.when(~F.col("ok") & (F.col("k") == misses), "down").when(F.col("ok") & (F.col("k") == 1) & ~F.col("last_ok") & (F.col("last_size") >= misses), "back")
    return marked.withColumn("event", event).filter("event IS NOT NULL").select("device", "seq", "event")


def health_stream(probes: DataFrame, misses: int = 2) -> DataFrame:
    """The same as a stateful operator: misses in a row and whether the device is down, for each device."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        missed, down = state.get if state.exists else (0, False)
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, ok in zip(rows["seq"], rows["ok"], strict=True):
            if ok:
                if down:
                    out.append((key[0], seq, "back"))
                missed, down = 0, False
            else:
                missed += 1
                if missed == misses and not down:
                    out.append((key[0], seq, "down"))
                    down = True
        state.update((missed, down))
        yield pd.DataFrame(out, columns=["device", "seq", "event"])

    return probes.groupBy("device").applyInPandasWithState(step, "device long, seq long, event string", "missed int, down boolean", "append", "NoTimeout")


def stalls(progress: DataFrame, slow: float = 10.0, stalled: float = 45.0) -> DataFrame:
    """Rows (task, ts, bytes, page, status) with the seconds since the task last advanced, how bad that is, and whether it has resumed."""
    w = Window.partitionBy("task").orderBy("ts", "event_id")
    advanced = F.lag("bytes").over(w).isNull() | (F.col("bytes") > F.lag("bytes").over(w)) | (F.col("page") > F.lag("page").over(w)) | (F.col("status") != F.lag("status").over(w))
    last = F.max(F.when(F.col("advanced"), F.col("ts"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = progress.withColumn("advanced", advanced).withColumn("idle", (F.unix_micros("ts") - F.unix_micros(last)) / 1e6)
    severity = F.when(F.col("idle") >= stalled, "stalled").when(F.col("idle") >= slow, "slow").otherwise("ok")
    last_severity = F.coalesce(F.lag("severity").over(w), F.lit("ok"))
    return marked.withColumn("severity", severity).withColumn("resumed", (F.col("severity") == "ok") & (last_severity != "ok"))


def stall_events(progress: DataFrame, slow: int = 10, stalled: int = 45) -> DataFrame:
    """task, at, event: when tasks became slow, stalled and went on. Batch twin of ``states.stalls_stream``."""
    w = Window.partitionBy("task").orderBy("ts", "event_id")
    advanced = F.lag("bytes").over(w).isNull() | (F.col("bytes") > F.lag("bytes").over(w)) | (F.col("page") > F.lag("page").over(w)) | (F.col("status") != F.lag("status").over(w))
    steps = progress.withColumn("advanced", advanced).filter("advanced").withColumn("next", F.lead("ts").over(w))
    late = lambda s: F.col("next").isNull() | (F.col("next") > F.col("ts") + F.expr(f"INTERVAL {s} SECOND"))
    told = [F.when(late(s), F.struct((F.col("ts") + F.expr(f"INTERVAL {s} SECOND")).alias("at"), F.lit(name).alias("event"))) for s, name in ((slow, "slow"), (stalled, "stalled"))]
    told.append(F.when(F.col("next").isNotNull() & late(slow), F.struct(F.col("next").alias("at"), F.lit("resumed").alias("event"))))
    return steps.select("task", F.explode(F.array_compact(F.array(*told))).alias("e")).select("task", "e.at", "e.event")


def segments(events: DataFrame) -> DataFrame:
    """user_id, label, start, stop, n of intervals between changes of a label (user_id, event_id, ts, label); the last one is open."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    changed = events.withColumn("first", ~F.col("label").eqNullSafe(F.lag("label").over(w)) | (F.row_number().over(w) == 1))
    runs = changed.withColumn("run", F.sum(F.col("first").cast("int")).over(w))
    each = runs.groupBy("user_id", "run", "label").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"))
    return each.withColumn("stop", F.lead("start").over(Window.partitionBy("user_id").orderBy("run"))).select("user_id", "label", "start", "stop", "n")


def watch(files: DataFrame, store: Store, state: str) -> None:
    """Bring a listing (files: path, sha256, bytes) up to date with a stream of files: each batch commits what is new or changed, and nothing where
    nothing is. ``state`` keeps the stream's progress, so a run that was stopped goes on where it was; the commit bears the batch's number, so a
    batch that is handed over again isn't committed twice."""
    from docmill.operators.ingest import diff

    def apply(batch: DataFrame, number: int) -> None:
        if store.note().get("batch", -1) >= number:
            return
        scan = stored(batch, "scanned")
        known = store.rows("files").join(scan.select("path"), "path", "left_semi")
        todo = stored(diff(known, scan).filter("state IN ('new', 'changed')").select("path"), "changed-paths")
        if not todo.limit(1).count():
            return
        store.commit({"files": scan.join(todo, "path", "left_semi").select("path", "sha256", "bytes")}, todo, {"batch": number})
        store.compact_if_long()

    files.writeStream.foreachBatch(apply).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def listing(spark: SparkSession, path: str) -> Store:
    """A listing of files as a store."""
    return Store(spark, path, "path", "string", {"files": "path string, sha256 string, bytes long"})


class Events(StreamingQueryListener):
    """What happens to streams, as rows: started, progress (with the metrics that the stream observes), terminated."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, int, str]] = []
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.rows.append((str(event.runId), "started", -1, "{}"))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((str(p.runId), "progress", p.batchId, json.dumps({"rows": p.numInputRows} | {name: row.asDict() for name, row in p.observedMetrics.items()})))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.rows.append((str(event.runId), "terminated", -1, json.dumps({"error": event.exception})))
        self.ended.add(str(event.runId))

    def table(self, spark: SparkSession) -> DataFrame:
        """run, kind, batch, detail (JSON)."""
        return spark.createDataFrame(self.rows, "run string, kind string, batch long, detail string")


def observed(stream: DataFrame, name: str, *metrics, wait: float = 30.0) -> DataFrame:
    """Run a stream to its end under a listener: batch and its metrics, of batches that had rows. A batch's metrics are made as its rows pass."""
    spark = stream.sparkSession
    events = Events()
    spark.streams.addListener(events)
    try:
        seen = stream.observe(name, *metrics)
        q = seen.writeStream.format("noop").option("checkpointLocation", f"{scratch(spark)}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        end = time.monotonic() + wait  # the listener hears of it a little later
        while str(q.runId) not in events.ended and time.monotonic() < end:
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(events)
    return events.table(spark).filter("kind = 'progress' AND CAST(get_json_object(detail, '$.rows') AS LONG) > 0")
