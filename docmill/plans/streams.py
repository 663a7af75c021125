"""Streaming queries; each runs over what there is and equals its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.sources.tables import table
from docmill.streaming import events as st
from docmill.streaming import states

from .registry import query
from .services import CHAIN


def _stream(spark, d, name="events"):
    """The table as a stream: a single file is watched through its folder."""
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    single = spark.read.parquet(path).select(F.input_file_name().alias("f")).limit(1).collect()
    folder, glob = (d, f"{name}.parquet") if single and single[0]["f"].endswith(f"/{name}.parquet") else (path, "*.parquet")
    df = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return df.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in df.dtypes])


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS win_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    """Days, each written once when the watermark has passed it."""
    out = st.drain(st.windowed(st.with_marker(_stream(spark, d), "user_id"), "1 day"))
    return out.select("win_start", "event_type", "n", F.round("total", 6).alias("total"))


@query("stream_sliding", """WITH e AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS win_start FROM events)
SELECT win_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM e GROUP BY ALL""")
def stream_sliding(spark, d):
    out = st.drain(st.windowed(st.with_marker(_stream(spark, d), "user_id"), "12 hours", "6 hours"))
    return out.select("win_start", "event_type", "n", F.round("total", 6).alias("total"))


@query("session_windows", """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events), s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, run""")
def session_windows(spark, d):
    return st.sessions(table(spark, d, "events"), "30 minutes")


@query("session_stream", """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events), s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM l),
m AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, run) SELECT * FROM m""")
def session_stream(spark, d):
    """The same sessions from a stream; a marker event far ahead lets the watermark close the last ones."""
    return st.drain(st.sessions(st.with_marker(_stream(spark, d).select("user_id", "ts"), "user_id"), "30 minutes"))


@query("label_segments", """WITH l AS (SELECT user_id, event_id, ts, event_type AS label, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), s AS (SELECT *, sum(CASE WHEN label IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM l),
g AS (SELECT user_id, run, label, min(ts) AS start, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, label, start, lead(start) OVER (PARTITION BY user_id ORDER BY run) AS stop, n FROM g""")
def label_segments(spark, d):
    """Intervals between changes of a label: each ends where the next one begins."""
    return st.segments(table(spark, d, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("label")))


@query("stream_dedup", "SELECT user_id, event_type, count(DISTINCT date_trunc('hour', ts)) AS hours FROM events GROUP BY ALL")
def stream_dedup(spark, d):
    """Events of one kind, user and hour once: state is kept for as long as the watermark allows."""
    s = _stream(spark, d).withColumn("hour", F.date_trunc("hour", "ts"))
    out = st.drain(st.unique(s, ["user_id", "event_type", "hour"], "40 days").select("user_id", "event_type", "hour"))
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("hours"))


@query("stream_static_join", "SELECT c.c_mktsegment AS segment, count(*) AS n, round(sum(e.value), 6) AS total FROM events e JOIN customer c ON c.c_custkey = e.user_id GROUP BY 1")
def stream_static_join(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    joined = _stream(spark, d).join(c, "user_id").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return st.drain(joined, "complete").select("segment", "n", F.round("total", 6).alias("total"))


HEALTH = """WITH p AS (SELECT user_id AS device, event_id AS seq, value > 40 AS ok FROM events), l AS (SELECT *, lag(ok) OVER (PARTITION BY device ORDER BY seq) AS prev FROM p),
r AS (SELECT *, sum(CASE WHEN ok IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (PARTITION BY device ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY device, run ORDER BY seq) AS k, count(*) OVER (PARTITION BY device, run) AS size FROM r),
m AS (SELECT *, lag(size) OVER (PARTITION BY device ORDER BY seq) AS last_size, lag(ok) OVER (PARTITION BY device ORDER BY seq) AS last_ok FROM k)
SELECT device, seq, CASE WHEN NOT ok THEN 'down' ELSE 'back' END AS event FROM m WHERE (NOT ok AND k = 2) OR (ok AND k = 1 AND NOT last_ok AND last_size >= 2)"""


#: Every tenth event pins a model to the device, the others are probes.
PINS = HEALTH.replace("FROM events)", "FROM events WHERE event_id % 10 <> 0)", 1).replace("\nSELECT device, seq, CASE", ",\nh AS (SELECT device, seq, CASE", 1) + """),
pin AS (SELECT user_id AS device, 'm' || ((event_id // 10) % 7) AS model, min(event_id) AS since FROM events WHERE event_id % 10 = 0 GROUP BY ALL),
o AS (SELECT *, lag(seq) OVER (PARTITION BY device ORDER BY seq) AS down_at FROM h)
SELECT o.device, o.seq, pin.model, CASE event WHEN 'down' THEN 'demoted' ELSE 'restored' END AS event, CASE event WHEN 'down' THEN -1 ELSE o.device END AS pin
FROM o JOIN pin ON pin.device = o.device AND pin.since < CASE event WHEN 'down' THEN o.seq ELSE o.down_at END"""


@query("pins_stream", PINS)
def pins_stream(spark, d):
    """Models that are demoted when their device goes down and go back to it when it answers again; kept as state."""
    e = _stream(spark, d)
    model = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("m"), (F.floor(F.col("event_id") / 10) % 7).cast("string")))
    return st.drain(states.pins_stream(e.select(F.col("user_id").alias("device"), F.col("event_id").alias("seq"), model.alias("model"), (F.col("value") > 40).alias("ok"))), settings=states.ROCKS)


@query("health_debounce", HEALTH)
def health_debounce(spark, d):
    return st.health(table(spark, d, "events").select(F.col("user_id").alias("device"), F.col("event_id").alias("seq"), (F.col("value") > 40).alias("ok")))


@query("health_debounce_stream", HEALTH)
def health_debounce_stream(spark, d):
    p = _stream(spark, d).select(F.col("user_id").alias("device"), F.col("event_id").alias("seq"), (F.col("value") > 40).alias("ok"))
    return st.drain(st.health_stream(p))


@query("stall_severity", """WITH p AS (SELECT user_id AS task, ts, event_id, floor(value / 50) AS bytes, event_id // 1000 AS page, event_type AS status FROM events),
a AS (SELECT *, lag(bytes) OVER w IS NULL OR bytes > lag(bytes) OVER w OR page > lag(page) OVER w OR status <> lag(status) OVER w AS advanced FROM p WINDOW w AS (PARTITION BY task ORDER BY ts, event_id)),
i AS (SELECT *, (epoch_us(ts) - epoch_us(max(CASE WHEN advanced THEN ts END) OVER (PARTITION BY task ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))) / 1e6 AS idle FROM a)
, v AS (SELECT *, CASE WHEN idle >= 45 THEN 'stalled' WHEN idle >= 10 THEN 'slow' ELSE 'ok' END AS severity FROM i)
SELECT task, event_id, round(idle, 6) AS idle, severity, severity = 'ok' AND coalesce(lag(severity) OVER (PARTITION BY task ORDER BY ts, event_id), 'ok') <> 'ok' AS resumed FROM v""")
def stall_severity(spark, d):
    p = table(spark, d, "events").select(F.col("user_id").alias("task"), "ts", "event_id", F.floor(F.col("value") / 50).alias("bytes"), F.floor(F.col("event_id") / 1000).alias("page"), F.col("event_type").alias("status"))
    return st.stalls(p).select("task", "event_id", F.round("idle", 6).alias("idle"), "severity", "resumed")


STALLS = """WITH p AS (SELECT user_id AS task, ts, event_id, floor(value / 50) AS bytes, event_id // 1000 AS page, event_type AS status FROM events),
a AS (SELECT *, lag(bytes) OVER w IS NULL OR bytes > lag(bytes) OVER w OR page > lag(page) OVER w OR status <> lag(status) OVER w AS advanced FROM p WINDOW w AS (PARTITION BY task ORDER BY ts, event_id)),
g AS (SELECT task, ts, lead(ts) OVER (PARTITION BY task ORDER BY ts, event_id) AS next FROM a WHERE advanced)
SELECT task, ts + INTERVAL 10 SECOND AS at, 'slow' AS event FROM g WHERE next IS NULL OR next > ts + INTERVAL 10 SECOND
UNION ALL SELECT task, ts + INTERVAL 45 SECOND, 'stalled' FROM g WHERE next IS NULL OR next > ts + INTERVAL 45 SECOND
UNION ALL SELECT task, next, 'resumed' FROM g WHERE next > ts + INTERVAL 10 SECOND"""


def _progress(e):
    return e.select(F.col("user_id").alias("task"), "ts", "event_id", F.floor(F.col("value") / 50).cast("double").alias("bytes"), F.floor(F.col("event_id") / 1000).alias("page"), F.col("event_type").alias("status"))


@query("stall_events", STALLS)
def stall_events(spark, d):
    """When each task became slow, stalled and went on, whether or not an event came at that time."""
    return st.stall_events(_progress(table(spark, d, "events")))


@query("stall_stream", STALLS)
def stall_stream(spark, d):
    """The same from a stream: timers tell of tasks of which no event comes any more."""
    return states.closed(states.stalls_stream(st.with_marker(_progress(_stream(spark, d)), "task")), "task")


BEATS = """, sent AS (SELECT key AS user_id, tm, event_id, 'progress' AS kind FROM r WHERE flag OR n = cnt),
gaps AS (SELECT user_id, event_id, epoch_us(ts) AS tm, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS next FROM events),
beats AS (SELECT user_id, tm + 86400000000 * unnest(range(1, 1 + greatest(0, (next - tm - 1) // 86400000000))) AS tm, event_id, 'alive' AS kind FROM gaps WHERE next IS NOT NULL)
SELECT user_id, make_timestamp(tm) AS at, event_id, kind FROM (SELECT * FROM sent UNION ALL SELECT * FROM beats)"""


@query("progress_stream", CHAIN.format(first="true", gap="21600000000", sent="true").rstrip() + BEATS)
def progress_stream(spark, d):
    """Progress at most every six hours and always the last, with a sign of life for every day without any; kept as state with timers."""
    e = st.with_marker(_stream(spark, d).select("user_id", "ts", "event_id"), "user_id")
    return states.closed(states.progress_stream(e, 6 * 3600, 24 * 3600, 3650 * 24 * 3600), "user_id")


@query("cache_stream", CHAIN.format(first="false", gap="14400000000", sent="false") + "SELECT key AS user_id, event_id, flag AS hit FROM r")
def cache_stream(spark, d):
    """Look-ups by key against entries that live four hours and then leave the state."""
    e = st.with_marker(_stream(spark, d).select("user_id", "ts", "event_id"), "user_id")
    return states.closed(states.cache_stream(e, 4 * 3600), "user_id")


@query("recovery_state", "SELECT user_id, event_type, arg_max(value, [epoch_us(ts), event_id]) AS last_value, count(*) AS updates FROM events GROUP BY ALL")
def recovery_state(spark, d):
    """The latest state of each key, kept by a stream."""
    latest = _stream(spark, d).groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), F.count(F.lit(1)).alias("updates"))
    return st.drain(latest, "complete")


def _scanned(docs):
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("bytes"))


@query("stream_ingest", "SELECT source || '/' || doc_id AS path, sha256(text) AS sha256, n_chars AS bytes FROM documents")
def stream_ingest(spark, d):
    """A watched folder: every batch of files is compared with the stored listing, and what is new or changed is committed to it."""
    path = st.scratch(spark)
    store = st.listing(spark, f"{path}/listing")
    stale = _scanned(table(spark, d, "documents").filter("doc_id % 3 = 0")).withColumn("sha256", F.when(F.split("path", "/")[1].cast("long") % 2 == 0, "stale").otherwise(F.col("sha256")))
    store.commit({"files": stale}, None, {})
    st.watch(_scanned(_stream(spark, d, "documents")), store, f"{path}/state")
    return store.rows("files")


@query("ingest_events", "SELECT CAST(0 AS BIGINT) AS batch, count(*) AS seen, count(*) FILTER (doc_id % 17 = 0) AS errors, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents")
def ingest_events(spark, d):
    """What a listener hears of a stream of files: rows, errors and bytes of each batch."""
    docs = _stream(spark, d, "documents")
    metrics = (F.count(F.lit(1)).alias("seen"), F.count_if(F.col("doc_id") % 17 == 0).alias("errors"), F.sum("n_chars").alias("bytes"))
    heard = st.observed(docs, "ingest", *metrics)
    of = lambda name: F.get_json_object("detail", f"$.ingest.{name}").cast("long").alias(name)
    return heard.select("batch", of("seen"), of("errors"), of("bytes"))
