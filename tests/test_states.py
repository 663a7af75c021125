"""Stateful streams: the same rows however they are cut into batches, timers without a further row, state that goes."""

import pytest
from pyspark.sql import functions as F

from docmill.scratch import folder
from docmill.streaming import events as st
from docmill.streaming import states


def stream_of(spark, rows, schema, cuts):
    """Rows as a stream of files, one for each batch."""
    path = folder(spark, "rows")
    at = 0
    for k, cut in enumerate([*cuts, len(rows)]):
        spark.createDataFrame(rows[at:cut], schema).coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
        at = cut
    schema_ = spark.createDataFrame([], schema).schema
    return spark.readStream.schema(schema_).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


PIN = [(1, 1, "m1", None), (1, 2, None, False), (1, 3, None, True), (1, 4, None, False), (1, 5, "m2", None), (1, 6, None, False), (1, 7, "m3", None), (1, 8, None, False), (1, 9, None, True), (1, 10, None, True), (2, 1, None, False), (2, 2, None, False), (2, 3, "m1", None), (2, 4, None, True)]


@pytest.mark.parametrize("cuts", [[], [3, 6, 8, 12]])
def test_pins_are_demoted_and_restored(spark, cuts):
    s = stream_of(spark, PIN, "device long, seq long, model string, ok boolean", cuts)
    got = rows_of(st.drain(states.pins_stream(s), settings=states.ROCKS))
    assert got == sorted([(1, 6, "m1", "demoted", -1), (1, 6, "m2", "demoted", -1), (1, 9, "m1", "restored", 1), (1, 9, "m2", "restored", 1)], key=repr)


def ts(second):
    return f"2024-01-01 00:{second // 60:02d}:{second % 60:02d}"


@pytest.mark.parametrize("cuts", [[], [1, 2, 4]])
def test_stalls_fire_without_a_further_row(spark, cuts):
    rows = [(1, ts(0), 1, 0.0, 1, "run"), (1, ts(10), 2, 1.0, 1, "run"), (1, ts(25), 3, 1.0, 1, "run"), (1, ts(30), 4, 2.0, 1, "run"), (2, ts(31), 5, 0.0, 1, "run"), (-1, ts(59 * 60), 6, None, None, None)]
    s = stream_of(spark, [(a, *r) for a, *r in rows], "task long, ts string, event_id long, bytes double, page long, status string", cuts).withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r["task"], f"{r['at']:%M:%S}", r["event"]) for r in states.closed(states.stalls_stream(s), "task").collect())
    assert got == sorted([(1, "00:20", "slow"), (1, "00:30", "resumed"), (1, "00:40", "slow"), (1, "01:15", "stalled"), (2, "00:41", "slow"), (2, "01:16", "stalled")])


@pytest.mark.parametrize("cuts", [[], [2, 3]])
def test_progress_and_heartbeats(spark, cuts):
    rows = [(1, ts(0), 1), (1, ts(1), 2), (1, ts(7), 3), (1, ts(8), 4), (-1, ts(50 * 60), 5)]
    s = stream_of(spark, rows, "user_id long, ts string, event_id long", cuts).withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((f"{r['at']:%M:%S}", r["event_id"], r["kind"]) for r in states.closed(states.progress_stream(s, 5, 2, 600), "user_id").collect())
    assert got == [("00:00", 1, "progress"), ("00:03", 2, "alive"), ("00:05", 2, "alive"), ("00:07", 3, "progress"), ("00:08", 4, "progress")]


def test_expired_entries_leave_the_state(spark):
    rows = [(u, ts(s), 100 * u + s) for u in range(5) for s in (0, 3, 9, 12)] + [(-1, ts(59 * 60), 0)]
    s = stream_of(spark, rows, "user_id long, ts string, event_id long", []).withColumn("ts", F.col("ts").cast("timestamp"))
    events = st.Events()
    spark.streams.addListener(events)
    try:
        heard = []
        events.onQueryProgress = lambda e: heard.append((e.progress.batchId, [o.numRowsTotal for o in e.progress.stateOperators]))
        got = {(r["user_id"], r["event_id"] % 100): r["hit"] for r in states.closed(states.cache_stream(s, 8), "user_id").collect()}
    finally:
        import time

        time.sleep(2)
        spark.streams.removeListener(events)
    assert got == {(u, s): hit for u in range(5) for s, hit in ((0, False), (3, True), (9, False), (12, True))}
    totals = [n[0] for _, n in sorted(heard) if n]
    assert totals[0] >= 5 and totals[-1] == 0


def test_a_listener_hears_rows_errors_and_batches(spark):
    rows = [(i, i % 4 == 0) for i in range(30)]
    s = stream_of(spark, rows, "id long, bad boolean", [10, 25])
    heard = st.observed(s, "seen", F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("errors"))
    got = sorted((r["batch"], r["n"], r["errors"]) for r in heard.select("batch", *[F.get_json_object("detail", f"$.seen.{c}").cast("long").alias(c) for c in ("n", "errors")]).collect())
    assert sum(n for _, n, _ in got) == 30 and sum(e for *_, e in got) == 8 and len(got) == 3


def test_a_key_costs_no_frames_beyond_its_rows():
    import pandas as pd

    parts = [pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:00:02", "2024-01-01 00:00:01"]), "event_id": [1, 2]}), pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:00:01"]), "event_id": [0]})]
    second = 1704067200 * 1_000_000
    assert list(states._ordered(iter(parts), ["ts", "event_id"], "ts", "event_id")) == [(second + 1_000_000, 0), (second + 1_000_000, 2), (second + 2_000_000, 1)]
    assert list(states._frames([], ["user_id"])) == []
    assert [list(f.itertuples(index=False, name=None)) for f in states._frames([(1, True), (2, False)], ["user_id", "hit"])] == [[(1, True), (2, False)]]


def test_a_look_up_asks_the_state_once():
    class Loaded:
        asked = 0

        def get(self):
            self.asked += 1

        def exists(self):
            self.asked += 1
            return False

        def update(self, value):
            pass

    import pandas as pd

    cache = states.Cache(8)
    cache.loaded, cache.handle = Loaded(), type("Handle", (), {"registerTimer": lambda self, at: None})()
    rows = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01"]), "event_id": [5]})
    assert [list(f.itertuples(index=False, name=None)) for f in cache.handleInputRows((1,), iter([rows]), None)] == [[(1, 5, False)]]
    assert cache.loaded.asked == 1
