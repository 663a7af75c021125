"""Stateful operators with timers: pins of devices that go down, stalls, throttled progress with heartbeats, look-ups that expire.

State is a few values for each key, kept by Spark's state store; a key's rows of a batch come in order of their time. Timers are of event time,
so they fire when the watermark passes them, also where no further row comes; ``events.with_marker`` adds a row far ahead
that lets the watermark pass all of them where a stream is drained. What a row or a timer emits doesn't depend on how rows are cut into batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .events import MARKER, drain

#: The state store that these operators need.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Microseconds, in which all times are kept.
SECOND, MOMENT = 1_000_000, 1000


def _ordered(rows: Iterator[pd.DataFrame], columns: list[str], *by: str) -> Iterator[tuple]:
    """Tuples of some columns of a key's rows, in order. A key has few rows, so frames are taken apart at once: each step on a whole frame costs more than all of them."""
    parts = list(rows)
    held = {c: np.concatenate([p[c].to_numpy() for p in parts]) for c in {*columns, *by}}
    if "ts" in held:
        held["ts"] = held["ts"].astype("datetime64[us]").astype("int64")
    order = np.lexsort([held[c] for c in reversed(by)])
    return zip(*(held[c][order].tolist() for c in columns), strict=True)


def _frames(out: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """What a key gives as a frame, and none where it gives nothing."""
    if out:
        yield pd.DataFrame(dict(zip(columns, zip(*out, strict=True), strict=True)), copy=False)


def _ms(t: int) -> int:
    """Milliseconds since the epoch, rounded up: a timer never fires before its time."""
    return -(-t // 1000)


def stateful(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, timers: bool = True, late: str = "0 seconds") -> DataFrame:
    watched = stream.withWatermark("ts", late) if timers else stream
    return watched.groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime" if timers else "none")


def closed(out: DataFrame, key: str) -> DataFrame:
    """Run a stream to its end; rows of the marker's key are left out."""
    found = drain(out, settings=ROCKS).filter(F.col(key) != MARKER)
    return found.withColumn("at", F.timestamp_micros("at")) if "at" in found.columns else found


class Pins(StatefulProcessor):
    """Models pinned to a device: at the device's ``misses``-th miss in a row they are demoted to any device, at its next answer those go back."""

    def __init__(self, misses: int = 2):
        self.misses = misses

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.probes = handle.getValueState("probes", "missed int, down boolean")
        self.pins = handle.getMapState("pins", "model string", "stranded boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        missed, down = self.probes.get() or (0, False)
        pins = {k[0]: v[0] for k, v in self.pins.iterator()}
        out, set_ = [], dict(pins)
        for seq, model, ok in _ordered(rows, ["seq", "model", "ok"], "seq"):
            if isinstance(model, str):
                pins.setdefault(model, False)
            elif ok:
                if down:
                    out += [(key[0], seq, m, "restored", key[0]) for m, stranded in sorted(pins.items()) if stranded]
                    pins = dict.fromkeys(pins, False)
                missed, down = 0, False
            else:
                missed += 1
                if missed == self.misses and not down:
                    out += [(key[0], seq, m, "demoted", -1) for m in sorted(pins)]
                    pins, down = dict.fromkeys(pins, True), True
        self.probes.update((missed, down))
        for m, stranded in pins.items():
            if set_.get(m) != stranded:
                self.pins.updateValue((m,), (stranded,))
        yield from _frames(out, ["device", "seq", "model", "event", "pin"])

    def close(self) -> None:
        pass


def pins_stream(rows: DataFrame, misses: int = 2) -> DataFrame:
    """device, seq, model, event, pin from rows (device, seq, model, ok): a row with a model pins it, one without is a probe."""
    return stateful(rows, "device", Pins(misses), "device long, seq long, model string, event string, pin long", timers=False)


class Stalls(StatefulProcessor):
    """Tasks that don't advance: ``slow`` and ``stalled`` when their time has passed, by the next row or by a timer; ``resumed`` at the next advance."""

    LEVELS = ("slow", "stalled")

    def __init__(self, slow: float, stalled: float):
        self.after = [round(s * SECOND) for s in (slow, stalled)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "bytes double, page long, status string, advanced long, told int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if key[0] == MARKER:
            return
        state = self.state.get()
        known = state is not None
        was, page_was, status_was, advanced, told = state or (None, None, None, None, 0)
        before, out = advanced, []
        for ts, bytes_, page, status in _ordered(rows, ["ts", "bytes", "page", "status"], "ts", "event_id"):
            if not known or bytes_ > was or page > page_was or status != status_was:
                while known and told < 2 and advanced + self.after[told] < ts:
                    out.append((key[0], advanced + self.after[told], self.LEVELS[told]))
                    told += 1
                if told:
                    out.append((key[0], ts, "resumed"))
                advanced, told, known = ts, 0, True
            was, page_was, status_was = bytes_, page, status
        self.state.update((float(was), int(page_was), status_was, int(advanced), told))
        if before != advanced:
            for after in self.after:
                if before is not None:
                    self.handle.deleteTimer(_ms(before + after + MOMENT))
                self.handle.registerTimer(_ms(advanced + after + MOMENT))
        yield from _frames(out, ["task", "at", "event"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        was, page, status, advanced, told = self.state.get()
        out, now = [], expiredTimerInfo.getExpiryTimeInMs()
        while told < 2 and _ms(advanced + self.after[told] + MOMENT) <= now:
            out.append((key[0], advanced + self.after[told], self.LEVELS[told]))
            told += 1
        self.state.update((was, page, status, advanced, told))
        yield from _frames(out, ["task", "at", "event"])

    def close(self) -> None:
        pass


def stalls_stream(progress: DataFrame, slow: float = 10.0, stalled: float = 45.0, late: str = "0 seconds") -> DataFrame:
    """task, at, event of tasks (task, ts, event_id, bytes, page, status)."""
    return stateful(progress, "task", Stalls(slow, stalled), "task long, at long, event string", late=late)


class Progress(StatefulProcessor):
    """Progress that is passed on at most once in ``gap``, the last row always; a heartbeat every ``beat`` while nothing comes. After ``close``
    without a row a key is done and its state goes."""

    def __init__(self, gap: float, beat: float, close: float):
        self.gap, self.beat, self.end = (round(s * SECOND) for s in (gap, beat, close))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "sent long, last long, last_id long, pending boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if key[0] == MARKER:
            return
        sent, last, last_id, pending = self.state.get() or (None, None, None, False)
        if last is not None:
            self.handle.deleteTimer(_ms(last + self.end))
        out = []
        for ts, event_id in _ordered(rows, ["ts", "event_id"], "ts", "event_id"):
            if last is not None:
                beats = max(0, (ts - last - 1) // self.beat)
                out += [(key[0], last + (k + 1) * self.beat, last_id, "alive") for k in range(beats)]
            pending = sent is not None and ts - sent < self.gap
            if not pending:
                out.append((key[0], ts, event_id, "progress"))
                sent = ts
            last, last_id = ts, event_id
        self.state.update((int(sent), int(last), int(last_id), bool(pending)))
        self.handle.registerTimer(_ms(last + self.end))
        yield from _frames(out, ["user_id", "at", "event_id", "kind"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        _, last, last_id, pending = self.state.get()
        self.state.clear()
        out = [(key[0], last, last_id, "progress")] if pending else []
        yield from _frames(out, ["user_id", "at", "event_id", "kind"])

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, gap: float, beat: float, close: float, late: str = "0 seconds") -> DataFrame:
    """user_id, at, event_id, kind (``progress`` or ``alive``) of events (user_id, ts, event_id)."""
    return stateful(events, "user_id", Progress(gap, beat, close), "user_id long, at long, event_id long, kind string", late=late)


class Cache(StatefulProcessor):
    """Look-ups of a key: a hit where its entry was loaded less than ``ttl`` before, else a miss that loads it. A timer takes an expired entry away."""

    def __init__(self, ttl: float):
        self.ttl = round(ttl * SECOND)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.loaded = handle.getValueState("loaded", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if key[0] == MARKER:
            return
        before = (self.loaded.get() or (None,))[0]
        loaded, out = before, []
        for ts, event_id in _ordered(rows, ["ts", "event_id"], "ts", "event_id"):
            hit = loaded is not None and ts - loaded < self.ttl
            loaded = loaded if hit else ts
            out.append((key[0], event_id, hit))
        if loaded != before:
            if before is not None:
                self.handle.deleteTimer(_ms(before + self.ttl))
            self.loaded.update((int(loaded),))
            self.handle.registerTimer(_ms(loaded + self.ttl))
        yield from _frames(out, ["user_id", "event_id", "hit"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.loaded.clear()
        return iter(())

    def close(self) -> None:
        pass


def cache_stream(lookups: DataFrame, ttl: float, late: str = "0 seconds") -> DataFrame:
    """user_id, event_id, hit of look-ups (user_id, ts, event_id)."""
    return stateful(lookups, "user_id", Cache(ttl), "user_id long, event_id long, hit boolean", late=late)
