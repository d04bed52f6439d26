"""Telemetry: events of the library, summaries by window, and where both are appended."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemill.functions.terms import normalize_term

PREFIX = "tidemill"
# The events there are.
EVENTS = tuple((PREFIX, *e.split(".")) for e in ("cdc.event", "cdc.connection", "cdc.lag", "cdc.backpressure", "batch.flushed", "batch.processed", "append_stream.batch_queue", "append_stream.batch_dropped", "service.ack_checkpoint_lag"))
Emit = Callable[[tuple[str, ...], Mapping[str, Any], Mapping[str, Any]], Any]


def quiet(event: tuple[str, ...], measurements: Mapping[str, Any], metadata: Mapping[str, Any]) -> None:
    """Where nobody listens."""
GROUP = ("event", "status", "source", "table_schema", "table_name")
DEBOUNCE_MS, MAX_WINDOW_MS, SUPPRESS_MS, DEPTH, ITEMS = 2_000, 30_000, 1_000, 4, 100


def valid_event(name: Any) -> bool:
    return isinstance(name, (list, tuple)) and bool(name) and all(isinstance(p, str) and p for p in name)


def table_metadata(metadata: Mapping[str, Any]) -> dict[str, Any]:
    """Metadata with a (schema, table) pair as two fields."""
    out = dict(metadata)
    if isinstance(out.get("table"), (list, tuple)) and len(out["table"]) == 2:
        out["table_schema"], out["table_name"] = out.pop("table")
    return out


class Forwarder:
    """Takes events and appends raw rows, or one summary for each group at the end of a window.

    All groups share a window: it ends `debounce_ms` after the last event, `max_window_ms` after the
    first, or by hand. For `suppress_ms` after a flush the library's own events are ignored, else
    appending a summary would be summarised for ever.
    """

    def __init__(self, append: Callable[[dict[str, Any]], Any], events: Iterable[tuple[str, ...]] = (), mode: str = "summary", debounce_ms: int = DEBOUNCE_MS, max_window_ms: int = MAX_WINDOW_MS, suppress_ms: int = SUPPRESS_MS, depth: int = DEPTH, items: int = ITEMS) -> None:
        if mode not in ("raw", "summary"):
            raise ValueError(f"unknown mode: {mode}")
        self.events = {tuple(e) for e in (*events, *EVENTS)}
        if bad := [e for e in events if not valid_event(e)]:
            raise ValueError(f"invalid events: {bad}")
        self.append, self.mode, self.debounce_ms, self.max_window_ms, self.suppress_ms, self.depth, self.items = append, mode, debounce_ms, max_window_ms, suppress_ms, depth, items
        self.groups: dict[tuple, dict[str, Any]] = {}
        self.first = self.last = None
        self.suppressed_until = -1
        self.errors: list[Exception] = []

    def handle(self, event: tuple[str, ...], measurements: Mapping[str, Any], metadata: Mapping[str, Any], now_ms: int) -> None:
        if tuple(event) not in self.events or (event[0] == PREFIX and now_ms < self.suppressed_until):
            return
        self.tick(now_ms)
        meta = table_metadata(metadata)
        if self.mode == "raw":
            term = lambda x: normalize_term(x, self.depth, self.items)
            self._append({"type": "event", "event": ".".join(event), "measurements": term(dict(measurements)), "metadata": term(meta), "at": _at(now_ms)})
            return
        key = (".".join(event), *(None if meta.get(k) is None else str(meta[k]) for k in GROUP[1:]))
        group = self.groups.setdefault(key, {"count": 0, "measurements": {}})
        group["count"] += 1
        for name, v in measurements.items():
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                m = group["measurements"].setdefault(name, {"min": v, "max": v, "sum": 0, "last": v, "count": 0})
                m.update(min=min(m["min"], v), max=max(m["max"], v), sum=m["sum"] + v, last=v, count=m["count"] + 1)
        self.first = now_ms if self.first is None else self.first
        self.last = now_ms

    def tick(self, now_ms: int) -> None:
        if self.first is None:
            return
        if now_ms - self.first >= self.max_window_ms:
            self.flush(now_ms, "max_window")
        elif now_ms - self.last >= self.debounce_ms:
            self.flush(now_ms, "debounce")

    def flush(self, now_ms: int, reason: str = "manual") -> int:
        groups, first, last = self.groups, self.first, self.last
        self.groups, self.first, self.last = {}, None, None
        self.suppressed_until = now_ms + self.suppress_ms
        for key, g in groups.items():
            finished = {n: {"min": m["min"], "max": m["max"], "last": m["last"], "avg": m["sum"] / m["count"], "count": m["count"]} for n, m in g["measurements"].items()}
            self._append({"type": "summary", **dict(zip(GROUP, key, strict=True)), "count": g["count"], "window_started_at": _at(first), "window_ended_at": _at(last), "flush_reason": reason, "measurements": finished})
        return len(groups)

    def _append(self, row: dict[str, Any]) -> None:
        try:
            self.append(row)
        except Exception as e:  # telemetry never fails what it watches
            self.errors.append(e)


def _at(ms: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(ms / 1000, dt.UTC)


def islands(events: DataFrame, ts: str, gap_s: float, by: list[str] | None = None) -> DataFrame:
    """Debounce windows as a plan: `island` counts the gaps of more than gap_s before a row. Without
    `by` all rows share one window, as the forwarder's groups do."""
    w = Window.partitionBy(*by).orderBy(ts) if by else Window.partitionBy(F.lit(0)).orderBy(ts)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((us - F.lag(us).over(w) > int(gap_s * 1_000_000)).cast("int"), F.lit(0))
    return events.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")


def summarize(events: DataFrame, by: list[str], ts: str = "ts", measurements: str = "measurements") -> DataFrame:
    """Per group and measurement: min, max, last by time, average and count. measurements is a
    MAP<STRING,DOUBLE>."""
    rows = events.select(*by, ts, F.explode(measurements).alias("measurement", "v")).where("v is not null")
    return rows.groupBy(*by, "measurement").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.max_by("v", ts).alias("last"), F.avg("v").alias("avg"), F.count("v").alias("count"))


def session_summaries(events: DataFrame, by: list[str], ts: str = "ts", gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """The streaming form: counts by session window, with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("count")).select(F.col("session_window.start").alias("window_started_at"), F.col("session_window.end").alias("window_ended_at"), *by, "count")


def backpressure_edges(samples: DataFrame, active: str, order: str, by: list[str]) -> DataFrame:
    """Rows at which a boolean state is entered or cleared; the state before the first row is off."""
    was = F.coalesce(F.lag(active).over(Window.partitionBy(*by).orderBy(order)), F.lit(False))
    return samples.withColumn("_was", was).where(F.col(active) != F.col("_was")).withColumn("edge", F.when(F.col(active), "entered").otherwise("cleared")).drop("_was")


class ProgressListener(StreamingQueryListener):
    """Query progress as telemetry events."""

    def __init__(self, emit: Callable[[tuple[str, ...], dict[str, Any], dict[str, Any]], None]) -> None:
        self.emit = emit

    def onQueryStarted(self, event) -> None:
        self.emit((PREFIX, "cdc", "connection"), {"count": 1}, {"status": "started", "source": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.emit((PREFIX, "batch", "processed"), {"rows": p.numInputRows}, {"status": "ok", "source": p.name, "sources": json.loads(p.json).get("sources", [])})

    def onQueryTerminated(self, event) -> None:
        self.emit((PREFIX, "cdc", "connection"), {"count": 1}, {"status": "stopped", "error": event.exception})
