"""Streams: changes into mirrored tables, pushed events into append tables, and their start and stop."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.functions import lsn
from tidemill.operators.apply import advance, append_records, apply_changes, apply_snapshot
from tidemill.operators.changelog import route
from tidemill.operators.store import VersionedTable
from tidemill.plans.specs import ConfigError, StreamConfig, TableSpec
from tidemill.session import workers_ready
from tidemill.sources.pgoutput import Progress
from tidemill.sources.setup import Source
from tidemill.sources.snapshot import payload, plan_snapshot, run_snapshot
from tidemill.streaming.batches import Batch, BatchBuffer, BatchQueue
from tidemill.streaming.meta import MetaStore, SqliteMetaStore, with_retries
from tidemill.streaming.telemetry import PREFIX, Emit, quiet


class LagLimit(RuntimeError):
    """The stream is further behind than its limit allows."""


def process_batch(spark: SparkSession, config: StreamConfig, meta: MetaStore, batch: DataFrame, batch_id: int | None = None, observer: Callable[[TableSpec, dict[str, Any]], None] | None = None, emit: Emit = quiet) -> dict[str, dict[str, Any]]:
    """Applies one batch to every target and then moves all checkpoints to its end, so an idle table
    never holds the others back and nothing is acknowledged before it is durable. Errors propagate:
    the batch comes again and rows already applied are skipped."""
    routed = route(batch, config.tables).persist()
    try:
        end = batch.agg(F.max("_commit_lsn").alias("m")).first()["m"]
        if end is None:
            return {}
        at, out = lsn.to_text(int(end)), {}
        for spec in config.tables:
            began = time.monotonic()
            table = VersionedTable(spark, config.root, *spec.target, catalog=config.catalog)
            own = routed.where((F.col("_relation_schema") == spec.source_schema) & (F.col("_relation_table") == spec.source_table))
            about = {"source": config.source_name, "table": spec.target, "lsn_end": at}
            try:
                res = advance(table, at, batch_id) if own.isEmpty() else apply_changes(table, own, spec.primary_keys, at, batch_id, n_buckets=config.buckets)
            except Exception as e:
                emit((PREFIX, "batch", "processed"), {"duration_ms": _since(began)}, about | {"status": "error", "reason": str(e)[:500]})
                raise
            out[".".join(spec.target)] = res
            for op, n in res["operations"].items():
                emit((PREFIX, "cdc", "event"), {"count": n}, about | {"status": op})
            emit((PREFIX, "batch", "processed"), {"duration_ms": _since(began), "rows": sum(res["operations"].values())}, about | {"status": "deduped" if res["deduped"] else res["status"]})
            if observer:
                observer(spec, res)
        for spec in config.tables:
            meta.upsert_checkpoint(spec.checkpoint_key, at)
        return out
    finally:
        routed.unpersist()


def _since(began: float) -> int:
    return int((time.monotonic() - began) * 1000)


class LagGuard:
    """Compares how far the source is with what is durable: tells of the lag, of its crossing the limit in
    either direction, and raises beyond the limit."""

    def __init__(self, config: StreamConfig, emit: Emit = quiet) -> None:
        self.config, self.emit, self.progress = config, emit, Progress(max_lag_bytes=config.max_lag_bytes)

    def check(self, head: int, applied: int) -> int:
        self.progress.receive(max(head, applied))
        self.progress.acknowledge(applied)
        lag, limit, about = self.progress.lag, self.config.max_lag_bytes, {"source": self.config.source_name}
        self.emit((PREFIX, "cdc", "lag"), {"lag_bytes": lag, "received_lsn": self.progress.received, "applied_lsn": applied}, about)
        self.emit((PREFIX, "service", "ack_checkpoint_lag"), {"lag_bytes": lag}, about)
        if limit is not None:
            if edge := self.progress.edge(limit):
                self.emit((PREFIX, "cdc", "backpressure"), {"lag_bytes": lag}, about | {"status": edge})
            if self.progress.over_limit():
                self.emit((PREFIX, "cdc", "connection"), {"count": 1}, about | {"status": "lag_exceeded"})
                raise LagLimit(f"{lag} bytes behind, {limit} are allowed")
        return lag


class StreamHandle:
    """A running mirror: its query, its tables, and the last results."""

    def __init__(self, config: StreamConfig, meta: MetaStore, spark: SparkSession) -> None:
        self.config, self.meta, self.spark = config, meta, spark
        self.query: StreamingQuery | None = None
        self.results: deque[dict[str, Any]] = deque(maxlen=100)  # the last ones
        self.snapshot_counts: dict[str, int] = {}
        self.start_lsn = config.default_start_lsn

    def table(self, schema: str, name: str) -> VersionedTable:
        return VersionedTable(self.spark, self.config.root, schema, name, catalog=self.config.catalog)

    def flush(self) -> None:
        """Waits until everything the source has now is applied."""
        if self.query:
            self.query.processAllAvailable()

    def stats(self) -> dict[str, Any]:
        return {"last_progress": self.query.lastProgress if self.query else None, "checkpoints": {s.checkpoint_key: self.meta.fetch_checkpoint(s.checkpoint_key) for s in self.config.tables}}

    def stop(self) -> None:
        if self.query:
            self.query.stop()


def start_stream(spark: SparkSession, config: StreamConfig, changes: Callable[[str], DataFrame], snapshots: Callable[[TableSpec], DataFrame] | None = None, boundary: Callable[[], str] | None = None, meta: MetaStore | None = None, trigger: Mapping[str, Any] | None = None, *, head: Callable[[], str] | None = None, source: Source | None = None, setup: Callable[[SparkSession], Any] | None = None, observer: Callable[[TableSpec, dict[str, Any]], None] | None = None, emit: Emit = quiet) -> StreamHandle:
    """Runs the setup, prepares the source, resolves the snapshot plan, snapshots if it says so, and
    starts the stream. Whatever fails, the source's snapshot transaction is ended.

    changes: start position -> streaming changelog. A handoff is marked pending before the snapshot's
    rows are applied and complete only after they are durable. head: how far the source is by now, for the
    lag guard. source: what prepares publication and slot and gives the boundary of a snapshot. A snapshot
    that isn't the first needs a boundary past what the tables have applied.
    """
    workers_ready(spark)
    for sql in config.setup_sql:
        spark.sql(sql)
    if setup:
        setup(spark)
    meta = meta or SqliteMetaStore(config.meta_path).bootstrap()
    handle = StreamHandle(config, meta, spark)
    keys = [s.checkpoint_key for s in config.tables]
    fresh = source.prepare(config.tables).start_lsn if source else None
    checkpoint = meta.fetch_start_lsn(keys, config.default_start_lsn)
    plan = plan_snapshot(meta.fetch_handoff(config.source_name), checkpoint, config.default_start_lsn, config.snapshot_before_stream and snapshots is not None, config.snapshot_on_restart, config.resume_incomplete_snapshot)
    edge = None
    if plan.run:
        given = source.begin_snapshot if source else boundary
        if given is None and lsn.compare(checkpoint, config.default_start_lsn) > 0:
            raise ConfigError("a snapshot of tables that are ahead of the start needs its boundary")
        done = False
        try:
            edge = given() if given else checkpoint
            with_retries(lambda: meta.mark_pending(config.source_name, edge))
            handle.snapshot_counts = run_snapshot({s: snapshots(s) for s in config.tables}, edge, lambda s, rows: apply_snapshot(handle.table(*s.target), payload(rows), s.primary_keys, edge, n_buckets=config.buckets) and None)
            done = True
        finally:
            if source:
                source.end_snapshot(done)
        for k in keys:
            meta.upsert_checkpoint(k, edge)
        with_retries(lambda: meta.mark_complete(config.source_name, edge))
    elif plan.complete_with:
        with_retries(lambda: meta.mark_complete(config.source_name, plan.complete_with))
    handle.start_lsn = lsn.latest(checkpoint, edge, fresh if checkpoint == config.default_start_lsn else None)
    guard = LagGuard(config, emit)

    def each(batch: DataFrame, batch_id: int) -> None:
        handle.results.append(process_batch(batch.sparkSession, config, meta, batch, batch_id, observer, emit))
        if head:
            guard.check(lsn.parse(head()), lsn.parse(meta.fetch_start_lsn(keys, config.default_start_lsn)))

    writer = changes(handle.start_lsn).writeStream.foreachBatch(each).queryName(f"tidemill-{config.source_name}").trigger(**(trigger or {"processingTime": f"{config.ingest.flush_interval_ms} milliseconds"}))
    if config.checkpoint_location:
        writer = writer.option("checkpointLocation", config.checkpoint_location)
    handle.query = writer.start()
    emit((PREFIX, "cdc", "connection"), {"count": 1}, {"source": config.source_name, "status": "started"})
    return handle


class AppendStream:
    """Rows pushed by an application into append-only tables, in micro-batches.

    Positions are given or synthetic: one more than the last, starting at what the table has applied,
    so a restarted stream goes on where it was. A thread of the stream writes the batches, one at a time
    and in order, and flushes what is due by age; append() never waits for it. What waits is bounded:
    beyond max_pending batches append() fails, or the oldest goes (`overflow`). After an error
    nothing more is written, and append(), flush() and stop() raise it.
    """

    def __init__(self, spark: SparkSession, config: StreamConfig, meta: MetaStore | None = None, observer: Callable[[str, Any], None] | None = None, start_lsn: str | None = None, clock: Callable[[], float] = time.monotonic, emit: Emit = quiet) -> None:
        self.spark, self.config, self.clock, self.emit = spark, config, clock, emit
        self.meta = meta or SqliteMetaStore(config.meta_path).bootstrap()
        self.observer = observer or (lambda *_: None)
        self.specs = {s.target: s for s in config.tables}
        i = config.ingest
        self.buffers = {t: BatchBuffer(i) for t in self.specs}
        self.queue = BatchQueue(i.max_inflight, i.max_pending, i.overflow, self._dropped)
        self.ready: deque[tuple[tuple[str, str], Batch]] = deque()  # started, not yet written
        self.counters = {t: self._start(t, start_lsn) for t in self.specs}
        self.failed: BaseException | None = None
        self.stopping = False
        self.changed = threading.Condition(threading.RLock())
        self.thread = threading.Thread(target=self._run, name=f"tidemill-append-{config.source_name}", daemon=True)
        self.thread.start()

    def _start(self, target: tuple[str, str], given: str | None) -> int:
        applied = self._table(target).applied() or 0
        return max(applied, lsn.parse(given) if given else 0, lsn.parse(self.meta.fetch_checkpoint(self.specs[target].checkpoint_key)))

    def _table(self, target: tuple[str, str]) -> VersionedTable:
        return VersionedTable(self.spark, self.config.root, *target, catalog=self.config.catalog)

    def append(self, target: str | tuple[str, str], row: Mapping[str, Any], at: str | None = None) -> str:
        """Takes a row; its position."""
        with self.changed:
            self._check()
            name = tuple(target.split(".", 1)) if isinstance(target, str) else tuple(target)
            if name not in self.specs:
                raise LookupError(f"unknown table: {target}")
            self.counters[name] = max(self.counters[name], lsn.parse(at)) if at else self.counters[name] + 1
            where = at or lsn.to_text(self.counters[name])
            full = self.buffers[name].append({str(k): v for k, v in row.items()}, where, int(self.clock() * 1000))
            if full:
                self._enqueue(name, full, "full")
            return where

    def tick(self) -> None:
        """Enqueues what is due by age; the stream's thread does so by itself."""
        with self.changed:
            for name, b in self.buffers.items():
                if b.due(int(self.clock() * 1000)) and (batch := b.flush()):
                    self._enqueue(name, batch, "age")

    def flush(self, target: str | tuple[str, str] | None = None, wait: bool = True) -> None:
        """Enqueues what is buffered; returns when all batches are durable, unless told not to wait."""
        with self.changed:
            self._check()
            names = [tuple(target.split(".", 1)) if isinstance(target, str) else target] if target else list(self.buffers)
            for name in names:
                if batch := self.buffers[name].flush():
                    self._enqueue(name, batch, "flush")
            while wait and not self.failed and (self.queue.inflight or self.queue.pending):
                self.changed.wait()
            self._check()

    def _check(self) -> None:
        if self.failed:
            raise RuntimeError("the stream has stopped") from self.failed
        if self.stopping:
            raise RuntimeError("the stream has stopped")

    def _enqueue(self, name: tuple[str, str], batch: Batch, reason: str) -> None:
        self.emit((PREFIX, "batch", "flushed"), {"rows": batch.row_count, "bytes": batch.byte_count}, {"table": name, "reason": reason})
        self.ready.extend(self.queue.push((name, batch)))
        self.emit((PREFIX, "append_stream", "batch_queue"), {"inflight": len(self.queue.inflight), "pending": len(self.queue.pending)}, {"table": name})
        self.changed.notify_all()

    def _dropped(self, item: tuple[tuple[str, str], Batch]) -> None:
        self.emit((PREFIX, "append_stream", "batch_dropped"), {"rows": item[1].row_count}, {"table": item[0]})
        self.observer("batch_dropped", item)

    def _run(self) -> None:
        beat = max(0.01, min(1.0, self.config.ingest.flush_interval_ms / 4000))
        while True:
            with self.changed:
                if not self.ready and not self.stopping:
                    self.changed.wait(beat)
                if self.stopping and not self.ready:
                    return
                item = self.ready.popleft() if self.ready else None
            try:
                if item:
                    self._write(*item)
                    with self.changed:
                        self.ready.extend(self.queue.done(item))
                        self.changed.notify_all()
                if not self.stopping:
                    self.tick()
            except BaseException as e:
                with self.changed:
                    self.failed = e
                    self.changed.notify_all()
                self.observer("stopped", e)
                return

    def _write(self, name: tuple[str, str], batch: Batch) -> None:
        began = time.monotonic()
        res = append_records(self._table(name), batch.rows, batch.lsn_end)
        self.meta.upsert_checkpoint(self.specs[name].checkpoint_key, batch.lsn_end)
        self.emit((PREFIX, "batch", "processed"), {"duration_ms": _since(began), "rows": batch.row_count}, {"table": name, "lsn_end": batch.lsn_end, "status": res["status"]})
        self.observer("batch_result", (name, res | {"row_count": batch.row_count}))

    def stop(self) -> None:
        """Writes what is buffered and ends the thread."""
        if not self.failed and not self.stopping:
            self.flush()
        with self.changed:
            self.stopping = True
            self.changed.notify_all()
        self.thread.join()


class Manager:
    """Streams by the name of their source."""

    def __init__(self) -> None:
        self.sources: dict[str, StreamHandle] = {}

    def start(self, spark: SparkSession, config: StreamConfig, *args: Any, **kwargs: Any) -> StreamHandle:
        if config.source_name in self.sources:
            raise ValueError(f"already started: {config.source_name}")
        self.sources[config.source_name] = start_stream(spark, config, *args, **kwargs)
        return self.sources[config.source_name]

    def stop(self, name: str) -> None:
        if name not in self.sources:
            raise LookupError(f"not started: {name}")
        self.sources.pop(name).stop()

    def names(self) -> list[str]:
        return sorted(self.sources)

    def supervise(self, name: str, restart: Callable[[], StreamHandle], attempts: int = 3, wait: Callable[[int], float] = lambda _: 1.0) -> None:
        """Awaits a stream and starts it anew after errors, up to `attempts` times."""
        for k in range(attempts + 1):
            try:
                self.sources[name].query.awaitTermination()
                return
            except Exception:
                if k == attempts:
                    raise
                time.sleep(wait(k))
                self.sources[name] = restart()


def seed_and_start(spark: SparkSession, config: StreamConfig, changes: Callable[[str], DataFrame], positions: Mapping[str, str], **more: Any) -> StreamHandle:
    """Writes checkpoints first (a table moved from elsewhere), then starts."""
    meta = more.pop("meta", None) or SqliteMetaStore(config.meta_path).bootstrap()
    for key, at in positions.items():
        meta.upsert_checkpoint(key, at)
    return start_stream(spark, config, changes, meta=meta, **more)
