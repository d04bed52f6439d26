"""Push side of append streams: micro-batches by rows, bytes or age, and a bounded queue."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.terms import estimate_size
from tidemill.operators.numbering import numbered_rows
from tidemill.plans.specs import IngestConfig


@dataclass
class Batch:
    rows: list[dict[str, Any]]
    byte_count: int
    lsn_start: str | None
    lsn_end: str | None

    @property
    def row_count(self) -> int:
        return len(self.rows)


class BatchBuffer:
    """Rows in order of arrival; full at max_rows or max_bytes, due once it is old enough."""

    def __init__(self, config: IngestConfig | None = None) -> None:
        self.config = config or IngestConfig()
        self._reset()

    def _reset(self) -> None:
        self.rows, self.bytes, self.first, self.last, self.opened = [], 0, None, None, None

    def append(self, row: dict[str, Any], at: str, now_ms: int, size: int | None = None) -> Batch | None:
        """The batch, if the row completes it."""
        if not self.rows:
            self.first, self.opened = at, now_ms
        self.rows.append(row)
        self.bytes += estimate_size(row) if size is None else size
        self.last = at
        if len(self.rows) >= self.config.max_rows or self.bytes >= self.config.max_bytes:
            return self.flush()
        return None

    def due(self, now_ms: int) -> bool:
        return self.opened is not None and now_ms - self.opened >= self.config.flush_interval_ms

    def flush(self) -> Batch | None:
        if not self.rows:
            return None
        out = Batch(self.rows, self.bytes, self.first, self.last)
        self._reset()
        return out


class QueueOverflow(RuntimeError):
    pass


@dataclass
class BatchQueue:
    """Batches in flight and waiting. Overflow is an error, or drops the oldest that waits."""

    max_inflight: int = 1
    max_pending: int = 1000
    overflow: str = "fail"
    on_drop: Callable[[Any], None] | None = None
    inflight: list[Any] = field(default_factory=list)
    pending: deque[Any] = field(default_factory=deque)

    def push(self, item: Any) -> list[Any]:
        """What may start now."""
        if len(self.inflight) < self.max_inflight:
            self.inflight.append(item)
            return [item]
        if len(self.pending) >= self.max_pending:
            if self.overflow == "fail" or not self.pending:
                raise QueueOverflow(f"{len(self.inflight)} in flight, {len(self.pending)} waiting")
            dropped = self.pending.popleft()
            if self.on_drop:
                self.on_drop(dropped)
        self.pending.append(item)
        return []

    def done(self, item: Any) -> list[Any]:
        self.inflight.remove(item)
        out = []
        while self.pending and len(self.inflight) < self.max_inflight:
            out.append(self.pending.popleft())
            self.inflight.append(out[-1])
        return out


def batch_numbers(rows: DataFrame, order_by: list[str], max_rows: int) -> DataFrame:
    """Row-threshold batches of a table as a plan: batch_no from 0, in the given order."""
    out = numbered_rows(rows, order_by, "_number")
    return out.withColumn("batch_no", F.call_function("div", F.col("_number") - 1, F.lit(max_rows))).drop("_number")


def batch_stats(rows: DataFrame, seq: str, size: Column) -> DataFrame:
    """row_count, byte_count, first and last position of each batch_no."""
    return rows.groupBy("batch_no").agg(F.count(F.lit(1)).alias("row_count"), F.sum(size.cast("long")).alias("byte_count"), F.min(seq).alias("lsn_start"), F.max(seq).alias("lsn_end"))
