"""Initial snapshots: what to read, how rows are tagged, and how a snapshot hands over to the stream."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import lsn
from tidemill.functions.types import named
from tidemill.operators.numbering import numbered_rows
from tidemill.plans.specs import ConfigError, TableSpec

METADATA = ("_op", "_commit_lsn", "_seq", "_xid", "_source_ts", "_ingest_ts", "_relation_schema", "_relation_table", "_record", "_old_record", "checkpoint_key", "target_relation")
FORBIDDEN = (";", "--", "/*", "*/")


def safe_where(condition: str) -> str:
    if not condition.strip() or any(x in condition for x in FORBIDDEN):
        raise ConfigError(f"unsafe condition: {condition!r}")
    return condition


def scan(table: DataFrame, columns: Iterable[str] | None = None, where: str | None = None, order_by: Iterable[str] | None = None) -> DataFrame:
    """A source table's snapshot: condition and columns reach the scan."""
    out = table.where(F.expr(safe_where(where))) if where else table
    out = out.select(*[named(c) for c in columns]) if columns else out
    return out.orderBy(*[named(c) for c in order_by]) if order_by else out


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A table over JDBC (the driver's jar must be on the class path), split by ranges of a key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def tag(rows: DataFrame, spec: TableSpec, boundary: str, taken: dt.datetime | None = None) -> DataFrame:
    """Snapshot rows with the changelog's columns before their own; op R at the boundary."""
    at = F.lit(taken or dt.datetime.now(dt.UTC))
    data = [c for c in rows.columns if c not in METADATA]
    return rows.select(F.lit("R").alias("_op"), F.lit(lsn.parse(boundary)).cast(lsn.LSN_TYPE).alias("_commit_lsn"), F.lit(0).cast("long").alias("_xid"), at.alias("_source_ts"), at.alias("_ingest_ts"), F.lit(spec.source_schema).alias("_relation_schema"), F.lit(spec.source_table).alias("_relation_table"), *[named(c) for c in data])


def payload(tagged: DataFrame) -> DataFrame:
    """The data columns of tagged rows."""
    return tagged.drop(*METADATA)


def as_map(rows: DataFrame) -> Column:
    """Data columns as the text map that changes carry."""
    parts = [x for c in rows.columns for x in (F.lit(c), named(c).cast("string"))]
    return F.create_map(*parts) if parts else F.create_map().cast("map<string,string>")


def synthetic_start(boundary: str, rows: int) -> int:
    """Position before the first of `rows` snapshot rows whose last one lies at the boundary."""
    return max(lsn.parse(boundary) - rows, 0)


def replayed_rows(checkpoint: str | None, boundary: str, rows: int) -> int:
    """How many snapshot rows a checkpoint already covers."""
    if checkpoint is None:
        return 0
    return min(max(lsn.parse(checkpoint) - synthetic_start(boundary, rows), 0), rows)


def numbered(rows: DataFrame, boundary: str, order_by: list[str]) -> DataFrame:
    """Rows with synthetic positions (boundary - n, boundary] in a stable order."""
    first = synthetic_start(boundary, rows.count())
    out = numbered_rows(rows, order_by, "_number")
    return out.withColumn("_commit_lsn", (F.lit(first).cast(lsn.LSN_TYPE) + F.col("_number")).cast(lsn.LSN_TYPE)).drop("_number")


@dataclass(frozen=True)
class SnapshotPlan:
    run: bool
    complete_with: str | None = None  # the stored boundary to mark complete without a new snapshot


class SnapshotPlanError(RuntimeError):
    pass


def plan_snapshot(handoff: Mapping[str, str] | None, checkpoint: str, default_lsn: str = "0/0", before_stream: bool = True, on_restart: bool = False, resume: bool = True) -> SnapshotPlan:
    """What a start does about the snapshot.

    pending handoff: an error unless resuming; complete it if the checkpoint has reached the
    boundary; else run again, which needs snapshots before streams. complete: again only on restarts
    that ask for it. none: run if nothing was streamed yet or restarts ask for it.
    """
    state = handoff["state"] if handoff else None
    if state == "pending":
        if not resume:
            raise SnapshotPlanError("snapshot_handoff_incomplete")
        if lsn.at_or_past(checkpoint, handoff["boundary_lsn"]):
            return SnapshotPlan(False, handoff["boundary_lsn"])
        if not before_stream:
            raise SnapshotPlanError("snapshot_resume_requires_snapshot_before_stream")
        return SnapshotPlan(True)
    if not before_stream:
        return SnapshotPlan(False)
    if state == "complete":
        return SnapshotPlan(on_restart)
    return SnapshotPlan(on_restart or lsn.compare(checkpoint, default_lsn) == 0)


def run_snapshot(tables: Mapping[TableSpec, DataFrame], boundary: str, handler: Callable[[TableSpec, DataFrame], None]) -> dict[str, int]:
    """Hands each table's tagged rows to the handler, which must make them durable; rows by table.
    The first error ends it, and nothing is marked complete."""
    counts = {}
    for spec, rows in tables.items():
        tagged = tag(rows, spec, boundary)
        handler(spec, tagged)
        counts[".".join(spec.target)] = rows.count()
    return counts
