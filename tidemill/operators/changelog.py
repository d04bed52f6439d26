"""Changes on their way to target tables: routing, key-level actions, and the last writer of a key."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.plans.specs import TableSpec, specs_by_source
from tidemill.sources.pgoutput import CHANGE_SCHEMA

OPS = ("I", "U", "D", "T", "R")


class ChangeError(ValueError):
    """A batch that can't be applied."""


def route(changes: DataFrame, specs: Iterable[TableSpec]) -> DataFrame:
    """Changes of designated tables with checkpoint_key, target_schema and target_table. The broadcast
    side has a row for each configured table."""
    rows = [(*s.source, s.checkpoint_key, *s.target) for s in specs_by_source(specs).values()]
    known = changes.sparkSession.createDataFrame(rows, "_relation_schema string, _relation_table string, checkpoint_key string, target_schema string, target_table string")
    return changes.join(F.broadcast(known), ["_relation_schema", "_relation_table"])


def op_code(kind: Column) -> Column:
    """I, U, D, T or R of an event's kind."""
    out = F.lit(None).cast("string")
    for name, code in (("insert", "I"), ("update", "U"), ("delete", "D"), ("truncate", "T"), ("snapshot", "R")):
        out = F.when(kind == name, code).otherwise(out)
    return out


def position() -> Column:
    return F.struct(F.col("_commit_lsn").alias("lsn"), F.col("_seq").alias("seq"))


def _key(record: Column, keys: Iterable[str]) -> Column:
    return F.array(*[record[k] for k in keys])


def check_keys(changes: DataFrame, keys: tuple[str, ...]) -> None:
    """U and D need declared keys; a key's value is never null."""
    if not keys:
        if not changes.where(F.col("_op").isin("U", "D")).isEmpty():
            raise ChangeError("missing_primary_keys")
        return
    new, old = _key(F.col("_record"), keys), _key(F.coalesce("_old_record", "_record"), keys)
    null_in = lambda a: F.exists(a, lambda v: v.isNull())
    if not changes.where((F.col("_op").isin("I", "U", "R") & null_in(new)) | (F.col("_op") == "D") & null_in(old)).isEmpty():
        raise ChangeError("null_primary_key")


def actions(changes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """key, put (else delete), pos (lsn, seq, sub), record: an update that changes its key deletes the
    old one first. Unknown ops do nothing; truncates aren't actions of a key."""
    new, old = F.col("_record"), F.coalesce("_old_record", "_record")
    step = lambda key, put, sub: F.struct(key.alias("key"), F.lit(put).alias("put"), F.struct(F.col("_commit_lsn").alias("lsn"), F.col("_seq").alias("seq"), F.lit(sub).alias("sub")).alias("pos"), F.when(F.lit(put), F.col("_record")).alias("record"))
    moved = (F.col("_op") == "U") & F.col("_old_record").isNotNull() & F.exists(F.zip_with(_key(new, keys), _key(old, keys), lambda a, b: ~a.eqNullSafe(b)), lambda x: x) & ~F.exists(_key(old, keys), lambda v: v.isNull())
    steps = F.when(F.col("_op") == "D", F.array(step(_key(old, keys), False, 0))).when(moved, F.array(step(_key(old, keys), False, 0), step(_key(new, keys), True, 1))).when(F.col("_op").isin("I", "U", "R"), F.array(step(_key(new, keys), True, 1)))
    return changes.where(F.col("_op") != "T").select(F.explode(steps).alias("a")).select("a.*")


@dataclass
class Collapsed:
    """The last action of each key, and what else a batch says."""

    winners: DataFrame  # key, put, fresh, record
    truncated: bool
    columns: list[str]  # union over the upserted rows
    counts: dict[str, int]


def collapse(changes: DataFrame, keys: tuple[str, ...]) -> Collapsed:
    """Sequential semantics by one aggregation: the action with the highest position of each key wins,
    actions before the last truncate are void, and a put after a delete in the batch is fresh (columns
    that the batch doesn't name aren't kept from the old row)."""
    stats = changes.agg(F.max(F.when(F.col("_op") == "T", position())).alias("t"), F.count_if(F.col("_op") == "T").alias("truncates"), F.count_if(F.col("_op") == "D").alias("deletes"), F.count_if(F.col("_op").isin("I", "U", "R")).alias("upserts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("_op").isin("I", "U", "R"), F.map_keys("_record")))))).alias("columns")).first()
    acts = actions(changes, keys)
    if stats["t"] is not None:
        t = stats["t"]
        acts = acts.where((F.col("pos.lsn") > F.lit(t["lsn"]).cast("decimal(20,0)")) | ((F.col("pos.lsn") == F.lit(t["lsn"]).cast("decimal(20,0)")) & (F.col("pos.seq") > t["seq"])))
    last = acts.groupBy("key").agg(F.max_by(F.struct("put", "record"), "pos").alias("w"), F.max(~F.col("put")).alias("fresh"))
    winners = last.select("key", "w.put", F.col("fresh").alias("fresh"), "w.record")
    return Collapsed(winners, stats["t"] is not None, list(stats["columns"] or []), {"truncates": min(1, stats["truncates"]), "deletes": stats["deletes"], "upserts": stats["upserts"]})


def assemble(events: DataFrame) -> DataFrame:
    """Committed transactions of an event table (xid, kind, lsn, ts, seq): begin and end positions,
    counts by op. Transactions without a commit aren't returned."""
    ops = {"I": "insert", "U": "update", "D": "delete", "T": "truncate"}
    out = events.groupBy("xid").agg(F.min("lsn").alias("begin_lsn"), F.max(F.when(F.col("kind") == "commit", F.col("lsn"))).alias("end_lsn"), F.max(F.when(F.col("kind") == "commit", F.col("ts"))).alias("commit_ts"), F.count_if(F.col("kind").isin(*ops.values())).alias("n_changes"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ops.values()])
    return out.where("end_lsn is not null")


def back_fill(record: Column, old: Column, unchanged: Column) -> Column:
    """Values of the old record for the columns that a change left out as unchanged."""
    kept = F.map_filter(old, lambda k, _: F.array_contains(unchanged, k))
    return F.map_concat(F.map_filter(record, lambda k, _: ~F.array_contains(unchanged, k)), kept)


def empty_changes(spark) -> DataFrame:
    return spark.createDataFrame([], CHANGE_SCHEMA)
