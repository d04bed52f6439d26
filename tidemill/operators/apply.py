"""Applying a batch to its target table: append, or upsert, delete and truncate by key."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import lsn
from tidemill.functions.types import cast_column, infer_columns, named, schema_of, to_kind
from tidemill.operators.changelog import ChangeError, check_keys, collapse
from tidemill.operators import store
from tidemill.operators.store import BUCKETS, Manifest, VersionedTable, bucket_of

BASE, NEW = "b", "n"
#: Winners of a batch up to this count are broadcast to the rows of the table.
BROADCAST_WINNERS = 200_000


def evolved(existing: T.StructType | None, incoming: T.StructType) -> T.StructType:
    """Existing columns with their types, then new ones; nothing is dropped. A new table's columns are
    in order of name."""
    if existing is None:
        return T.StructType(sorted((T.StructField(f.name, f.dataType) for f in incoming), key=lambda f: f.name))
    known = set(existing.names)
    return T.StructType([*existing.fields, *[T.StructField(f.name, f.dataType) for f in incoming if f.name not in known]])


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows with the table's columns and types; missing columns are null."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*[(cast_column(named(f.name), types[f.name], f.dataType.simpleString()) if f.name in types else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def result(status: str, counts: Mapping[str, int], lsn_end: str, deduped: bool = False, **more: Any) -> dict[str, Any]:
    return {"status": status, "lsn_end": lsn_end, "deduped": deduped, "operations": dict(counts), **more}


def append_rows(table: VersionedTable, rows: DataFrame, lsn_end: str, batch_id: int | None = None, at: str | None = None) -> dict[str, Any]:
    """Appends rows with inferred or given types. A batch whose end isn't past the applied position is
    skipped; with `at`, the column of each row's position, only rows past it are added."""
    m = table.manifest()
    end = lsn.parse(lsn_end)
    done = None if m.applied_lsn is None else lsn.parse(m.applied_lsn)
    if done is not None and done >= end:
        return result("ok", {"appends": 0}, lsn_end, True)
    if at is not None:
        rows = (rows if done is None else rows.where(named(at) > F.lit(done).cast(lsn.LSN_TYPE))).drop(at)
    schema = evolved(m.struct, rows.schema)
    files = table.write(conform(rows, schema), replace(m, keys=()), schema)
    n = table.spark.read.parquet(f"{table.folder}/{files.appended[-1]}").count()
    files = table.merge_folders(files)
    table.commit(replace(files, keys=m.keys, applied_lsn=lsn_end, batch_id=batch_id))
    return result("ok", {"appends": n}, lsn_end)


def append_records(table: VersionedTable, records: list[dict[str, Any]], lsn_end: str, batch_id: int | None = None) -> dict[str, Any]:
    """Appends Python records; kinds are inferred over the whole batch."""
    kinds = infer_columns(records)
    if not kinds:
        return advance(table, lsn_end, batch_id)
    rows = [tuple(to_kind(r.get(n), k) for n, k in kinds.items()) for r in records]
    return append_rows(table, table.spark.createDataFrame(rows, schema_of(kinds)), lsn_end, batch_id)


def advance(table: VersionedTable, lsn_end: str, batch_id: int | None = None) -> dict[str, Any]:
    """An empty batch changes no rows but moves the applied position."""
    m = table.manifest()
    if m.applied_lsn is not None and lsn.compare(m.applied_lsn, lsn_end) >= 0:
        return result("ok", {}, lsn_end, True)
    table.commit(replace(m, applied_lsn=lsn_end, batch_id=batch_id))
    return result("ok", {}, lsn_end)


def merged(base: DataFrame | None, winners: DataFrame, columns: list[str], keys: tuple[str, ...], schema: T.StructType, few: bool) -> DataFrame:
    """The rows after a batch. winners: key columns, _put, _fresh and the batch's columns, typed.

    Columns that the batch doesn't name keep their values unless the row is fresh. Where the batch
    names all columns, an anti join and a union do; else a left join picks values by column.
    """
    types = {f.name: f.dataType for f in schema}
    puts = winners.where("_put").select(*[(named(c) if c in columns else F.lit(None).cast(types[c])).alias(c) for c in schema.names])
    if base is None:
        return puts
    side = F.broadcast(winners) if few else winners
    if set(columns) >= set(schema.names):
        return base.join(side.select(*map(named, keys)), list(keys), "left_anti").select(*map(named, schema.names)).unionByName(puts)
    kept = base.join(side.select(*map(named, keys)), list(keys), "left_anti").select(*map(named, schema.names))
    pairs = [F.col(f"{NEW}.{_q(k)}") == F.col(f"{BASE}.{_q(k)}") for k in keys]
    on = pairs[0]
    for p in pairs[1:]:
        on = on & p
    old = base.alias(BASE)
    fresh = F.coalesce(F.col(f"{NEW}._fresh"), F.lit(False)) | F.col(f"{BASE}.{_q(keys[0])}").isNull()
    value = lambda c: (F.col(f"{NEW}.{_q(c)}") if c in columns else F.when(~fresh, F.col(f"{BASE}.{_q(c)}"))).alias(c)
    changed = winners.where("_put").alias(NEW).join(old, on, "left").select(*[value(c) for c in schema.names])
    return kept.unionByName(changed)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def typed_winners(winners: DataFrame, keys: tuple[str, ...], columns: list[str], schema: T.StructType) -> DataFrame:
    """Winners' maps as columns with the table's types."""
    types = {f.name: f.dataType.simpleString() for f in schema}
    own = {k: F.col("key")[i] for i, k in enumerate(keys)}
    cols = [cast_column(own.get(c, F.col("record")[c]), "string", types[c]).alias(c) for c in dict.fromkeys([*keys, *columns])]
    return winners.select(F.col("put").alias("_put"), F.col("fresh").alias("_fresh"), *cols)


def apply_changes(table: VersionedTable, changes: DataFrame, keys: tuple[str, ...], lsn_end: str, batch_id: int | None = None, types: Mapping[str, T.DataType] | None = None, n_buckets: int = BUCKETS) -> dict[str, Any]:
    """Applies a batch of the changelog in sequence and commits it with its end position.

    Rows at or before the applied position are skipped one by one, so a replay with other borders
    changes nothing. types: of columns that the table doesn't have yet (a snapshot's); text otherwise.
    Only the buckets of touched keys are read and rewritten.
    """
    m = table.manifest()
    done = None if m.applied_lsn is None else lsn.parse(m.applied_lsn)
    if done is not None and done >= lsn.parse(lsn_end):
        return result("ok", {"truncates": 0, "deletes": 0, "upserts": 0}, lsn_end, True)
    if done is not None:
        changes = changes.where(F.col("_commit_lsn") > F.lit(done).cast(lsn.LSN_TYPE))
    changes = changes.persist()
    try:
        check_keys(changes, keys)
        if not keys:
            return _append_changes(table, m, changes, lsn_end, batch_id, types or {})
        c = collapse(changes, keys)
        if not any(c.counts.values()):
            return advance(table, lsn_end, batch_id) | {"operations": c.counts}
        if m.schema is None and not c.columns:  # deletes and truncates of a table that isn't there
            table.commit(replace(m, applied_lsn=lsn_end, batch_id=batch_id))
            return result("ok", c.counts, lsn_end)
        if m.keys and m.keys != keys:
            raise ChangeError(f"the table's keys are {m.keys}")
        given = types or {}
        incoming = T.StructType([T.StructField(n, given.get(n, T.StringType())) for n in dict.fromkeys([*c.columns, *(keys if m.schema is None else ())])])
        schema = evolved(m.struct, incoming)
        m = replace(m, keys=keys, n_buckets=m.n_buckets if m.schema else n_buckets)
        winners = typed_winners(c.winners, keys, c.columns, schema).persist()
        try:
            n = winners.count()
            few = n <= BROADCAST_WINNERS
            rows = n + (0 if c.truncated else m.n_rows)
            if m.schema is not None and not c.truncated and rows > m.n_buckets * store.BUCKET_ROWS:  # updates counted as rows
                rows = n + table.read(m).count()
            m = replace(m, n_rows=rows)
            if c.truncated or m.schema is None:
                files = _write_whole(table, _more_buckets(m), winners, c.columns, keys, schema, few)
            elif (wider := _more_buckets(m)).n_buckets > m.n_buckets:
                files = table.write(merged(conform(table.read(m), schema), winners, c.columns, keys, schema, few), replace(wider, buckets={}), schema, whole=True)
            else:
                touched = sorted(r[0] for r in winners.select(bucket_of(keys, m.n_buckets)).distinct().collect())  # n_buckets at most
                old = conform(table.read(m, touched), schema) if any(str(b) in m.buckets for b in touched) else None
                files = table.write(merged(old, winners, c.columns, keys, schema, few), replace(m, buckets={b: f for b, f in m.buckets.items() if int(b) not in touched}), schema)
            table.commit(replace(files, applied_lsn=lsn_end, batch_id=batch_id))
        finally:
            winners.unpersist()
        return result("ok", c.counts, lsn_end, columns=schema.names)
    finally:
        changes.unpersist()


def _more_buckets(m: Manifest) -> Manifest:
    """Enough buckets that one holds BUCKET_ROWS rows at most, about: a batch then rewrites so many for
    each bucket it touches, however large the table. They grow by four, so rewriting the whole table for
    it costs a constant share of what was written."""
    n = m.n_buckets
    while m.n_rows > n * store.BUCKET_ROWS:
        n *= 4
    return replace(m, n_buckets=n)


def _write_whole(table: VersionedTable, m: Manifest, winners: DataFrame, columns: list[str], keys: tuple[str, ...], schema: T.StructType, few: bool) -> Manifest:
    return table.write(merged(None, winners, columns, keys, schema, few), replace(m, buckets={}), schema, whole=True)


def _append_changes(table: VersionedTable, m: Manifest, changes: DataFrame, lsn_end: str, batch_id: int | None, types: Mapping[str, T.DataType]) -> dict[str, Any]:
    """Inserts and snapshot rows of a table without keys; a truncate drops what came before it."""
    stats = changes.agg(F.max(F.when(F.col("_op") == "T", F.struct(F.col("_commit_lsn").alias("l"), F.col("_seq").alias("s")))).alias("t"), F.count_if(F.col("_op").isin("I", "R")).alias("upserts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("_record"))))).alias("columns")).first()
    t, columns = stats["t"], list(stats["columns"] or [])
    rows = changes.where(F.col("_op").isin("I", "R"))
    if t is not None:
        at = F.lit(t["l"]).cast(lsn.LSN_TYPE)
        rows = rows.where((F.col("_commit_lsn") > at) | ((F.col("_commit_lsn") == at) & (F.col("_seq") > t["s"])))
    counts = {"truncates": int(t is not None), "deletes": 0, "upserts": stats["upserts"]}
    if not columns and m.schema is None:
        return advance(table, lsn_end, batch_id) | {"operations": counts}
    schema = evolved(m.struct, T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in columns]))
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    rows = rows.select(*[cast_column(F.col("_record")[c], "string", kinds[c]).alias(c) for c in schema.names])
    files = table.merge_folders(table.write(rows, replace(m, appended=() if t is not None else m.appended), schema))
    table.commit(replace(files, applied_lsn=lsn_end, batch_id=batch_id))
    return result("ok", counts, lsn_end, columns=schema.names)


def apply_snapshot(table: VersionedTable, rows: DataFrame, keys: tuple[str, ...], boundary: str, batch_id: int | None = None, n_buckets: int = BUCKETS) -> dict[str, Any]:
    """Applies typed snapshot rows (data columns only) as of the boundary; with keys by upsert, so that
    running it again gives the same table."""
    m = table.manifest()
    if m.applied_lsn is not None and lsn.compare(m.applied_lsn, boundary) >= 0:
        return result("ok", {"upserts": 0}, boundary, True)
    if not keys:
        return append_rows(table, rows, boundary, batch_id)
    schema = evolved(m.struct, rows.schema)
    n = rows.count()
    m2 = _more_buckets(replace(m, keys=keys, n_buckets=m.n_buckets if m.schema else n_buckets, n_rows=m.n_rows + n))
    typed = conform(rows, T.StructType([f for f in schema if f.name in rows.columns]))
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | named(k).isNull()
    winners = typed.dropDuplicates(list(keys)).withColumns({"_put": F.lit(True), "_fresh": F.lit(False)}).where(F.when(null_key, F.raise_error("null_primary_key").cast("boolean")).otherwise(True))
    old = conform(table.read(m), schema) if m.schema else None
    files = table.write(merged(old, winners, list(rows.columns), keys, schema, False), replace(m2, buckets={}), schema, whole=True)
    table.commit(replace(files, applied_lsn=boundary, batch_id=batch_id))
    return result("ok", {"upserts": n}, boundary)


def mirrored(base: DataFrame | None, changes: DataFrame, keys: tuple[str, ...], types: Mapping[str, T.DataType] | None = None) -> DataFrame:
    """The table after a batch of changes, as a plan over DataFrames (nothing is written)."""
    check_keys(changes, keys)
    c = collapse(changes, keys)
    given = types or {}
    names = dict.fromkeys([*c.columns, *(keys if base is None else ())])
    schema = evolved(base.schema if base is not None else None, T.StructType([T.StructField(n, given.get(n, T.StringType())) for n in names]))
    winners = typed_winners(c.winners, keys, c.columns, schema)
    old = None if base is None or c.truncated else conform(base, schema)
    return merged(old, winners, c.columns, keys, schema, False)
