"""Driver queries over the test tables, each through the library's operators, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import lsn, terms
from tidemill.functions.types import kinds_by_rank, pg_microseconds, pg_timestamp
from tidemill.operators.apply import append_rows, apply_changes, apply_snapshot, conform, evolved
from tidemill.operators.changelog import assemble, back_fill, op_code, route
from tidemill.operators.numbering import numbered_rows
from tidemill.operators.store import VersionedTable
from tidemill.plans.specs import TableSpec
from tidemill.session import shared_folder, workers_ready
from tidemill.sources.pgoutput import UNCHANGED, Converter, Message
from tidemill.sources.snapshot import payload, run_snapshot, scan
from tidemill.streaming.batches import batch_numbers, batch_stats
from tidemill.streaming.meta import start_lsn
from tidemill.streaming.telemetry import backpressure_edges, islands, summarize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text_map(*pairs: tuple[str, Column]) -> Column:
    return F.create_map(*[x for name, c in pairs for x in (F.lit(name), c.cast("string"))])


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a changelog of users: sign-ups insert, errors delete, others update."""
    e = table(spark, sf_dir, "events")
    record = _text_map(("user_id", F.col("user_id")), ("event_type", F.col("event_type")), ("value", F.col("value")))
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    xid = F.floor(F.col("event_id") / 10).cast("long")
    ts = F.col("ts").cast("timestamp")
    return e.select(op.alias("_op"), ((xid + 1) * 10).cast(lsn.LSN_TYPE).alias("_commit_lsn"), (F.col("event_id") + 1).alias("_seq"), xid.alias("_xid"), ts.alias("_source_ts"), ts.alias("_ingest_ts"), F.lit("public").alias("_relation_schema"), F.lit("users").alias("_relation_table"), F.when(op != "D", record).alias("_record"), F.when(op == "D", record).alias("_old_record"))


def target(spark: SparkSession, name: str) -> VersionedTable:
    """A new table of the lake."""
    workers_ready(spark)
    return VersionedTable(spark, shared_folder(spark, name), "raw", name)


def end_of(changes: DataFrame) -> str:
    return lsn.to_text(int(changes.agg(F.max("_commit_lsn")).first()[0] or 0))


def user_table(spark: SparkSession, t: VersionedTable) -> DataFrame:
    """The mirrored users; a table that no change has made yet is empty."""
    return t.read().select("user_id", "event_type", "value") if t.exists() else spark.createDataFrame([], "user_id long, event_type string, value double")


USER_TYPES = {"user_id": T.LongType(), "event_type": T.StringType(), "value": T.DoubleType()}
_LAST = "SELECT user_id, event_type, value FROM {src} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


@query("SELECT CASE WHEN o_orderkey % 10 = 2 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 10 IN (0, 2) THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 < 9 AND o_orderkey % 10 <> 1")
def mirror_orders_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after one batch with an update, a delete, an update of the key and an insert for each ten orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey") % 10
    names = o.columns
    old = _text_map(*[(n, F.col(n)) for n in names])
    moved = F.when(k == 2, F.col("o_orderkey") + 10000000).otherwise(F.col("o_orderkey"))
    price = F.when(k.isin(0, 2), F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))
    new = _text_map(("o_orderkey", moved), ("o_custkey", F.col("o_custkey")), ("o_orderstatus", F.col("o_orderstatus")), ("o_totalprice", price))
    op = F.when(k == 1, "D").when(k == 8, "I").otherwise("U")
    changes = o.where(k.isin(0, 1, 2, 8)).select(op.alias("_op"), F.lit(100).cast(lsn.LSN_TYPE).alias("_commit_lsn"), F.col("o_orderkey").alias("_seq"), F.when(op != "D", new).alias("_record"), F.when(op != "I", old).alias("_old_record"))
    t = target(spark, "orders")
    apply_snapshot(t, o.where(k < 8), ("o_orderkey",), "0/10")
    apply_changes(t, changes, ("o_orderkey",), "0/64")
    return t.read().select(*names)


@query(_LAST.format(src="events") + " AND event_type <> 'error'")
def mirror_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last writer of each key wins; a last delete leaves no row."""
    c, t = changelog(spark, sf_dir), target(spark, "users")
    apply_changes(t, c, ("user_id",), end_of(c), types=USER_TYPES)
    return user_table(spark, t)


@query(_LAST.format(src="(SELECT * FROM events WHERE event_id + 1 > (SELECT coalesce(max(event_id + 1), 0) FROM events WHERE (event_id + 1) % 997 = 0))") + " AND event_type <> 'error'")
def mirror_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 997th change is a truncate: only what follows the last one counts."""
    c = changelog(spark, sf_dir).withColumn("_op", F.when(F.col("_seq") % 997 == 0, "T").otherwise(F.col("_op")))
    t = target(spark, "users")
    apply_changes(t, c, ("user_id",), end_of(c), types=USER_TYPES)
    return user_table(spark, t)


@query("SELECT event_id // 10 AS xid, min(event_id + 1) AS begin_lsn, (event_id // 10 + 1) * 10 AS end_lsn, count(*) AS n_changes, count(*) FILTER (WHERE event_type = 'signup') AS n_insert, count(*) FILTER (WHERE event_type NOT IN ('signup', 'error')) AS n_update, count(*) FILTER (WHERE event_type = 'error') AS n_delete FROM events GROUP BY event_id // 10")
def txn_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of ten changes between begin and commit."""
    e = table(spark, sf_dir, "events")
    xid = F.floor(F.col("event_id") / 10).cast("long")
    kind = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    changes = e.select(xid.alias("xid"), kind.alias("kind"), (F.col("event_id") + 1).alias("lsn"), "ts")
    commits = changes.groupBy("xid").agg(F.max("ts").alias("ts")).select("xid", F.lit("commit").alias("kind"), ((F.col("xid") + 1) * 10).alias("lsn"), "ts")
    return assemble(changes.unionByName(commits)).select("xid", "begin_lsn", "end_lsn", "n_changes", "n_insert", "n_update", "n_delete")


@query("SELECT event_id, printf('%X/%X', (event_id * 4294967291) // 4294967296, (event_id * 4294967291) % 4294967296) AS lsn, CAST(event_id * 4294967291 AS BIGINT) AS position FROM events")
def lsn_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions near segment borders to text and back."""
    at = (F.col("event_id").cast(lsn.LSN_TYPE) * F.lit(4294967291).cast("decimal(10,0)")).cast(lsn.LSN_TYPE)
    text = table(spark, sf_dir, "events").select("event_id", lsn.lsn_to_text(at).alias("lsn"))
    return text.withColumn("position", lsn.lsn_from_text(F.col("lsn")).cast("bigint"))


@query("SELECT event_id, CASE WHEN a > b THEN a ELSE b END AS furthest, greatest(a - b, 0) AS lag FROM (SELECT event_id, event_id * 7 % 4096 AS a, event_id * 13 % 4096 AS b FROM events)")
def lsn_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furthest of two positions and the lag between them."""
    e = table(spark, sf_dir, "events")
    text = lambda k: lsn.lsn_to_text((F.col("event_id") * k % 4096).cast(lsn.LSN_TYPE))
    both = e.select("event_id", lsn.lsn_from_text(text(7)).alias("a"), lsn.lsn_from_text(text(13)).alias("b"))
    return both.select("event_id", F.greatest("a", "b").cast("bigint").alias("furthest"), lsn.lag_column(F.col("a"), F.col("b")).cast("bigint").alias("lag"))


@query("SELECT batch_no, count(*) AS row_count, CAST(sum(strlen(event_type)) AS BIGINT) AS byte_count, min(event_id) AS lsn_start, max(event_id) AS lsn_end FROM (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS batch_no FROM events) GROUP BY batch_no")
def microbatch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a thousand rows in order of arrival."""
    return batch_stats(batch_numbers(table(spark, sf_dir, "events"), ["event_id"], 1000), "event_id", F.octet_length("event_type"))


@query("SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(ts) AS started_at, max(ts) AS ended_at FROM (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 1800000000 THEN 1 ELSE 0 END AS gap FROM events)) GROUP BY ALL")
def session_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debounce windows of half an hour for each user."""
    out = islands(table(spark, sf_dir, "events"), "ts", 1800, ["user_id"])
    return out.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))


SPECS = [TableSpec("app", t, "raw", target, primary_keys=("id",), checkpoint_key=f"driver:app.{t}") for t, target in (("click", "clicks"), ("purchase", "purchases"), ("view", "views"))]


@query("SELECT event_id, target_table, checkpoint_key, user_id FROM events JOIN (VALUES ('click', 'clicks', 'driver:app.click'), ('purchase', 'purchases', 'driver:app.purchase'), ('view', 'views', 'driver:app.view')) m(t, target_table, checkpoint_key) ON event_type = t")
def route_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of designated tables with their target and checkpoint key."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.lit("app").alias("_relation_schema"), F.col("event_type").alias("_relation_table"))
    return route(e, SPECS).select("event_id", "target_table", "checkpoint_key", "user_id")


@query("SELECT o_orderkey, o_totalprice, NULL AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, round_even(o_totalprice, 0) AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1")
def schema_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch adds a column and its text takes the type the table has."""
    o = table(spark, sf_dir, "orders")
    first = o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice")
    second = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.bround("o_totalprice", 0).cast("string").alias("o_totalprice"), "o_orderpriority")
    schema = evolved(first.schema, second.schema)
    return conform(first, schema).unionByName(conform(second, schema))


@query(_LAST.format(src="events") + " AND event_type <> 'error'")
def dedup_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay with shifted borders changes nothing: rows up to the applied position are left out."""
    c = changelog(spark, sf_dir)
    edge = c.agg(F.percentile_approx(F.col("_commit_lsn").cast("bigint"), 0.5)).first()[0] or 0
    t, first = target(spark, "users"), c.where(F.col("_commit_lsn") <= edge)
    apply_changes(t, first, ("user_id",), end_of(first), types=USER_TYPES)
    apply_changes(t, first, ("user_id",), end_of(first))  # the same batch again
    apply_changes(t, c.where(F.col("_commit_lsn") > edge - 200), ("user_id",), end_of(c))  # overlaps what was applied
    return user_table(spark, t)


@query("SELECT CASE WHEN count(DISTINCT event_type) < 5 THEN '0/0' ELSE printf('%X/%X', min(m) // 4294967296, min(m) % 4294967296) END AS start_lsn FROM (SELECT event_type, max(event_id) AS m FROM events GROUP BY event_type)")
def checkpoint_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest checkpoint over all tables."""
    at = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("checkpoint_key")).agg(lsn.lsn_to_text(F.max("event_id").cast(lsn.LSN_TYPE)).alias("last_committed_lsn"))
    keys = spark.createDataFrame([(k,) for k in ("click", "error", "purchase", "signup", "view")], "checkpoint_key string")
    return start_lsn(at, keys)


@query("SELECT '0/5' AS start_lsn")
def checkpoint_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without a checkpoint sends the start to the default."""
    at = table(spark, sf_dir, "region").select(F.col("r_name").alias("checkpoint_key"), F.lit("0/10").alias("last_committed_lsn"))
    return start_lsn(at, at.select("checkpoint_key").unionByName(spark.createDataFrame([("nowhere",)], "checkpoint_key string")), "0/5")


@query(_LAST.format(src="events") + " AND event_type <> 'error'")
def snapshot_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed snapshot up to a boundary, then the stream's changes after it."""
    e, c = table(spark, sf_dir, "events"), changelog(spark, sf_dir)
    edge = e.agg(F.percentile_approx("event_id", 0.4)).first()[0] or 0
    edge = (edge // 10) * 10 + 9  # the end of a transaction
    last = e.where(F.col("event_id") <= edge).groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), "event_id").alias("x")).where("x.event_type <> 'error'")
    snapshot = scan(last.select("user_id", "x.event_type", "x.value"), columns=["user_id", "event_type", "value"], where="user_id is not null")
    t, at = target(spark, "users"), lsn.to_text(edge + 1)
    run_snapshot({SPECS[0]: snapshot}, at, lambda spec, rows: apply_snapshot(t, payload(rows), ("user_id",), at) and None)
    apply_changes(t, c, ("user_id",), end_of(c))  # from the start: the table skips what the snapshot holds
    return user_table(spark, t)


@query("SELECT user_id, event_id, CASE WHEN active THEN 'entered' ELSE 'cleared' END AS edge FROM (SELECT *, lag(active, 1, false) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM (SELECT user_id, event_id, greatest(event_id * 37 % 1000 - event_id * 11 % 700, 0) > 300 AS active FROM events)) WHERE active <> was")
def lag_backpressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the lag of a source crosses its limit, in either direction."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.greatest(F.col("event_id") * 37 % 1000 - F.col("event_id") * 11 % 700, F.lit(0)) > 300).alias("active"))
    return backpressure_edges(e, "active", "event_id", ["user_id"]).select("user_id", "event_id", "edge")


@query("SELECT event_type, CAST(user_id % 5 AS BIGINT) AS source, 'value' AS measurement, min(value) AS min, max(value) AS max, arg_max(value, event_id) AS last, round(avg(value), 6) AS avg, count(*) AS count FROM events GROUP BY ALL")
def telemetry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of each event and source."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("source"), "event_id", F.create_map(F.lit("value"), F.col("value")).alias("measurements"))
    return summarize(e, ["event_type", "source"], "event_id").withColumn("avg", F.round("avg", 6))


@query("SELECT row_number() OVER (ORDER BY event_id) AS position, event_id, event_type AS kind FROM events")
def append_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended rows with synthetic positions."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"))
    rows, t = numbered_rows(e, ["event_id"], "position"), target(spark, "events")
    rows = rows.withColumn("at", F.col("position").cast(lsn.LSN_TYPE))
    n = e.count()
    append_rows(t, rows.where(F.col("position") <= n // 2), lsn.to_text(n // 2), at="at")
    append_rows(t, rows, lsn.to_text(n), at="at")  # the first half again: skipped row by row
    return t.read().select("position", "event_id", "kind")


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'renamed' ELSE s_name END AS s_name, concat('a long value of ', s_name) AS note FROM supplier WHERE s_suppkey % 7 <> 0")
def toast_unchanged_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts, updates that leave a large value unchanged, and deletes as protocol messages through the
    converter into a table: the value stays. Messages are converted where the rows are."""
    workers_ready(spark)
    columns = [{"name": "s_suppkey", "key": True}, {"name": "s_name", "key": False}, {"name": "note", "key": False}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Converter()
        c.convert(Message("relation", {"id": 1, "schema": "public", "table": "supplier", "columns": columns}))
        for b in batches:
            out: list[dict[str, Any]] = []
            for key, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row = [str(key), name, f"a long value of {name}"]
                said = [Message("insert", {"relation_id": 1, "new": row})]
                if key % 3 == 0:
                    said.append(Message("update", {"relation_id": 1, "identity": "full", "old": row, "new": [row[0], "renamed", UNCHANGED]}))
                if key % 7 == 0:
                    said.append(Message("delete", {"relation_id": 1, "identity": "key", "old": [row[0], None, None]}))
                for seq, e in enumerate(map(c.convert, said)):
                    out.append({"_op": e.kind[0].upper(), "_seq": 10 * key + seq, "_record": e.record, "_old_record": e.old_record})
            text = pa.map_(pa.string(), pa.string())
            plain = lambda r: None if r is None else list(r.items())
            yield pa.record_batch({"_op": pa.array([r["_op"] for r in out], pa.string()), "_seq": pa.array([r["_seq"] for r in out], pa.int64()), "_record": pa.array([plain(r["_record"]) for r in out], text), "_old_record": pa.array([plain(r["_old_record"]) for r in out], text)})

    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")
    changes = rows.mapInArrow(run, "_op string, _seq long, _record map<string,string>, _old_record map<string,string>")
    changes = changes.withColumn("_commit_lsn", F.when(F.col("_op") == "I", 16).otherwise(32).cast(lsn.LSN_TYPE))
    t = target(spark, "supplier")
    types = {"s_suppkey": T.LongType()}
    apply_changes(t, changes.where("_op = 'I'"), ("s_suppkey",), "0/10", types=types)
    apply_changes(t, changes.where("_op <> 'I'"), ("s_suppkey",), "0/20")
    return t.read().select("s_suppkey", "s_name", "note")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, props FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON column; the column is kept as text."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "props")


@query("SELECT user_id, array_to_string(list_slice(l, 1, 3), ',') AS items, len(l) > 3 AS truncated, CAST(len(l) AS BIGINT) AS original_count FROM (SELECT user_id, list_sort(list(event_id)) AS l FROM events GROUP BY user_id)")
def term_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long lists cut with a mark and their length."""
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("l"))
    return lists.select("user_id", terms.truncated_list(F.col("l"), 3).alias("t")).select("user_id", F.array_join(F.col("t.items").cast("array<string>"), ",").alias("items"), "t.truncated", "t.original_count")


@query("SELECT event_id, epoch_us(ts) - 946684800000000 AS pg_us, ts AS back FROM events")
def pg_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microseconds since 2000 and back."""
    us = table(spark, sf_dir, "events").select("event_id", pg_microseconds(F.col("ts").cast("timestamp")).alias("pg_us"))
    return us.withColumn("back", pg_timestamp(F.col("pg_us")).cast("timestamp_ntz"))


@query("SELECT event_type AS name, CASE WHEN event_type = 'click' THEN 'integer' WHEN event_type = 'view' THEN 'double' WHEN event_type = 'error' THEN 'json' ELSE 'string' END AS kind FROM (SELECT DISTINCT event_type FROM events)")
def kind_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of a column's values joined over all rows."""
    even = F.col("event_id") % 2 == 0
    kind = F.when(F.col("event_type") == "click", F.when(even, "integer").otherwise("nil")).when(F.col("event_type") == "view", F.when(even, "integer").otherwise("double")).when(F.col("event_type") == "error", F.when(even, "json").otherwise("string")).otherwise(F.when(even, "boolean").otherwise("integer"))
    return kinds_by_rank(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), kind.alias("kind")), "kind", "name")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'new' END AS kind, CAST(value AS VARCHAR) IS NOT NULL AS has_value FROM events")
def toast_back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that an update left out as unchanged come from the old record."""
    e = table(spark, sf_dir, "events")
    old = _text_map(("kind", F.col("event_type")), ("value", F.col("value")))
    new = _text_map(("kind", F.lit("new")), ("value", F.lit("0")))
    unchanged = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("kind"), F.lit("value"))).otherwise(F.array(F.lit("value")))
    return e.select("event_id", back_fill(new, old, unchanged).alias("r")).select("event_id", F.col("r")["kind"].alias("kind"), F.col("r")["value"].isNotNull().alias("has_value"))


@query("SELECT CASE event_type WHEN 'signup' THEN 'I' WHEN 'click' THEN 'U' WHEN 'error' THEN 'D' WHEN 'view' THEN 'R' ELSE 'T' END AS op, count(*) AS n FROM events GROUP BY ALL")
def op_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by op code."""
    kind = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "click", "update").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "snapshot").otherwise("truncate")
    return table(spark, sf_dir, "events").select(op_code(kind).alias("op")).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


# The query surface over mirrored tables is Spark SQL itself; one query for each of its categories.


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 10")
def l1_scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").orderBy("event_id").limit(10)


@query("SELECT o_orderkey, upper(o_orderpriority) AS priority, year(o_orderdate) AS y, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def l2_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F"))
    return o.select("o_orderkey", F.upper("o_orderpriority").alias("priority"), F.year("o_orderdate").cast("bigint").alias("y"), F.floor("o_totalprice").cast("bigint").alias("price"))


@query("SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def l3_join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def l3_join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def l3_join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def l3_join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def l3_join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full").select("k", "customers", "suppliers")


@query("SELECT s_suppkey, count(p_partkey) AS parts FROM supplier LEFT JOIN part ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 50 GROUP BY s_suppkey")
def l3_join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join as an equi-join on bins as wide as the range: each supplier looks into the two
    bins that its range can touch."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.explode(F.sequence(F.floor(F.col("s_acctbal") / 50), F.floor(F.col("s_acctbal") / 50) + 1)).alias("bin"))
    p = table(spark, sf_dir, "part").select("p_retailprice", F.floor(F.col("p_retailprice") / 50).alias("bin"))
    hit = (p.p_retailprice >= s.s_acctbal) & (p.p_retailprice <= s.s_acctbal + 50)
    return s.join(p, (s.bin == p.bin) & hit, "left").groupBy("s_suppkey").agg(F.count("p_retailprice").alias("parts"))


@query("SELECT p.event_id, max(c.event_id) AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON c.user_id = p.user_id AND c.event_id <= p.event_id GROUP BY p.event_id")
def l3_join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click at or before each purchase of its user: one sort for each user, no pairs."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "click"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("click_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", "click_id")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def l4_group_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(20)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY ALL")
def l4_group_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.sum(F.bround("l_quantity", 0).cast("bigint")).alias("quantity"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def l4_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {o} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))", o=table(spark, sf_dir, "orders"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def l4_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def l4_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, row_number() OVER w AS rn, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rk, lag(event_id) OVER w AS before, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def l5_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.row_number().over(w).cast("bigint").alias("rn"), F.rank().over(Window.partitionBy("user_id").orderBy("event_type")).cast("bigint").alias("rk"), F.lag("event_id").over(w).alias("before"), F.count(F.lit(1)).over(w.rowsBetween(-2, 0)).alias("n3"))


@query("(SELECT c_nationkey AS k FROM customer UNION SELECT n_nationkey FROM nation) EXCEPT (SELECT s_nationkey FROM supplier INTERSECT SELECT n_regionkey FROM nation)")
def l6_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, s = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    both = c.select(F.col("c_nationkey").alias("k")).union(n.select("n_nationkey")).distinct()
    return both.subtract(s.select("s_nationkey").intersect(n.select("n_regionkey")))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n FROM events GROUP BY ALL")
def l7_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.from_json("props", "k BIGINT").alias("p"))
    return e.select((F.col("p.k") % 10).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def l8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)
