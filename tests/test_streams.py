import os
import threading

import pytest
from tests.test_pgoutput import begin, commit, delete, insert, relation, truncate, update

from tidemill.functions import lsn
from tidemill.operators.store import VersionedTable, register_views
from tidemill.plans.specs import ConfigError, IngestConfig, StreamConfig, TableSpec
from tidemill.sources import frames as fr
from tidemill.sources import snapshot as sn
from tidemill.sources.setup import Source
from tidemill.streaming.batches import BatchBuffer, BatchQueue, QueueOverflow
from tidemill.streaming.meta import SqliteMetaStore, start_lsn, statements, with_retries
from tidemill.streaming.runtime import AppendStream, LagGuard, LagLimit, Manager, start_stream

USERS = {"source_schema": "public", "source_table": "users", "target_schema": "raw", "target_table": "users", "primary_keys": ["id"]}


def config(tmp_path, **more):
    return StreamConfig.from_dict({"source_name": "app", "root": f"file://{tmp_path}/lake", "meta_path": str(tmp_path / "meta.db"), "tables": [USERS], "checkpoint_location": str(tmp_path / "cp"), "buckets": 3} | more)


def test_mirror_end_to_end(spark, tmp_path):
    """Snapshot, changes, a new column, a truncate, and a restart after changes made offline."""
    spark.dataSource.register(fr.FramesDataSource)
    wal, c = str(tmp_path / "wal"), config(tmp_path)
    os.makedirs(wal)
    changes = lambda at: spark.readStream.format("tidemill_frames").option("path", wal).option("startLsn", at).load()
    snap = spark.createDataFrame([(1, "alice"), (2, "bob")], "id int, name string")
    start = lambda: start_stream(spark, c, changes, lambda s: snap, lambda: "0/10", trigger={"processingTime": "200 milliseconds"})
    h = start()
    t = h.table("raw", "users")
    got = lambda *cols: sorted(tuple(r) for r in t.read().select(*cols).collect())
    try:
        assert t.manifest().n_buckets == 3 and h.snapshot_counts == {"raw.users": 2} and got("id", "name") == [(1, "alice"), (2, "bob")]
        fr.write_segment(wal, "001", [relation(), begin(1, 0x18), update(("1", "alice-2"), ("1", "alice")), delete("2", "bob"), insert("3", "carol"), commit(0x18, 0x20)])
        h.flush()
        assert got("id", "name") == [(1, "alice-2"), (3, "carol")]
        assert h.meta.fetch_checkpoint("app:public.users") == "0/20"
        wide = relation(columns=(("id", 1), ("name", 0), ("email", 0)))
        fr.write_segment(wal, "002", [wide, begin(2, 0x28), update(("1", "alice-2", "alice@x"), ("1", "alice-2", None)), insert("6", "frank", "frank@x"), commit(0x28, 0x30)])
        h.flush()
        assert got("id", "email") == [(1, "alice@x"), (3, None), (6, "frank@x")]
        fr.write_segment(wal, "003", [begin(3, 0x38), truncate(1), commit(0x38, 0x40), begin(4, 0x48), insert("4", "dave", None), commit(0x48, 0x50)])
        h.flush()
        assert got("id") == [(4,)]
    finally:
        h.stop()
    fr.write_segment(wal, "004", [begin(5, 0x58), insert("5", "erin", None), commit(0x58, 0x60), begin(6, 0x68), insert("99", "open", None)])
    h = start()
    try:
        h.flush()
        assert got("id") == [(4,), (5,)] and h.snapshot_counts == {}
        assert h.meta.fetch_handoff("app")["state"] == "complete" and h.stats()["checkpoints"] == {"app:public.users": "0/60"}
    finally:
        h.stop()
    register_views([t])
    assert spark.sql("SELECT count(*) FROM raw_users").first()[0] == 2


def test_snapshot_plans():
    p = sn.plan_snapshot
    pending, complete = {"state": "pending", "boundary_lsn": "0/30"}, {"state": "complete", "boundary_lsn": "0/30"}
    with pytest.raises(sn.SnapshotPlanError, match="incomplete"):
        p(pending, "0/10", resume=False)
    assert p(pending, "0/30") == sn.SnapshotPlan(False, "0/30")
    assert p(pending, "0/20").run
    with pytest.raises(sn.SnapshotPlanError, match="requires"):
        p(pending, "0/20", before_stream=False)
    assert p(complete, "0/30", on_restart=True).run and not p(complete, "0/30").run
    assert p(None, "0/0").run and not p(None, "0/5").run and p(None, "0/5", on_restart=True).run and not p(None, "0/0", before_stream=False).run


def test_snapshot_rows(spark):
    assert sn.replayed_rows("0/34", "0/35", 3) == 2 and sn.replayed_rows(None, "0/35", 3) == 0 and sn.replayed_rows("1/0", "0/35", 3) == 3
    df = spark.createDataFrame([(i, f"n{i}") for i in range(7)], "id long, name string")
    got = sn.numbered(df, "0/35", ["id"]).orderBy("id").collect()
    assert [int(r["_commit_lsn"]) for r in got] == [0x35 - 7 + 1 + i for i in range(7)]
    tagged = sn.tag(df, TableSpec.from_dict(USERS), "0/35")
    assert tagged.first()["_op"] == "R" and sn.payload(tagged).columns == ["id", "name"]
    assert sn.scan(df, ["name"], "id > 3", ["name"]).count() == 3
    for bad in ("1=1; drop", "a -- b", "/* x", " "):
        with pytest.raises(ConfigError):
            sn.scan(df, where=bad)
    assert df.select(sn.as_map(df).alias("m")).first()["m"] == {"id": "0", "name": "n0"}


def test_meta_store(tmp_path, spark):
    m = SqliteMetaStore(str(tmp_path / "m.db")).bootstrap()
    assert m.version() == 2 and m.fetch_checkpoint("a") == "0/0"
    m.upsert_checkpoint("a", "0/20")
    m.upsert_checkpoint("b", "0/9")
    assert m.fetch_start_lsn(["a", "b"]) == "0/9" and m.fetch_start_lsn(["a", "c"], "0/5") == "0/5" and m.fetch_start_lsn([]) == "0/0"
    m.upsert_checkpoint("a", "0/10")
    assert m.fetch_checkpoint("a") == "0/20"  # never backwards
    assert m.fetch_handoff("s") is None
    m.mark_pending("s", "0/16B6A98")
    assert m.fetch_handoff("s")["state"] == "pending" and m.fetch_handoff("s")["completed_at"] is None
    m.mark_complete("s", "0/16B6C40")
    assert m.fetch_handoff("s")["completed_at"]
    m.clear_handoff("s")
    assert m.fetch_handoff("s") is None
    m.migrate_down(0)
    assert m.version() == 0
    assert statements("-- x\nCREATE a; -- y\n DROP b;\n") == ["CREATE a", "DROP b"]
    tries = []
    with pytest.raises(RuntimeError):
        with_retries(lambda: tries.append(1) or (_ for _ in ()).throw(RuntimeError()))
    assert len(tries) == 3
    cps = spark.createDataFrame([("a", "0/20"), ("b", "0/9")], "checkpoint_key string, last_committed_lsn string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "checkpoint_key string")
    assert start_lsn(cps, keys("a", "b")).first()[0] == "0/9" and start_lsn(cps, keys("a", "z"), "0/5").first()[0] == "0/5"


def test_buffers_and_queues():
    b = BatchBuffer(IngestConfig(max_rows=2, max_bytes=1000, flush_interval_ms=500))
    assert b.append({}, "0/10", 0, 10) is None
    out = b.append({}, "0/11", 1, 10)
    assert (out.row_count, out.byte_count, out.lsn_start, out.lsn_end) == (2, 20, "0/10", "0/11") and b.flush() is None
    b = BatchBuffer(IngestConfig(max_bytes=15, flush_interval_ms=500))
    assert b.append({}, "0/1", 1000, 10) is None and not b.due(1400) and b.due(1500)
    assert b.append({}, "0/2", 1001, 6).byte_count == 16
    q = BatchQueue(1, 1)
    assert q.push(1) == [1] and q.push(2) == []
    with pytest.raises(QueueOverflow):
        q.push(3)
    dropped = []
    q = BatchQueue(1, 1, "drop_oldest", dropped.append)
    q.push(1), q.push(2), q.push(3)
    assert dropped == [2] and q.done(1) == [3]


def test_append_stream(spark, tmp_path):
    seen = []
    c = config(tmp_path, tables=[USERS | {"target_table": "events", "primary_keys": []}], ingest={"max_rows": 2})
    s = AppendStream(spark, c, observer=lambda kind, x: seen.append(kind))
    assert s.append("raw.events", {"id": 1, "kind": "a"}) == "0/1"
    s.append("raw.events", {"id": 2, "kind": "b"})
    s.append("raw.events", {"id": 3, "kind": "c"}, at="0/10")
    with pytest.raises(LookupError):
        s.append("raw.other", {})
    s.stop()
    t = VersionedTable(spark, c.root, "raw", "events")
    assert t.read().count() == 3 and t.manifest().applied_lsn == "0/10" and seen == ["batch_result"] * 2
    again = AppendStream(spark, c)  # goes on after what was applied
    assert again.append("raw.events", {"id": 4, "kind": "d"}) == "0/11"
    again.flush("raw.events")
    assert t.read().count() == 4 and again.meta.fetch_checkpoint("app:public.users") == "0/11"


class Slow(AppendStream):
    """Writes only when told to."""

    def __init__(self, *args, **kwargs):
        self.go, self.written = threading.Semaphore(0), []
        super().__init__(*args, **kwargs)

    def _write(self, name, batch):
        self.go.acquire()
        self.written.append([r["id"] for r in batch.rows])


@pytest.mark.parametrize("overflow", ["fail", "drop_oldest"])
def test_append_queue_is_bounded(spark, tmp_path, overflow):
    events = []
    c = config(tmp_path, tables=[USERS | {"primary_keys": []}], ingest={"max_rows": 1, "max_pending": 2, "overflow": overflow})
    s = Slow(spark, c, emit=lambda e, m, about: events.append((e[-1], m)))
    for i in range(3):  # one in flight, two that wait; append() doesn't block
        s.append("raw.users", {"id": i})
    if overflow == "fail":
        with pytest.raises(QueueOverflow):
            s.append("raw.users", {"id": 3})
    else:
        s.append("raw.users", {"id": 3})
        assert ("batch_dropped", {"rows": 1}) in events
    s.go.release(10)
    s.stop()
    assert s.written == ([[0], [1], [2]] if overflow == "fail" else [[0], [2], [3]])
    assert ("batch_queue", {"inflight": 1, "pending": 2}) in events and not s.thread.is_alive()
    with pytest.raises(RuntimeError):
        s.append("raw.users", {"id": 9})


def test_append_flushes_by_age(spark, tmp_path):
    c = config(tmp_path, tables=[USERS | {"primary_keys": []}], ingest={"flush_interval_ms": 40})
    s = Slow(spark, c)
    s.go.release(10)
    s.append("raw.users", {"id": 1})
    for _ in range(200):
        if s.written:
            break
        threading.Event().wait(0.02)
    assert s.written == [[1]]  # without tick() or flush()
    s.stop()


def test_append_stops_at_an_error(spark, tmp_path):
    class Broken(AppendStream):
        def _write(self, name, batch):
            raise OSError("no disk")

    seen = []
    s = Broken(spark, config(tmp_path, tables=[USERS | {"primary_keys": []}]), observer=lambda kind, x: seen.append((kind, str(x))))
    s.append("raw.users", {"id": 1})
    with pytest.raises(RuntimeError) as e:
        s.flush()
    assert str(e.value.__cause__) == "no disk" and seen == [("stopped", "no disk")]
    s.stop()


def test_lag_guard(tmp_path):
    events = []
    g = LagGuard(config(tmp_path, max_lag_bytes=100), lambda e, m, about: events.append((e[-1], m.get("lag_bytes"), about.get("status"))))
    assert g.check(150, 60) == 90 and g.check(100, 150) == 0
    with pytest.raises(LagLimit, match="250 bytes"):
        g.check(400, 150)
    assert ("backpressure", 250, "entered") in events and ("lag", 250, None) in events and ("connection", None, "lag_exceeded") in events
    assert g.check(400, 390) == 10 and ("backpressure", 10, "cleared") in events


def segments(folder, n=40, per_segment=3):
    """A log of n transactions, whose segments end within transactions, with a column added half-way; the
    frames of transaction k repeat k - 1 now and then, as after a reconnection."""
    frames, want = [relation()], []
    for k in range(1, n + 1):
        if k == n // 2:
            frames.append(relation(columns=(("id", 1), ("name", 0), ("email", 0))))
        row = (str(k), f"name {k}", *([f"mail {k}"] if k >= n // 2 else []))
        one = [begin(k, 16 * k), insert(*row), insert(f"{k}-b", *row[1:]), commit(16 * k, 16 * k + 8)]
        frames += one * (2 if k % 7 == 0 else 1)
        want += [(16 * k + 8, j, dict(zip(("id", "name", "email"), (i, *row[1:]), strict=False))) for j, i in enumerate((str(k), f"{k}-b"))]
    for s, at in enumerate(range(0, len(frames), per_segment)):
        fr.write_segment(folder, f"{s:04}", frames[at : at + per_segment])
    return want


@pytest.mark.parametrize("most", [1, 300, 1 << 20])
def test_frames_are_read_by_many_tasks(spark, tmp_path, most):
    spark.dataSource.register(fr.FramesDataSource)
    wal = str(tmp_path / "wal")
    want = segments(wal)
    df = spark.read.format("tidemill_frames").option("path", wal).option("maxPartitionBytes", most).load()
    assert df.rdd.getNumPartitions() == {1: 40, 1 << 20: 1}.get(most, df.rdd.getNumPartitions())
    assert sorted(((int(r[0]), r[1], r[2]) for r in df.select("_commit_lsn", "_seq", "_record").collect()), key=lambda r: r[:2]) == want
    late = spark.read.format("tidemill_frames").option("path", wal).option("maxPartitionBytes", most).option("startLsn", lsn.to_text(16 * 30 + 8)).load()
    assert sorted(int(r[0]) for r in late.select("_commit_lsn").distinct().collect()) == [16 * k + 8 for k in range(31, 41)]


def test_log_reads_what_was_added(tmp_path, monkeypatch):
    wal = str(tmp_path / "wal")
    segments(wal)
    got = lambda spans: [t.end_lsn for s in spans for t in s.transactions()]
    log, opened = fr.Log(wal), []
    log.refresh()
    read = log._read
    monkeypatch.setattr(log, "_read", lambda name: opened.append(name) or read(name))
    all_of = [16 * k + 8 for k in range(1, 41)]
    assert got(log.spans(0, 1 << 60, 200)) == all_of
    opened.clear()
    log.forget(all_of[24])
    assert log.after(0) == all_of[25:] and len(log.relations) == 1 and log.spans(all_of[30], all_of[31], 1)[0].start == all_of[30]
    fr.write_segment(wal, "9000", [begin(50, 800), insert("50", "x", "y")])
    log.refresh()
    assert opened == ["9000.frames"] and got(log.spans(all_of[25], 1 << 60, 200)) == all_of[26:]
    fr.write_segment(wal, "9001", [commit(800, 808), begin(51, 816)])
    log.refresh()
    last = log.spans(all_of[-1], 808, 200)
    assert opened[-1] == "9001.frames" and got(last) == [808] and len(last[0].pieces) <= 3  # only its own bytes
    assert got(log.spans(0, 808, 200)) == [*all_of, 808]  # asked for what it forgot: from the start again
    fr.write_segment(wal, "9002", [begin(52, 832)])
    with pytest.raises(ValueError, match="unexpected_begin"):
        log.refresh()
    assert fr.Log(str(tmp_path)).spans(0, 9, 1) == []


def test_stream_with_a_source(spark, tmp_path):
    """Setup, publication and slot, the snapshot's transaction, events, and the guard, in one start."""
    spark.dataSource.register(fr.FramesDataSource)
    wal, said, events, at = str(tmp_path / "wal"), [], [], {"head": "0/30"}
    os.makedirs(wal)
    changes = lambda at: spark.readStream.format("tidemill_frames").option("path", wal).option("startLsn", at).load()
    snap = spark.createDataFrame([(1, "alice")], "id int, name string")

    def run(sql, params):
        said.append(sql.split(" FROM ")[0].split("(")[0].strip())
        return [("f",)] if "relreplident" in sql else [("snap-1",)] if "export" in sql else [("0/10",)] if "current_wal" in sql else [("s", "0/8")] if "create_logical" in sql else []

    c = config(tmp_path, catalog="main", setup_sql="CREATE OR REPLACE TEMP VIEW made_by_setup AS SELECT 1 AS x", max_lag_bytes=1000)
    h = start_stream(spark, c, changes, lambda s: snap, trigger={"processingTime": "200 milliseconds"}, head=lambda: at["head"], source=Source(run, "pub", "slot"), setup=lambda s: said.append("setup"), emit=lambda e, m, about: events.append((".".join(e[1:]), about.get("status"))))
    try:
        assert said[0] == "setup" and said[-1] == "COMMIT" and "BEGIN ISOLATION LEVEL REPEATABLE READ READ ONLY" in said and any(x.startswith("CREATE PUBLICATION") for x in said)
        assert spark.table("made_by_setup").first().x == 1 and "/main/raw/users" in h.table("raw", "users").folder and h.start_lsn == "0/10"
        fr.write_segment(wal, "001", [relation(), begin(1, 0x18), insert("3", "carol"), commit(0x18, 0x20)])
        h.flush()
        assert h.table("raw", "users").read().count() == 2
        assert {("cdc.connection", "started"), ("cdc.event", "upserts"), ("batch.processed", "ok"), ("cdc.lag", None), ("service.ack_checkpoint_lag", None)} <= set(events)
        at["head"] = "0/FFFF"
        fr.write_segment(wal, "002", [begin(2, 0x28), insert("4", "dave"), commit(0x28, 0x30)])
        with pytest.raises(Exception, match="bytes behind"):
            h.flush()
    finally:
        h.stop()
    said.clear()
    fail = lambda s: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(OSError):
        start_stream(spark, config(tmp_path / "b", meta_path=str(tmp_path / "b.db")), changes, fail, source=Source(run, "pub", "slot"))
    assert said[-1] == "ROLLBACK"
    with pytest.raises(ConfigError, match="boundary"):
        start_stream(spark, config(tmp_path, catalog="main", snapshot_on_restart=True), changes, lambda s: snap)


def test_failed_batch_comes_again(spark, tmp_path):
    """A checkpoint that can't be written fails the batch; its replay changes nothing."""
    from tests.test_apply import batch

    from tidemill.streaming.runtime import process_batch
    from pyspark.sql import functions as F

    c = config(tmp_path)
    meta = SqliteMetaStore(c.meta_path).bootstrap()
    b = batch(spark, "0/13", ("I", {"id": 1})).withColumns({"_relation_schema": F.lit("public"), "_relation_table": F.lit("users")})

    class Broken:
        upsert_checkpoint = lambda *_: (_ for _ in ()).throw(OSError("no disk"))

    with pytest.raises(OSError):
        process_batch(spark, c, Broken(), b)
    assert process_batch(spark, c, meta, b)["raw.users"]["deduped"]
    assert VersionedTable(spark, c.root, "raw", "users").read().count() == 1 and meta.fetch_checkpoint("app:public.users") == "0/13"


def test_manager():
    m = Manager()
    with pytest.raises(LookupError):
        m.stop("x")
    assert m.names() == [] and threading.active_count() > 0 and lsn.parse("0/1") == 1
