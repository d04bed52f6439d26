from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import lsn
from tidemill.operators import changelog
from tidemill.operators.apply import advance, append_records, append_rows, apply_changes, apply_snapshot
from tidemill.operators.changelog import ChangeError
from tidemill.operators.store import CommitConflict, VersionedTable

S = "_op string, _commit_lsn decimal(20,0), _seq long, _record map<string,string>, _old_record map<string,string>"


def batch(spark, at, *changes):
    rows = []
    for k, c in enumerate(changes):
        op, new, old, where = (*c, None, None, None)[:4]
        text = lambda d: None if d is None else {n: None if v is None else str(v) for n, v in d.items()}
        rows.append((op, Decimal(lsn.parse(where or at)), k, text(new), text(old)))
    return spark.createDataFrame(rows, S)


@pytest.fixture
def users(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}", "raw", "users")


def rows(t, *cols):
    return sorted(tuple(r) for r in t.read().select(*cols).collect())


def put(t, at, *changes, keys=("id",)):
    return apply_changes(t, batch(t.spark, at, *changes), keys, at)


def test_insert_update_delete_truncate(users):
    r = put(users, "0/21", ("I", {"id": 1, "name": "alice"}), ("I", {"id": 2, "name": "bob"}))
    assert r["operations"] == {"truncates": 0, "deletes": 0, "upserts": 2}
    r = put(users, "0/22", ("U", {"id": 1, "name": "alice-2", "age": 31}, {"id": 1, "name": "alice"}), ("D", None, {"id": 2, "name": "bob"}), ("I", {"id": 3, "name": "carol", "age": 28}))
    assert r["operations"] == {"truncates": 0, "deletes": 1, "upserts": 2}
    assert rows(users, "id", "name", "age") == [("1", "alice-2", "31"), ("3", "carol", "28")]
    assert users.read().columns == ["id", "name", "age"]
    r = put(users, "0/23", ("T",))
    assert r["operations"]["truncates"] == 1 and rows(users, "id") == []
    assert users.manifest().applied_lsn == "0/23"


def test_typed_snapshot_then_text(spark, users):
    apply_snapshot(users, spark.createDataFrame([(1, "alice", "seed"), (2, "bob", "x")], "id long, name string, code string"), ("id",), "0/25")
    put(users, "0/26", ("U", {"id": "1", "name": "alice-2", "code": "123"}, {"id": "1"}), ("D", None, {"id": "2"}), ("I", {"id": "3", "name": "carol", "code": "456"}))
    assert rows(users, "id", "name", "code") == [(1, "alice-2", "123"), (3, "carol", "456")]
    with pytest.raises(Exception):
        put(users, "0/27", ("I", {"id": "x", "name": "bad"}))
    assert users.manifest().applied_lsn == "0/26"  # nothing of the failed batch is visible
    assert apply_snapshot(users, spark.createDataFrame([(9,)], "id long"), ("id",), "0/25")["deduped"]


def test_sequence_within_a_batch(users):
    put(users, "0/10", ("I", {"id": 1, "v": "a"}), ("D", None, {"id": 1}), ("I", {"id": 2, "v": "b"}), ("I", {"id": 2, "v": "c"}))
    assert rows(users, "id", "v") == [("2", "c")]  # insert then delete leaves nothing; the last of two inserts wins
    put(users, "0/20", ("I", {"id": 3, "v": "x"}), ("T",), ("I", {"id": 4, "v": "y"}))
    assert rows(users, "id", "v") == [("4", "y")]


def test_key_changes(users):
    put(users, "0/10", ("I", {"id": "A", "v": 1}), ("I", {"id": "C", "v": 3}))
    put(users, "0/20", ("U", {"id": "B", "v": 1}, {"id": "A", "v": 1}), ("U", {"id": "A", "v": 3}, {"id": "C", "v": 3}))
    assert rows(users, "id", "v") == [("A", "3"), ("B", "1")]


def test_columns_outside_the_batch(users):
    put(users, "0/10", ("I", {"id": 1, "a": "x", "b": "y"}), ("I", {"id": 2, "a": "p", "b": "q"}))
    put(users, "0/20", ("U", {"id": 1, "a": "z"}, {"id": 1}), ("D", None, {"id": 2}), ("I", {"id": 2, "a": "new"}))
    assert rows(users, "id", "a", "b") == [("1", "z", "y"), ("2", "new", None)]
    put(users, "0/30", ("U", {"id": 1, "a": "1"}, {"id": 1}), ("U", {"id": 2, "b": "2"}, {"id": 2}))
    assert rows(users, "id", "a", "b") == [("1", "1", None), ("2", None, "2")]  # the union of the batch's columns


def test_replays(spark, users):
    put(users, "0/10", ("I", {"id": 1}, None, "0/5"), ("I", {"id": 2}, None, "0/10"))
    assert put(users, "0/10", ("I", {"id": 7}))["deduped"]
    put(users, "0/20", ("D", None, {"id": 2}, "0/10"), ("I", {"id": 3}, None, "0/20"))  # the first row was applied before
    assert rows(users, "id") == [("1",), ("2",), ("3",)]
    log = VersionedTable(spark, users.folder, "raw", "log")
    df = lambda *xs: spark.createDataFrame([(Decimal(x), x) for x in xs], "at decimal(20,0), x long")
    append_rows(log, df(1, 2, 3), "0/3", at="at")
    append_rows(log, df(2, 3, 4), "0/4", at="at")
    assert rows(log, "x") == [(1,), (2,), (3,), (4,)]


def test_keys_are_needed(users):
    with pytest.raises(ChangeError, match="missing_primary_keys"):
        put(users, "0/10", ("U", {"id": 1}, {"id": 1}), keys=())
    with pytest.raises(ChangeError, match="null_primary_key"):
        put(users, "0/10", ("I", {"id": None}))
    put(users, "0/10", ("I", {"id": 1}), ("R", {"id": 1}), keys=())
    assert rows(users, "id") == [("1",), ("1",)]


def test_append_records(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}", "raw", "events")
    append_records(t, [{"id": i, "kind": "k\\\"x'", "_op": "user data"} for i in range(501)], "0/10")
    assert t.read().count() == 501 and t.read().first()["kind"] == "k\\\"x'" and t.read().first()["_op"] == "user data"
    assert append_records(t, [{"id": 1}], "0/10")["deduped"]
    append_records(t, [{"id": 1.6, "extra": {"a": [1]}}], "0/11")
    assert dict(t.read().dtypes)["id"] == "bigint" and t.read().where("extra is not null").first()["extra"] == '{"a": [1]}'
    assert t.read().where("extra is not null").first()["id"] == 2
    assert advance(t, "0/20")["deduped"] is False and t.manifest().applied_lsn == "0/20"


def test_commits_are_atomic(users):
    put(users, "0/10", ("I", {"id": 1}))
    m = users.manifest()
    users.write(users.read(), m, m.struct)  # a crash before the manifest leaves the table as it was
    assert users.manifest() == m
    users.commit(m)
    with pytest.raises(CommitConflict):
        users.commit(m)
    assert users.vacuum(keep=1) and rows(users, "id") == [("1",)]


def test_only_touched_buckets_are_rewritten(users):
    put(users, "0/10", *[("I", {"id": i, "v": 0}) for i in range(100)])
    before = users.manifest().buckets
    put(users, "0/20", ("U", {"id": 5, "v": 1}, {"id": 5}))
    after = users.manifest().buckets
    assert sum(before[b] != after[b] for b in before) == 1 and users.read().count() == 100


OP = st.one_of(
    st.tuples(st.just("I"), st.integers(0, 4), st.integers(0, 9)),
    st.tuples(st.just("U"), st.integers(0, 4), st.integers(0, 4), st.integers(0, 9)),
    st.tuples(st.just("D"), st.integers(0, 4)),
    st.tuples(st.just("T")),
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(OP, min_size=1, max_size=12))
def test_collapse_equals_one_by_one(spark, ops):
    state, changes = {}, []
    for o in ops:
        if o[0] == "I":
            state[o[1]] = o[2]
            changes.append(("I", {"id": o[1], "v": o[2]}))
        elif o[0] == "U":
            state.pop(o[1], None)
            state[o[2]] = o[3]
            changes.append(("U", {"id": o[2], "v": o[3]}, {"id": o[1]}))
        elif o[0] == "D":
            state.pop(o[1], None)
            changes.append(("D", None, {"id": o[1]}))
        else:
            state.clear()
            changes.append(("T",))
    c = changelog.collapse(batch(spark, "0/10", *changes), ("id",))
    got = {int(r.key[0]): int(r.record["v"]) for r in c.winners.where("put").collect()}
    assert got == state


def test_assemble_ignores_open_transactions(spark):
    e = spark.createDataFrame([(1, "insert", 5, 1), (1, "commit", 9, 2), (2, "insert", 11, 3)], "xid long, kind string, lsn long, ts long")
    assert [(r.xid, r.begin_lsn, r.end_lsn, r.n_changes) for r in changelog.assemble(e).collect()] == [(1, 5, 9, 1)]
    assert changelog.empty_changes(spark).select(F.count("_op")).first()[0] == 0


def test_buckets_grow_with_the_table(spark, tmp_path, monkeypatch):
    """However large the table, a batch rewrites about as many rows for each bucket that it touches."""
    from tidemill.operators import store
    from tidemill.operators.apply import apply_changes

    monkeypatch.setattr(store, "BUCKET_ROWS", 50)
    t = store.VersionedTable(spark, f"file://{tmp_path}", "raw", "t")
    written = []
    for k in range(6):
        ops = [("I", {"id": i, "v": k}) for i in range(k * 200, k * 200 + 200)]
        apply_changes(t, batch(spark, f"0/{k + 1}0", *ops), ("id",), f"0/{k + 1}0", n_buckets=2)
        before = t.manifest().n_buckets
        apply_changes(t, batch(spark, f"0/{k + 1}8", ("I", {"id": 1, "v": 100 + k})), ("id",), f"0/{k + 1}8")
        m = t.manifest()
        if m.n_buckets == before:  # growing rewrites the table once
            written.append(sum(spark.read.parquet(f"{t.folder}/{f}").count() for f in m.buckets.values() if f"v={m.version}-" in f))
    assert t.read().count() == 1200 and t.manifest().n_buckets >= 24 and len(written) >= 5 and max(written) <= 100
    assert t.read().where("id = 1").first().v == "105"


def test_appended_folders_are_merged(spark, tmp_path, monkeypatch):
    from tidemill.operators import store
    from tidemill.operators.apply import append_records

    monkeypatch.setattr(store, "FOLDERS", 3)
    monkeypatch.setattr(store, "VERSIONS", 4)
    t = store.VersionedTable(spark, f"file://{tmp_path}", "raw", "t")
    for k in range(10):
        append_records(t, [{"id": k}], lsn.to_text(k + 1))
        assert t.read().count() == k + 1
    assert len(t.manifest().appended) <= 3 and len(t.files.names(f"{t.folder}/_manifest")) <= 6


def test_a_version_is_published_once(spark, tmp_path):
    """Also by writers that both saw that it wasn't there."""
    import concurrent.futures as cf

    from tidemill.session import Files

    f = Files(spark)
    path = f"file://{tmp_path}/m/1.json"
    with cf.ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda k: f.publish(path, f"writer {k}" * 100), range(24)))
    assert sum(got) == 1 and f.read(path) == f"writer {got.index(True)}" * 100
    assert f.names(f"file://{tmp_path}/m") == ["1.json"]
