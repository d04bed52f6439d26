import pytest
from pyspark.sql import types as T

from tidemill.plans import specs as sp

BASE = {"source_schema": "public", "source_table": "users", "target_schema": "raw", "target_table": "users"}


def test_specs():
    s = sp.TableSpec.from_dict(BASE | {"primary_keys": ["id", "id"]}, "src")
    assert s.primary_keys == ("id",) and s.checkpoint_key == "src:public.users" and s.target == ("raw", "users")
    assert sp.TableSpec.from_dict(BASE).checkpoint_key == "public.users" and sp.TableSpec.from_dict(BASE | {"checkpoint_key": "k"}).checkpoint_key == "k"
    for bad in (BASE | {"mode": "append"}, BASE | {"nope": 1}, {"source_schema": "x"}):
        with pytest.raises(sp.ConfigError):
            sp.TableSpec.from_dict(bad)
    twice = [s, sp.TableSpec.from_dict(BASE | {"target_table": "other"})]
    assert sp.specs_by_source(twice)[("public", "users")].target_table == "other" and set(sp.specs_by_target(twice)) == {("raw", "users"), ("raw", "other")}


def test_selection_and_inference():
    known = {"users": {"primary_keys": ["id"]}, "orders": {}}
    got = sp.select_tables(known, ["users", ("o2", "orders"), {"table": "users", "target_table": "u3", "target_schema": "x"}])
    assert [s.target for s in got] == [("raw", "users"), ("raw", "o2"), ("x", "u3")] and got[2].primary_keys == ("id",)
    with pytest.raises(sp.ConfigError):
        sp.select_tables(known, ["nope"])
    schema = T.StructType([T.StructField("id", T.LongType(), metadata={"primary_key": True}), T.StructField("n", T.StringType())])
    s = sp.infer_spec("shop.users", schema)
    assert s.source == ("shop", "users") and s.primary_keys == ("id",) and sp.infer_spec("users", schema, enabled=False) is None
    with pytest.raises(sp.ConfigError):
        sp.infer_spec("users", schema, ["zip"])


def test_stream_config():
    c = sp.StreamConfig.from_dict({"source_name": "s", "root": "/r", "meta_path": "m", "tables": [BASE], "ingest": {"max_rows": 5}})
    assert c.ingest.max_rows == 5 and c.ingest.max_bytes == 128 << 20 and c.tables[0].checkpoint_key == "s:public.users" and c.resume_incomplete_snapshot
    for bad in ({"source_name": "s", "root": "/r", "meta_path": "m", "tables": [BASE], "buckets": 0}, {"source_name": "s"}, {"source_name": "s", "root": "/r", "meta_path": "m", "tables": [BASE], "x": 1}):
        with pytest.raises(sp.ConfigError):
            sp.StreamConfig.from_dict(bad)
    for bad in ({"max_rows": 0}, {"overflow": "explode"}, {"max_pending": -1}):
        with pytest.raises(sp.ConfigError):
            sp.IngestConfig(**bad)


def test_urls_and_backoff():
    o = sp.parse_url("postgresql://us%40er:p%2Fw@db:6543/my%20db?sslmode=require", port=1)
    assert (o.host, o.port, o.database, o.username, o.password, o.ssl) == ("db", 1, "my db", "us@er", "p/w", True)
    for bad in ("mysql://h/d", "postgres:///d", "postgres://h", "postgres://h/d?sslmode=odd"):
        with pytest.raises(sp.ConfigError):
            sp.parse_url(bad)
    assert sp.parse_url(sp.build_url("a b", "p@", "h", 5, "d")).password == "p@"
    assert sp.build_url(url="ecto://h/d") == "postgres://h/d"
    assert sp.reconnect_backoff(1000, jitter=0.5, draw=lambda: 1.0) == 1500 and sp.reconnect_backoff(10) == 100 and sp.reconnect_backoff(50_000, high_ms=20_000, jitter=0.5, draw=lambda: 1.0) == 20_000
    assert sp.truthy("yes") and not sp.truthy("no")


def test_public_names():
    import tidemill

    assert all(getattr(tidemill, n) for n in tidemill.__all__)
    with pytest.raises(AttributeError):
        tidemill.nothing
