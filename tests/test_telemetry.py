import pytest
from pyspark.sql import functions as F

from tidemill.streaming import telemetry as tl

LAG = ("tidemill", "cdc", "lag")


def test_summaries():
    out = []
    f = tl.Forwarder(out.append, debounce_ms=20)
    f.handle(LAG, {"lag_bytes": 10, "note": "x"}, {"source": "s", "table": ("public", "users")}, 100)
    f.handle(LAG, {"lag_bytes": 20}, {"source": "s", "table": ("public", "users")}, 110)
    f.tick(125)
    assert out == []
    f.tick(130)
    row = out[0]
    assert len(out) == 1 and row["count"] == 2 and row["measurements"]["lag_bytes"] == {"min": 10, "max": 20, "last": 20, "avg": 15, "count": 2}
    assert (row["flush_reason"], row["table_schema"], row["table_name"], row["event"]) == ("debounce", "public", "users", "tidemill.cdc.lag")
    f.handle(LAG, {"lag_bytes": 1}, {}, 200)  # the library's own events are left out for a while
    assert f.flush(300) == 0
    f.handle(LAG, {"lag_bytes": 1}, {}, 2000)
    f.flush(2001)
    assert out[-1]["flush_reason"] == "manual"


def test_window_cap_and_raw():
    out = []
    f = tl.Forwarder(out.append, events=[("app", "x")], debounce_ms=1000, max_window_ms=2500)
    for t in range(0, 4000, 500):
        f.handle(("app", "x"), {"v": 1}, {}, t)
    assert out[0]["flush_reason"] == "max_window" and out[0]["count"] == 5
    raw = []
    f = tl.Forwarder(raw.append, mode="raw", items=2, depth=3)
    f.handle(LAG, {"v": 1}, {"l": [1, 2, 3]}, 0)
    f.handle(("other",), {}, {}, 0)
    assert len(raw) == 1 and raw[0]["metadata"]["l"]["original_count"] == 3
    with pytest.raises(ValueError):
        tl.Forwarder(raw.append, mode="odd")
    with pytest.raises(ValueError):
        tl.Forwarder(raw.append, events=[()])
    bad = tl.Forwarder(lambda row: 1 / 0, mode="raw")
    bad.handle(LAG, {}, {}, 0)
    assert len(bad.errors) == 1


def test_plans(spark):
    e = spark.createDataFrame([(1, 0), (1, 10), (1, 30), (2, 5)], "u long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = tl.islands(e, "ts", 10, ["u"]).groupBy("u", "island").count().orderBy("u", "island").collect()
    assert [tuple(r) for r in got] == [(1, 0, 2), (1, 1, 1), (2, 0, 1)]  # a gap of exactly the limit doesn't part
    b = spark.createDataFrame([(1, i, i % 4 < 2) for i in range(8)], "u long, i long, on boolean")
    assert [r.edge for r in tl.backpressure_edges(b, "on", "i", ["u"]).orderBy("i").collect()] == ["entered", "cleared", "entered", "cleared"]
    m = e.withColumn("measurements", F.create_map(F.lit("s"), F.col("s").cast("double")))
    r = tl.summarize(m, ["u"]).orderBy("u").first()
    assert (r.min, r.max, r["last"], r["count"]) == (0, 30, 30, 3)
