import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import lsn, terms, types


@given(st.integers(0, (1 << 64) - 1))
def test_lsn_round_trip(x):
    assert lsn.parse(lsn.to_text(x)) == x
    assert lsn.parse(lsn.decode_binary(lsn.encode_binary(x))) == x


def test_lsn_order_and_errors():
    assert lsn.to_text(lsn.parse("16/B374D848")) == "16/B374D848"
    assert lsn.compare("0/1", "0/2") < 0 and lsn.latest("0/A", "0/10", None) == "0/10" and lsn.latest() is None
    assert lsn.lag_bytes(5, 9) == 0
    for bad in ("bad", "0/", "0/1\n", "0/1FFFFFFFF", "", None):
        with pytest.raises(ValueError):
            lsn.parse(bad)


def test_lsn_columns(spark):
    xs = [0, 1, 4294967291, (1 << 32) - 1, 1 << 32, (1 << 63) + 5, (1 << 64) - 1]
    df = spark.createDataFrame([(Decimal(x),) for x in xs], "x decimal(20,0)").withColumn("t", lsn.lsn_to_text(F.col("x")))
    got = df.withColumn("back", lsn.lsn_from_text(F.col("t"))).collect()
    assert [r.t for r in got] == [lsn.to_text(x) for x in xs]
    assert [int(r.back) for r in got] == xs
    odd = spark.createDataFrame([("bad",), (None,)], "t string")
    assert [r[0] for r in odd.select(lsn.lsn_from_text(F.col("t"), strict=False)).collect()] == [None, None]
    with pytest.raises(Exception, match="invalid LSN"):
        odd.select(lsn.lsn_from_text(F.col("t"))).collect()


def test_kind_lattice():
    kinds = list(types.KIND_TYPES)
    for a in kinds:
        for b in kinds:
            assert types.merge_kinds(a, b) == types.merge_kinds(b, a)
            for c in kinds:
                assert types.merge_kinds(types.merge_kinds(a, b), c) == types.merge_kinds(a, types.merge_kinds(b, c)) or "nil" in (a, b, c) or len({a, b, c} & {"integer", "double"}) == 2
    assert types.infer_columns([{"b": 1, "a": None}, {"b": 1.5, "c": {"x": 1}}]) == {"a": "nil", "b": "double", "c": "json"}
    assert types.kind_of(True) == "boolean" and types.kind_of(Decimal("1")) == "double" and types.kind_of(dt.date(2020, 1, 1)) == "date"
    assert types.kind_of(dt.datetime(2020, 1, 1)) == "timestamp" and types.kind_of(dt.datetime(2020, 1, 1, tzinfo=dt.UTC)) == "timestamptz"


def test_casts(spark):
    df = spark.createDataFrame([(2.5, "2.5", Decimal("2.50"), "t", " 7 "), (3.5, "1.5", Decimal("3.50"), "false", "-3")], "d double, s string, m decimal(10,2), b string, w string")
    got = df.select(types.cast_column(F.col("d"), "double", "bigint"), types.cast_column(F.col("s"), "string", "bigint"), types.cast_column(F.col("m"), "decimal(10,2)", "bigint"), types.cast_column(F.col("b"), "string", "boolean"), types.cast_column(F.col("w"), "string", "int")).collect()
    assert [tuple(r) for r in got] == [(2, 3, 3, True, 7), (4, 2, 4, False, -3)]
    with pytest.raises(Exception):
        spark.createDataFrame([("abc",)], "s string").select(types.cast_column(F.col("s"), "string", "bigint")).collect()


def test_types_and_epoch(spark):
    assert types.compatible("DOUBLE", "bigint") and types.compatible("varchar", "DATE") and not types.compatible("INTEGER", "BIGINT")
    with pytest.raises(ValueError):
        types.normalize_type("STRUCT(a INTEGER[])")
    assert types.pg_datetime(1_000_000) == dt.datetime(2000, 1, 1, 0, 0, 1, tzinfo=dt.UTC)
    us = spark.range(1).select(types.pg_microseconds(types.pg_timestamp(F.lit(123456))).alias("x")).first().x
    assert us == 123456


def test_terms():
    assert terms.normalize_term([1, 2, 3], items=2, depth=3) == {"type": "list", "items": [1, 2], "truncated": True, "original_count": 3}
    cut = terms.normalize_term({"a": 1, "b": 2, "c": 3}, items=2, depth=3)
    assert cut == {"a": 1, "b": 2, "__truncated__": True, "__original_count__": 3}
    assert terms.normalize_term({"a": {"b": {"c": 1}}}, depth=2) == {"a": {"b": "..."}}
    assert terms.normalize_term({"a": 1, "b": [2]}, depth=1) == {"a": "...", "b": "..."} and terms.normalize_term(7, depth=0) == "..."
    assert terms.normalize_term(dt.date(2020, 1, 2)) == "2020-01-02"
    assert terms.estimate_size({"id": 1, "name": "x" * 500}) == len('{"id":1,"name":""}') + 500
    assert terms.estimate_size({"at": dt.date(2020, 1, 2), "é": Decimal("1.5"), "b": b"x"}) > 30
