import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.functions import columns as fn
from tidemill.functions.naming import plain_names, snake_names
from tidemill.operators import conform, dedupe

from .conftest import rows


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Customer ID", " Amount ($) ", "Ship-Date "])
    assert snake_names(df).columns == ["customer_id", "amount", "ship_date"]
    assert plain_names(df).columns == ["customer_id", "amount", "ship_date"]
    assert snake_names(spark.createDataFrame([(1, 2)], ["ID#x", "Name@"])).columns == ["id_x", "name"]
    assert plain_names(spark.createDataFrame([(1, 2)], ["ID#x", "A B-C"])).columns == ["idx", "a_b_c"]
    for names in (["a", "A "], ["$", "b"]):
        with pytest.raises(ValueError):
            plain_names(spark.createDataFrame([(1, 2)], names))


def test_cast(spark):
    df = spark.createDataFrame([("1", "x", "2024-01-02"), (None, "2.5", "no")], ["a", "b", "c"])
    with pytest.warns(UserWarning):
        out = conform.cast_columns(df, {"a": "integer", "b": "double", "c": "date", "z": "long", "d": "array"})
    assert rows(out) == [(1, None, dt.date(2024, 1, 2)), (None, 2.5, None)]
    assert conform.lost_in_cast(df, {"a": "integer", "b": "double"}).first().asDict() == {"a": 0, "b": 1}


def test_numeric(spark):
    df = spark.createDataFrame([("1", "x", None), ("2.5", "3", None), (None, "4", None)], "a string, b string, c string")
    out, n = conform.numeric_where_whole(df)
    assert n == 1 and dict(out.dtypes) == {"a": "double", "b": "string", "c": "string"}


def test_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (None, "b", None), (3, None, 3.0)], "k long, s string, d double")
    with pytest.warns(UserWarning):
        out = conform.handle_nulls(df, {"k": "drop", "s": "none", "d": "text", "z": 0})
    assert rows(out) == [(1, "a", 1.0), (3, "none", 3.0)]
    assert rows(conform.handle_missing(df, "drop_any")) == [(1, "a", 1.0)]
    assert conform.handle_missing(df, "other").count() == 3
    assert rows(conform.handle_missing(df, "fill_mean").select("k", "d")) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]
    assert conform.handle_missing(spark.createDataFrame([(None, None), (1, None)], "a int, b int"), "drop_all").count() == 1


def test_bands(spark):
    df = spark.createDataFrame([(17,), (18,), (69,), (70,), (None,)], "age int")
    assert [r[0] for r in df.select(fn.age_band("age")).collect()] == ["<18", "18-29", "60-69", "70+", "70+"]
    assert [r[0] for r in df.select(fn.age_band("age", "unknown")).collect()][-1] == "unknown"
    assert [r[0] for r in df.select(fn.price_tier("age", 18, 69)).collect()] == ["Low", "Low", "Medium", "High", "High"]
    assert [r[0] for r in df.select(fn.size_band(F.col("age") * 50)).collect()] == ["Small", "Small", "Medium", "Medium", "Large"]


def test_keys_and_text(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert len({r[0] for r in df.select(fn.surrogate_key("x", "y", "z")).collect()}) == 1
    assert len({r[0] for r in df.select(fn.surrogate_key("x", "y", "z", null_token="~")).collect()}) == 2
    mails = spark.createDataFrame([("a@b@c.d",), ("none",)], "m string")
    assert [r[0] for r in mails.select(fn.email_domain("m")).collect()] == ["b@c.d", ""]
    blanks = spark.createDataFrame([(None,), ("  ",), (" NaN ",), ("x",)], "b string")
    assert [r[0] for r in blanks.select(fn.is_blank("b")).collect()] == [True, True, True, False]


def test_messy_dates(spark):
    texts = ["Tue Dec 16 2014 12:30:00 GMT-0800 (PST)", "2014-12-16", "12/16/2014", "2014-12-16T01:02:03", "never", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(fn.messy_timestamp("t")).collect()]
    assert got == [dt.datetime(2014, 12, 16, 20, 30), dt.datetime(2014, 12, 16), dt.datetime(2014, 12, 16), dt.datetime(2014, 12, 16, 1, 2, 3), None, None]


def test_days(spark):
    df = spark.createDataFrame([("2024-01-02 00:01:00", "2024-01-01 23:59:00")], "a string, b string").select(F.col("a").cast("timestamp").alias("a"), F.col("b").cast("timestamp").alias("b"))
    assert df.select(fn.days_between("a", "b"), fn.whole_days_between("a", "b"), fn.whole_days_between("b", "a")).first() == (1, 0, -1)
    assert df.select(fn.is_late("a", "b"), fn.is_late(F.lit(None).cast("timestamp"), "b")).first() == (True, False)


def test_json(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("broken",), (None,)], "j string")
    assert rows(conform.parse_json(df, "j", "a int, b string", flatten=True)) == [(1, "x"), (None, None), (None, None)]
    assert conform.parse_json(df, "j").columns == ["j", "parsed_json"]
    assert ("a", "1") in rows(conform.parse_json(df, "j", flatten=True))


def test_clean(spark):
    df = spark.createDataFrame([("1", "x"), ("1", "x"), (None, None), ("2", "y")], "`ID ` string, `Name-` string")
    out, stats = conform.clean(df)
    assert rows(out) == [(1.0, "x"), (2.0, "y")]
    assert stats.counts() == {"rows_before": 4, "rows_after": 2, "rows_removed": 2, "columns_converted": 1}


def test_audit(spark):
    at = dt.datetime(2024, 5, 6, 7, 8, 9)
    row = conform.add_audit(spark.range(1), at).first()
    assert row["etl_batch_id"] == "20240506070809" and row["etl_inserted_at"] == row["etl_updated_at"] == at


def test_dedupe(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, None, "a"), (1, 3, "c"), (2, None, "d")], "k int, o int, v string")
    assert rows(dedupe.keep_first(df, ["k"], ["o", "v"])) == [(1, None, "a"), (2, None, "d")]
    assert rows(dedupe.keep_last(df, ["k"], ["o", "v"])) == [(1, 3, "c"), (2, None, "d")]
    assert dedupe.stacked(df, df.drop("v")).count() == 8


def test_callers_steps(spark):
    from tidemill.operators.conform import computed, transformed

    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, s string")
    got = transformed(df, lambda d: d.where("s is not null"), lambda d: computed(d, y=F.col("x") * 2, s=F.upper("s")))
    assert [tuple(r) for r in got.collect()] == [(1, "A", 2)] and transformed(df).count() == 2
