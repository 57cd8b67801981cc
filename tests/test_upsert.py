import pytest
from pyspark.sql import functions as F

from tidemill.operators.upsert import delete_insert, touched_partitions, upsert, upsert_from_staging

from .conftest import rows

TARGET = "customer_id int, name string, city string"


def test_later_rows_win_and_repetition_changes_nothing(spark):
    stock = spark.createDataFrame([("bolt", 40, 0.2), ("nut", 15, 0.1), ("washer", 7, 0.05)], "part string, pieces int, price double")
    counted = [("nut", 90, 0.12, "b"), ("nut", 12, 0.11, "a"), ("gear", 3, 9.5, "a"), ("bolt", None, 0.25, "c"), ("nut", 88, None, "c")]
    moves = spark.createDataFrame(counted, "part string, pieces int, price double, shift string").repartition(3)
    merged = upsert(stock, moves, ["part"], ["shift"])
    assert rows(merged) == [("bolt", None, 0.25), ("gear", 3, 9.5), ("nut", 88, None), ("washer", 7, 0.05)]
    for _ in range(2):
        merged = upsert(merged, moves, ["part"], ["shift"])
    assert rows(merged) == [("bolt", None, 0.25), ("gear", 3, 9.5), ("nut", 88, None), ("washer", 7, 0.05)]


def test_columns(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], TARGET)
    new = spark.createDataFrame([(1, None), (3, "c")], "customer_id int, name string")
    assert rows(upsert(target, new, ["customer_id"])) == [(1, None, "x"), (2, "b", "y"), (3, "c", None)]
    assert rows(upsert(target, new, ["customer_id"], updates=[])) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]


def test_rejections(spark):
    target = spark.createDataFrame([(1, "a", "x")], TARGET)
    wider = target.withColumn("weight", F.lit(2.5))
    for call in (lambda: upsert(target, wider, ["customer_id"]), lambda: upsert(target, target, []), lambda: upsert(target, target, ["customer_id"], updates=["customer_id"])):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(Exception, match="null in a key"):
        upsert(target, target.withColumn("customer_id", F.lit(None).cast("int")), ["customer_id"]).collect()


def test_staging_and_delete_insert(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], TARGET)
    stage = spark.createDataFrame([(2, "B", "Y"), (2, "B2", "Y2"), (3, "c", "z")], TARGET)
    assert rows(delete_insert(target, stage, ["customer_id"])) == [(1, "a", "x"), (2, "B", "Y"), (2, "B2", "Y2"), (3, "c", "z")]
    assert rows(upsert_from_staging(target, stage.where("city <> 'Y2'"), ["customer_id"], ["name"])) == [(1, "a", "x"), (2, "B", "y"), (3, "c", "z")]
    assert rows(touched_partitions(target, stage, ["city"])) == []
