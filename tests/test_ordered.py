"""Global order against windows and DuckDB, with ties that cross the borders of partitions."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.operators import ordered as o
from tidemill.plans import commerce
from tidemill.sources import snapshots
from tidemill.sources.scratch import workspace

from .conftest import rows


@pytest.fixture()
def many(spark):
    """More partitions than usual, and none put together: ties and groups cross borders."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def table(spark, n=600):
    # A third of all rows share a value; groups of one row, of all sizes, and a null one.
    return spark.range(n).select("id", F.expr("case when id % 3 = 0 then 7 when id % 11 = 0 then null else (id * 37) % 20 end").alias("x"), F.expr("case when id < 400 then 'big' when id % 50 = 0 then null else concat('g', id % 7) end").alias("g"), ((F.col("id") * 13) % 17 - 5).cast("decimal(10,0)").alias("v"))


@pytest.mark.parametrize("by", [(), ("g",)])
def test_ordered_matches_windows(many, by):
    df = table(many)
    whole, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("x")
    want = df.select(
        "id", F.row_number().over(whole.orderBy("x", "id")).cast("long"), F.count(F.lit(1)).over(whole), F.rank().over(w).cast("long"), F.dense_rank().over(w).cast("long"),
        F.sum("v").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"), F.sum("v").over(whole).cast("long"), F.ntile(5).over(whole.orderBy("x", "id")),
        F.round(F.percent_rank().over(w), 9), F.lag("v", 3).over(whole.orderBy("x", "id")).cast("long"),
    )
    got = o.ordered(df, ["x"], by, ["id"], "v")
    got = o.lagged(got, "v", 3, "back", by).select("id", "__place", "__size", "__rank", "__dense", F.col("__running").cast("long"), F.col("__total").cast("long"), o.tile(5).alias("t"), F.round(o.percent_rank(), 9), F.col("back").cast("long"))
    assert rows(got) == rows(want)


def test_order_of_nothing_and_of_one(many):
    df = table(many)
    assert o.ordered(df.where("false"), ["x"], ["g"], ["id"], "v").count() == 0
    assert [tuple(r)[4:] for r in o.ordered(df.where("id = 3"), ["x"], [], ["id"], "v").collect()] == [(1, 1, 1, 1, 0, 0)]  # 3 * 13 % 17 - 5 = 0


def test_no_task_holds_a_hot_value_or_all_rows(many):
    sizes = [r[0] for r in o.ordered(table(many, 9000), ["x"], (), ["id"], "v").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 9000 / 2  # of nine partitions a hash may put a few together


@pytest.mark.parametrize("by", [[], ["g"]])
def test_percentiles(many, by):
    df = table(many).withColumn("y", F.col("x") * 1.5 + F.when(F.col("id") % 2 == 0, F.col("id") / 7).otherwise(0))
    at = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    for c in ("x", "y"):
        got = o.percentiles(df, c, at, by).select(*by, *[F.round(n, 9) for n in at])
        want = df.where(F.col(c).isNotNull()).groupBy(*by).agg(*[F.round(F.percentile(c, q), 9) for q in at.values()])
        assert rows(got) == rows(want)
    assert o.percentiles(df.where("x is null"), "x", at, ["g"]).count() == 0
    heavy = df.where("x is not null").groupBy(*by, "x").agg(F.sum("id").alias("n"), F.max("id").alias("m"))
    assert rows(o.percentiles(heavy.where("n > 0"), "x", at, by, "n")) == rows(o.percentiles(df.where("x is not null").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("id")))).where("id > 0"), "x", at, by))


@pytest.mark.parametrize("n", [0, 1, 3, 23, 60])
def test_fifths_match_ntile(many, n):
    df = many.range(n).select(F.col("id").alias("customer_id"), (F.col("id") % 4).alias("x"), (F.col("id") * 7 % 5).alias("y"), F.lit(1).alias("z"))
    orders = {"a": F.col("x"), "b": -F.col("y"), "c": F.col("z")}
    want = df.select("customer_id", *[F.ntile(5).over(Window.orderBy(c, "customer_id")).alias(k) for k, c in orders.items()])
    assert rows(commerce.with_fifths(df, "customer_id", orders).select("customer_id", "a", "b", "c")) == rows(want)


def test_tables_between_steps_go_with_their_workspace(many, tmp_path):
    with workspace(many) as path:
        o.percentiles(table(many), "x", {"p50": 0.5}, ["g"]).write.parquet(str(tmp_path / "out"))
        assert snapshots.names(many, path)
    assert not snapshots.names(many, path) and many.read.parquet(str(tmp_path / "out")).count() == 9
