"""Every registered query with SQL agrees with DuckDB, and further options hold."""

import datetime as dt
import decimal
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.operators import aggregate as agg
from tidemill.plans import commerce, marts, registry, star
from tidemill.plans.fixtures import Tables

from .conftest import rows

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return None if x != x else round(float(x), 6)
    if isinstance(x, dt.datetime):
        return str(x)[:19]
    return str(x)


def table(names, data):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert table(df.columns, df.collect()) == table(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


def test_calendar_comparison(spark):
    o = spark.createDataFrame([(1, 1, "F", "2020-01-05"), (2, 1, "F", "2021-01-05")], "order_id long, customer_id long, order_status string, d string")
    o = o.select("*", F.col("d").cast("timestamp").alias("order_purchase_timestamp"), F.year("d").alias("order_year"), F.month("d").alias("order_month")).drop("d")
    i = spark.createDataFrame([(1, 10.0), (2, 15.0)], "order_id long, total_value double")
    got = commerce.monthly_revenue(o, i, "F", by_calendar=True).select("yoy_growth_pct").collect()
    assert [r[0] for r in got] == [50.0, None] and commerce.monthly_revenue(o, i, "F").where("yoy_growth_pct is not null").isEmpty()


def test_shares_sum_to_100(spark):
    t = Tables(spark, FOLDER)
    seg = commerce.rfm_segments(t.dim_customers(), t.fact_orders(), t.fact_order_items(), "2002-01-01", "F")
    assert abs(seg.agg(F.sum("pct_of_total_revenue")).first()[0] - 100) < 0.1


def test_sample_is_repeatable(spark):
    df = spark.range(500)
    assert rows(agg.sample(df, 20, ["id"])) == rows(agg.sample(df.repartition(9), 20, ["id"]))


def test_quantile_cuts(spark):
    df = spark.range(1001)
    low, high = agg.quantile_cuts(df, "id")
    assert abs(low - 330) <= 20 and abs(high - 670) <= 20 and agg.quantile_cuts(df, "id", exact=True) == [330.0, 670.0]
    assert agg.quantile_cuts(df.where("false"), "id") == [None, None] and agg.quantile_cuts(df.where("false"), "id", exact=True) == [None, None]


def test_sketches_merge(spark, tmp_path):
    """A new day is merged with kept ones; nulls don't count, a group without values has no quantiles."""
    df = spark.range(40_000).select((F.col("id") % 8).alias("day"), F.when(F.col("id") % 5 > 0, (F.col("id") * 7919) % 40_009).alias("v")).unionByName(spark.createDataFrame([(9, None)], "day long, v long"))
    for day in (F.col("day") < 7, F.col("day") >= 7):
        agg.quantile_sketches(df.where(day), "v", ["day"]).write.mode("append").parquet(str(tmp_path / "s"))
    kept = spark.read.parquet(str(tmp_path / "s"))
    q = agg.sketch_quantiles(agg.merged_sketches(kept), {"p10": 0.1, "p99": 0.99}).first()
    assert q["n"] == 32_000
    for name, share in (("p10", 0.1), ("p99", 0.99)):
        assert abs(df.where(F.col("v") <= q[name]).count() / 32_000 - share) < 0.01
    assert rows(agg.sketch_quantiles(kept.where("day = 9"), {"p50": 0.5}, ["day"])) == [(9, 0, None)]


def test_build_star(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    texts = {
        "orders": "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\no1,c1,delivered,2020-01-02 10:00:00,,,2020-01-09 00:00:00,2020-01-05 00:00:00\n,c2,x,,,,,\n",
        "customers": "customer_id,customer_unique_id,customer_city,customer_state\nc1,u1,Rio,rj\nc1,u0,Rio,\n",
        "products": "product_id,product_category_name,product_length_cm,product_height_cm,product_width_cm,product_weight_g\np1,casa,10,10,5,7\n",
        "categories": "product_category_name,product_category_name_english\ncasa,home\n",
        "sellers": "seller_id,seller_city,seller_state\ns1,Rio,rj\ns1,Rio,rj\n",
        "order_items": "order_id,order_item_id,product_id,seller_id,price,freight_value\no1,1,p1,s1,10.5,2\no9,1,p1,s1,1,1\n",
    }
    for n, text in texts.items():
        (raw / f"{n}.csv").write_text(text)
    got = star.build_star(spark, str(raw), str(tmp_path / "out"), dt.datetime(2024, 1, 1))
    assert {n: df.count() for n, df in got.items()} == {"fact_orders": 1, "dim_customers": 1, "dim_products": 1, "dim_sellers": 1, "fact_order_items": 2}
    assert rows(got["fact_orders"].select("order_id", "delivery_days", "is_delayed", "order_year")) == [("o1", 7, True, 2020)]
    assert rows(got["dim_products"].select("product_category_name_english", "product_size_category")) == [("home", "Small")]
    assert rows(got["dim_customers"].select("customer_unique_id", "customer_state")) == [("u0", "UNKNOWN")]
    assert star.job_checks(got["fact_orders"], got["fact_order_items"]).where("not passed").count() == 2


def test_dates_without_trading(spark):
    d = marts.dim_dates(spark, "2024-12-30", "2025-01-02", ["2025-01-01"])
    assert rows(d.select("iso_week", "iso_weekday", "is_holiday")) == sorted([(1, 1, False), (1, 2, False), (1, 3, True), (1, 4, False)])


def test_star_builds_orders_once(spark, tmp_path, monkeypatch):
    """Items find their month in the orders written: the raw orders are read for the build of one table only."""
    put = lambda name, text: (tmp_path / f"{name}.csv").write_text(text)
    put("orders", "order_id,customer_id,order_status,order_purchase_timestamp,order_delivered_customer_date,order_estimated_delivery_date\n007,1,x,2020-01-05 00:00:00,,\n007,1,x,2020-03-05 00:00:00,,\n8,1,x,,,\n")
    put("customers", "customer_id,customer_unique_id,customer_city,customer_state\n1,u,c,s\n")
    put("products", "product_id,product_category_name,product_length_cm,product_height_cm,product_width_cm\n1,a,1,2,3\n")
    put("categories", "product_category_name,product_category_name_english\na,b\n")
    put("sellers", "seller_id,seller_state\n1,s\n")
    put("order_items", "order_id,order_item_id,price,freight_value\n007,1,1.5,1\n007,2,2.5,1\n8,1,1,1\n9,1,1,1\n")
    seen, join = [], star.fact_order_items
    monkeypatch.setattr(star, "fact_order_items", lambda raw, orders, run_ts: seen.extend(orders.inputFiles()) or join(raw, orders, run_ts))
    made = star.build_star(spark, str(tmp_path), str(tmp_path / "out"), dt.datetime(2020, 1, 1))
    assert seen and all("/out/fact_orders/" in f for f in seen)
    assert rows(made["fact_order_items"].select("order_id", "order_item_id", "order_year", "order_month")) == [("007", 1, 2020, 1), ("007", 2, 2020, 1), ("8", 1, None, None), ("9", 1, None, None)]
    assert {n: df.count() for n, df in made.items()} == {"fact_orders": 2, "dim_customers": 1, "dim_products": 1, "dim_sellers": 1, "fact_order_items": 4}
