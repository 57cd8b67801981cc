"""Builders of the star schema from raw tables, with the columns that such raw files have."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import date_parts, days_between, is_late, size_band, standard_code, surrogate_key, volume
from ..functions.naming import snake_names
from ..operators.conform import add_audit, cast_columns, handle_nulls
from ..operators.dedupe import keep_first, keep_last
from ..operators.quality import Checks
from ..sources.files import read_delimited
from ..sources.sinks import write_partitioned

ORDER_TIMES = ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date")


def _audited(df: DataFrame, run_ts) -> DataFrame:
    return df if run_ts is None else add_audit(df, run_ts)


def fact_orders(raw: DataFrame, run_ts=None) -> DataFrame:
    """One row an order, the earliest purchase; audit columns come last, so that they don't take part in deduplication."""
    df = cast_columns(snake_names(raw), {c: "timestamp" for c in ORDER_TIMES if c in snake_names(raw).columns})
    df = handle_nulls(df, {"order_id": "drop", "customer_id": "drop", "order_status": "unknown"})
    df = df.withColumn("delivery_days", days_between("order_delivered_customer_date", "order_purchase_timestamp"))
    df = df.withColumn("is_delayed", is_late("order_delivered_customer_date", "order_estimated_delivery_date"))
    parts = date_parts("order_purchase_timestamp", ("year", "month", "quarter"))
    df = df.withColumns({k.replace("order_purchase_timestamp", "order"): v for k, v in parts.items()})
    return _audited(keep_first(df, ["order_id"], ["order_purchase_timestamp", *[c for c in df.columns if c not in ("order_id", "order_purchase_timestamp")]]), run_ts)


def dim_customers(raw: DataFrame, run_ts=None) -> DataFrame:
    df = cast_columns(snake_names(raw), {"customer_id": "string", "customer_unique_id": "string"})
    df = handle_nulls(df, {"customer_id": "drop", "customer_city": "Unknown", "customer_state": "Unknown"})
    df = df.withColumn("customer_state", F.upper("customer_state")).withColumn("customer_key", surrogate_key("customer_id"))
    return _audited(keep_first(df, ["customer_id"], ["customer_unique_id", *[c for c in df.columns if c not in ("customer_id", "customer_unique_id")]]), run_ts)


def dim_products(raw: DataFrame, categories: DataFrame, run_ts=None, by_key: bool = False) -> DataFrame:
    """Products with their category's English name, volume and size band.  Whole rows are deduplicated, or keys."""
    names = snake_names(categories).select(F.col("product_category_name").alias("__category"), "product_category_name_english")
    df = snake_names(raw)
    df = df.join(names, df.product_category_name == F.col("__category"), "left").drop("__category")
    df = cast_columns(df, {c: "double" for c in ("product_length_cm", "product_height_cm", "product_width_cm", "product_weight_g") if c in df.columns})
    v = volume("product_length_cm", "product_height_cm", "product_width_cm")
    df = df.withColumns({"product_volume_cm3": v, "product_size_category": size_band(v), "product_key": surrogate_key("product_id")})
    return _audited(keep_first(df, ["product_id"], df.columns) if by_key else df.dropDuplicates(), run_ts)


def dim_sellers(raw: DataFrame, run_ts=None, by_key: bool = False) -> DataFrame:
    df = cast_columns(snake_names(raw), {"seller_id": "string"})
    df = df.withColumns({"seller_state": F.upper("seller_state"), "seller_key": surrogate_key("seller_id")})
    return _audited(keep_first(df, ["seller_id"], df.columns) if by_key else df.dropDuplicates(), run_ts)


def fact_order_items(raw: DataFrame, orders: DataFrame, run_ts=None) -> DataFrame:
    """Items with totals and their order's year and month; items without an order keep nulls there."""
    df = cast_columns(snake_names(raw), {"price": "double", "freight_value": "double", "order_item_id": "integer"})
    df = df.withColumn("total_value", F.col("price") + F.col("freight_value"))
    return _audited(df.join(orders.select("order_id", "order_year", "order_month"), "order_id", "left"), run_ts)


def staged_orders(raw: DataFrame) -> DataFrame:
    """One row an order, the latest purchase (missing ones count as earliest), with tidy statuses."""
    df = cast_columns(raw, {c: "timestamp" for c in ORDER_TIMES if c in raw.columns}).withColumn("order_status", standard_code("order_status"))
    return keep_last(df, ["order_id"], ["order_purchase_timestamp", *[c for c in df.columns if c not in ("order_id", "order_purchase_timestamp")]])


def order_mart(staged: DataFrame, loaded_at=None) -> DataFrame:
    df = staged.withColumn("is_delayed", is_late("order_delivered_customer_date", "order_estimated_delivery_date"))
    return df if loaded_at is None else df.withColumn("loaded_at", F.lit(loaded_at).cast("timestamp"))


def build_star(spark: SparkSession, raw: str, out: str, run_ts, suffix: str = ".csv") -> dict[str, DataFrame]:
    """Read six raw files, build five tables and write them, facts by year and month.  The tables are written at
    the same time; items take their order's month from the orders written, which are built once."""
    read = lambda n: read_delimited(spark, f"{raw}/{n}{suffix}")[0]

    def put(name: str, df: DataFrame) -> DataFrame:
        write_partitioned(df, f"{out}/{name}", ["order_year", "order_month"] if name.startswith("fact_") else [])
        return spark.read.schema(df.schema).parquet(f"{out}/{name}")

    def facts() -> None:
        orders = put("fact_orders", fact_orders(read("orders"), run_ts))
        put("fact_order_items", fact_order_items(read("order_items"), orders, run_ts))

    jobs = [
        facts, lambda: put("dim_customers", dim_customers(read("customers"), run_ts)), lambda: put("dim_products", dim_products(read("products"), read("categories"), run_ts)),
        lambda: put("dim_sellers", dim_sellers(read("sellers"), run_ts)),
    ]
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()
    return {n: spark.read.parquet(f"{out}/{n}") for n in ("fact_orders", "dim_customers", "dim_products", "dim_sellers", "fact_order_items")}


def job_checks(orders: DataFrame, items: DataFrame) -> DataFrame:
    """At least 100 rows and no missing ids."""
    first = Checks(orders).row_count(100).null_share("order_id", 0.0).null_share("customer_id", 0.0).results()
    return first.unionByName(Checks(items).row_count(100).null_share("order_id", 0.0).results())
