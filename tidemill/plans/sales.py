"""Questions about car sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio
from .commerce import money

REVENUE = (F.sum, "total_amount")


def _sums(by, *more) -> DataFrame:
    return by.agg(F.sum("total_amount").alias("r"), F.sum("quantity").alias("q"), F.count(F.lit(1)).alias("n"), *more)


def totals(sales: DataFrame) -> DataFrame:
    return _sums(sales.groupBy()).select(F.col("n").alias("total_transactions"), money("q").alias("total_units_sold"), money("r").alias("total_revenue"))


def by_month(sales: DataFrame) -> DataFrame:
    by = sales.groupBy(F.to_date(F.date_trunc("month", "sale_date")).alias("month"))
    return _sums(by).select("month", money("r").alias("revenue"), money("q").alias("units_sold"), F.col("n").alias("transactions")).orderBy("month")


def by_year(sales: DataFrame) -> DataFrame:
    return _sums(sales.groupBy(F.year("sale_date").cast("long").alias("year"))).select("year", money("r").alias("revenue"), money("q").alias("units_sold")).orderBy("year")


def ranked(sales: DataFrame, dim: DataFrame, key: str, by: list[str], n: int | None = None, labels: dict[str, str] | None = None, units: bool = True, count: bool = False) -> DataFrame:
    """Revenue by attributes of a dimension, highest first, the first n; missing attributes take a label."""
    cols = [F.coalesce(c, F.lit(labels[c])).alias(c) if labels and c in labels else F.col(c) for c in by]
    out = _sums(sales.join(dim, key).groupBy(*cols)).orderBy(F.desc("r"), *by)
    out = out if n is None else out.limit(n)
    return out.select(*by, money("r").alias("revenue"), *([money("q").alias("units_sold")] if units else []), *([F.col("n").alias("transactions")] if count else []))


def average_price(sales: DataFrame, cars: DataFrame) -> DataFrame:
    """Revenue a unit by brand."""
    d = lambda c: F.col(c).cast("double")
    return _sums(sales.join(cars, "car_id").groupBy("brand")).select("brand", F.round(safe_ratio(d("r"), d("q")), 2).alias("avg_selling_price")).orderBy(F.desc("avg_selling_price"), "brand")


def best_month(sales: DataFrame, cars: DataFrame) -> DataFrame:
    """Each brand's month of most revenue, ties kept."""
    by = sales.join(cars, "car_id").groupBy("brand", F.to_date(F.date_trunc("month", "sale_date")).alias("month")).agg(F.sum("total_amount").alias("r"))
    top = by.withColumn("k", F.dense_rank().over(Window.partitionBy("brand").orderBy(F.desc("r")))).where("k = 1")
    return top.select("brand", "month", money("r").alias("revenue")).orderBy(F.desc("revenue"), "brand", "month")
