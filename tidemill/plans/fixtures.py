"""Canonical tables built from the given ones, in Spark and, for the comparison, in SQL.

Amounts are decimals, so that sums don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2002-01-01 00:00:00"


class Tables:
    """The given tables of a folder, and the canonical ones."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        # Timestamps without a zone become instants, read in UTC by all queries.
        return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"})

    def fact_orders(self) -> DataFrame:
        shipped = self.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("order_delivered_customer_date"))
        o = self.orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        due = F.col("o_orderdate") + F.expr("interval 30 days")
        return o.select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("order_status"), F.col("o_orderdate").alias("order_purchase_timestamp"),
            "order_delivered_customer_date", due.alias("order_estimated_delivery_date"), F.datediff("order_delivered_customer_date", "o_orderdate").cast("long").alias("delivery_days"),
            F.coalesce(F.col("order_delivered_customer_date") > due, F.lit(False)).alias("is_delayed"), F.year("o_orderdate").cast("long").alias("order_year"), F.month("o_orderdate").cast("long").alias("order_month"),
        )

    def fact_order_items(self) -> DataFrame:
        price = F.col("l_extendedprice").cast("decimal(12,2)")
        freight = price * F.col("l_tax").cast("decimal(4,2)")
        return self.lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"), price.alias("price"), freight.alias("freight_value"), (price + freight).cast("decimal(18,4)").alias("total_value"))

    def dim_customers(self) -> DataFrame:
        return self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("customer_city"), F.col("n_name").alias("customer_state"))

    def dim_products(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("product_category_name"), F.col("p_size").alias("product_size"))

    def dim_sellers(self) -> DataFrame:
        return self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state"))

    def sales(self) -> DataFrame:
        return self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_partkey").alias("car_id"), F.col("l_suppkey").alias("dealer_id"), F.to_date("o_orderdate").alias("sale_date"), F.col("l_quantity").cast("decimal(12,2)").alias("quantity"), F.col("l_extendedprice").cast("decimal(14,2)").alias("total_amount")
        )

    def cars(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("car_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("model"), (1990 + F.col("p_size") % 30).cast("long").alias("model_year"), F.nullif("p_type", F.lit("PROMO")).alias("category"))

    def dealers(self) -> DataFrame:
        s = self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return s.select(F.col("s_suppkey").alias("dealer_id"), F.col("n_name").alias("city"), F.nullif("r_name", F.lit("ASIA")).alias("country"))

    def car_prices(self) -> DataFrame:
        s = self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        j = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        return j.select(
            F.col("n_name").alias("state"), F.col("l_returnflag").alias("condition"), F.col("s_name").alias("seller"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
            (F.col("p_retailprice") * F.col("l_quantity")).alias("mmr"), F.col("l_extendedprice").alias("sellingprice"),
        )

    def stock_prices(self) -> DataFrame:
        price = F.max("l_extendedprice").cast("decimal(18,2)")
        return self.lineitem.groupBy(F.col("l_suppkey").alias("stock"), F.to_date("l_shipdate").alias("day")).agg(price.alias("price"), F.sum("l_quantity").cast("decimal(18,2)").alias("volume"))

    def temperatures(self) -> DataFrame:
        j = self.lineitem.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        t = j.groupBy(F.col("s_nationkey").cast("long").alias("location"), F.to_date("l_shipdate").alias("day"))
        t = t.agg(F.round(F.sum(F.col("l_discount").cast("decimal(6,2)") * 100) / F.count(F.lit(1)), 1).cast("decimal(8,1)").alias("celsius"))
        return t.withColumn("latitude", (F.col("location") - 12) * 6)

    def matches(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        return self.orders.select(k.alias("match_id"), F.col("o_orderpriority").alias("league"), F.year("o_orderdate").cast("long").alias("season"), (c % 20).alias("home"), ((c + 1 + k % 19) % 20).alias("away"), (k % 5).alias("home_goals"), (c % 4).alias("away_goals"))

    def patients(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.customer.select(c.alias("patient_id"), (18 + c % 70).alias("age"), F.element_at(F.array(F.lit("E11"), F.lit("I10"), F.lit("J45"), F.lit("Z00")), (c % 4 + 1).cast("int")).alias("code"))

    def job_runs(self) -> DataFrame:
        return self.events.select(F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"), F.col("value").alias("duration"), "ts", F.col("event_type").alias("source"))


#: The same tables in SQL.
SQL = {
    "shipped": "select l_orderkey, max(l_shipdate) as d from lineitem group by l_orderkey",
    "fact_orders": """select o_orderkey as order_id, o_custkey as customer_id, o_orderstatus as order_status, o_orderdate as order_purchase_timestamp,
        d as order_delivered_customer_date, o_orderdate + interval 30 day as order_estimated_delivery_date, date_diff('day', cast(o_orderdate as date), cast(d as date)) as delivery_days,
        coalesce(d > o_orderdate + interval 30 day, false) as is_delayed, year(o_orderdate) as order_year, month(o_orderdate) as order_month
        from orders left join shipped on o_orderkey = l_orderkey""",
    "fact_order_items": """select l_orderkey as order_id, l_partkey as product_id, l_suppkey as seller_id, cast(l_extendedprice as decimal(12,2)) as price,
        cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2)) as freight_value,
        cast(cast(l_extendedprice as decimal(12,2)) + cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2)) as decimal(18,4)) as total_value from lineitem""",
    "dim_customers": "select c_custkey as customer_id, c_mktsegment as customer_city, n_name as customer_state from customer join nation on c_nationkey = n_nationkey",
    "dim_products": "select p_partkey as product_id, p_type as product_category_name, p_size as product_size from part",
    "dim_sellers": "select s_suppkey as seller_id, n_name as seller_state from supplier join nation on s_nationkey = n_nationkey",
    "sales": "select l_partkey as car_id, l_suppkey as dealer_id, cast(o_orderdate as date) as sale_date, cast(l_quantity as decimal(12,2)) as quantity, cast(l_extendedprice as decimal(14,2)) as total_amount from lineitem join orders on l_orderkey = o_orderkey",
    "cars": "select p_partkey as car_id, p_brand as brand, p_name as model, 1990 + p_size % 30 as model_year, nullif(p_type, 'PROMO') as category from part",
    "dealers": "select s_suppkey as dealer_id, n_name as city, nullif(r_name, 'ASIA') as country from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "car_prices": """select n_name as state, l_returnflag as condition, s_name as seller, l_orderkey as order_id, l_linenumber as line, l_partkey as part, p_retailprice * l_quantity as mmr, l_extendedprice as sellingprice
        from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey""",
    "stock_prices": """select l_suppkey as stock, cast(l_shipdate as date) as day, cast(max(l_extendedprice) as decimal(18,2)) as price,
        cast(sum(l_quantity) as decimal(18,2)) as volume from lineitem group by 1, 2""",
    "temperatures": """select cast(s_nationkey as bigint) as location, cast(l_shipdate as date) as day,
        cast(round(cast(sum(cast(l_discount as decimal(6,2)) * 100) as double) / count(*), 1) as decimal(8,1)) as celsius, (cast(s_nationkey as bigint) - 12) * 6 as latitude
        from lineitem join supplier on l_suppkey = s_suppkey group by s_nationkey, 2""",
    "matches": """select o_orderkey as match_id, o_orderpriority as league, year(o_orderdate) as season, o_custkey % 20 as home, (o_custkey + 1 + o_orderkey % 19) % 20 as away,
        o_orderkey % 5 as home_goals, o_custkey % 4 as away_goals from orders""",
    "patients": "select c_custkey as patient_id, 18 + c_custkey % 70 as age, ['E11', 'I10', 'J45', 'Z00'][c_custkey % 4 + 1] as code from customer",
    "job_runs": "select event_id as run_id, case when event_type = 'error' then 'failed' else 'succeeded' end as status, value as duration, ts, event_type as source from events",
}
_NEEDS = {"fact_orders": ("shipped",)}


def sql(body: str, *names: str) -> str:
    """body with the named canonical tables before it."""
    ordered = [x for n in names for x in (*_NEEDS.get(n, ()), n)]
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in dict.fromkeys(ordered)) + ("\n" if not body.lstrip().startswith(",") else "") + body
