"""Registered queries with the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions.naming import plain_names, snake_names
from ..operators import aggregate as agg
from ..operators import conform, dedupe, quality, upsert
from ..operators.ordered import lagged, ordered, percent_rank, percentiles, tile
from ..sources import files, runs
from . import commerce, marts, sales, slo, star
from .fixtures import AS_OF, Tables, sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, text: str | None = None, *needs: str):
    """Register f(Tables) under a name, with SQL over the given and the needed canonical tables."""

    def keep(f: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if text:
            _SQL[name] = sql(text, *needs) if needs else text
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


# ---------------------------------------------------------------- questions about commerce

query(
    "e1_monthly_revenue",
    """, m as (select order_year, order_month, cast(date_trunc('month', order_purchase_timestamp) as date) as month_date, count(distinct order_id) as total_orders, count(distinct customer_id) as unique_customers,
         sum(total_value) as r, count(*) as n from fact_order_items join fact_orders using (order_id) where order_status = 'F' group by 1, 2, 3),
       l as (select *, lag(r, 12) over (order by order_year, order_month) as b from m)
    select order_year, order_month, month_date, total_orders, unique_customers, round(cast(r as double), 2) as monthly_revenue, round(cast(r as double) / n, 2) as avg_order_value,
      round(cast(r - b as double), 2) as yoy_revenue_change, round(cast(r - b as double) / nullif(cast(b as double), 0) * 100, 2) as yoy_growth_pct from l order by 1 desc, 2 desc limit 24""",
    "fact_orders", "fact_order_items",
)(lambda t: commerce.monthly_revenue(t.fact_orders(), t.fact_order_items(), "F"))

query(
    "e2_category_revenue",
    """, c as (select product_category_name as category, count(distinct order_id) as total_orders, sum(price) as p, sum(freight_value) as f, sum(total_value) as t, count(*) as n
         from fact_order_items join fact_orders using (order_id) join dim_products using (product_id) where order_status = 'F' and product_category_name is not null group by 1 having count(distinct order_id) >= 100)
    select category, total_orders, round(cast(p as double), 2) as total_product_revenue, round(cast(f as double), 2) as total_freight_revenue, round(cast(t as double), 2) as total_revenue,
      round(cast(p as double) / n, 2) as avg_product_price, round(cast(f as double) / n, 2) as avg_freight_cost, round(cast(f as double) / nullif(cast(p as double), 0) * 100, 2) as freight_to_price_ratio,
      round(cast(t as double) / nullif(total_orders, 0), 2) as revenue_per_order, round(percent_rank() over (order by t desc), 6) as revenue_percentile from c order by t desc, category limit 20""",
    "fact_orders", "fact_order_items", "dim_products",
)(lambda t: commerce.category_revenue(t.fact_orders(), t.fact_order_items(), t.dim_products(), "F"))

_RFM = """, m as (select customer_id, count(distinct order_id) as frequency, sum(total_value) as monetary, count(*) as n, epoch(timestamp '2002-01-01 00:00:00' - max(order_purchase_timestamp)) // 86400 as recency
         from fact_order_items join fact_orders using (order_id) join dim_customers using (customer_id) where order_status = 'F' group by 1),
       s as (select *, ntile(5) over (order by {sign}recency, customer_id) as r, ntile(5) over (order by {unsign}frequency, customer_id) as f, ntile(5) over (order by {unsign}monetary, customer_id) as mm from m),
       l as (select *, case when r >= 4 and f >= 4 and mm >= 4 then 'Champions' when r >= 3 and f >= 3 then 'Loyal Customers' when r >= 4 and f <= 2 then 'Potential Loyalists' when r >= 3 and mm >= 3 then 'Big Spenders'
         when r <= 2 and f >= 3 then 'At Risk' when r <= 2 and f <= 2 then 'Lost Customers' else 'Regular Customers' end as customer_segment, cast(round(cast(monetary as double) / n, 6) as decimal(20,6)) as each from s)
    select customer_segment, count(*) as customer_count, round(cast(sum(recency) as double) / count(*), 0) as avg_recency_days, round(cast(sum(frequency) as double) / count(*), 2) as avg_frequency,
      round(cast(sum(monetary) as double) / count(*), 2) as avg_monetary_value, round(cast(sum(each) as double) / count(*), 2) as avg_order_value, round(cast(sum(monetary) as double), 2) as total_segment_value,
      round(cast(sum(monetary) as double) * 100 / cast((select sum(monetary) from m) as double), 2) as pct_of_total_revenue from l group by 1"""
query("e3_rfm_segments", _RFM.format(sign="", unsign="-"), "fact_orders", "fact_order_items", "dim_customers")(lambda t: commerce.rfm_segments(t.dim_customers(), t.fact_orders(), t.fact_order_items(), AS_OF, "F"))
query("e3_rfm_segments_best_high", _RFM.format(sign="-", unsign=""), "fact_orders", "fact_order_items", "dim_customers")(
    lambda t: commerce.rfm_segments(t.dim_customers(), t.fact_orders(), t.fact_order_items(), AS_OF, "F", best_is_high=True)
)

query(
    "e4_delivery_by_state",
    """, s as (select customer_state, count(distinct order_id) as total_orders, count(distinct case when is_delayed then order_id end) as delayed_orders, avg(delivery_days) as a, quantile_cont(delivery_days, 0.5) as q50,
         quantile_cont(delivery_days, 0.95) as q95, min(delivery_days) as min_delivery_days, max(delivery_days) as max_delivery_days, sum(total_value) as t, count(distinct customer_id) as unique_customers
         from fact_order_items join fact_orders using (order_id) join dim_customers using (customer_id) where order_status = 'F' and order_delivered_customer_date is not null group by 1 having count(distinct order_id) >= 50)
    select customer_state, total_orders, delayed_orders, round(delayed_orders * 100.0 / total_orders, 2) as delay_rate_pct, round(a, 1) as avg_delivery_days, round(q50, 1) as median_delivery_days, round(q95, 1) as p95_delivery_days,
      min_delivery_days, max_delivery_days, round(cast(t as double), 2) as total_revenue, unique_customers from s order by t desc, customer_state limit 30""",
    "fact_orders", "fact_order_items", "dim_customers",
)(lambda t: commerce.delivery_by_state(t.fact_orders(), t.dim_customers(), t.fact_order_items(), "F"))

query(
    "e5_seller_ranking",
    """, s as (select seller_id, seller_state, count(distinct order_id) as total_orders, count(distinct customer_id) as unique_customers, sum(total_value) as t, sum(price) as p, count(*) as n,
         count(distinct product_id) as unique_products_sold, count(distinct product_category_name) as category_diversity, avg(delivery_days) as a, sum(case when is_delayed then 1 else 0 end) as late
         from fact_order_items join fact_orders using (order_id) join dim_products using (product_id) join dim_sellers using (seller_id) where order_status = 'F' group by 1, 2 having count(distinct order_id) >= 10)
    select row_number() over (order by t desc, seller_id) as seller_rank, seller_id, seller_state, total_orders, unique_customers, round(cast(t as double), 2) as total_revenue,
      round(cast(t as double) * 100 / cast(sum(t) over () as double), 4) as market_share_pct, round(cast(sum(t) over (order by t desc range unbounded preceding) as double) * 100 / cast(sum(t) over () as double), 2) as cumulative_market_share_pct,
      round(cast(p as double) / n, 2) as avg_product_price, unique_products_sold, category_diversity, round(a, 1) as avg_delivery_days, round(late * 100.0 / total_orders, 2) as delay_rate_pct,
      round(cast(t as double) / total_orders, 2) as revenue_per_order, round(cast(t as double) / unique_customers, 2) as revenue_per_customer from s order by 1 limit 100""",
    "fact_orders", "fact_order_items", "dim_products", "dim_sellers",
)(lambda t: commerce.seller_ranking(t.dim_sellers(), t.fact_orders(), t.fact_order_items(), t.dim_products(), "F"))

# ---------------------------------------------------------------- questions about sales

_R, _Q = "round(cast(sum(total_amount) as double), 2) as revenue", "round(cast(sum(quantity) as double), 2) as units_sold"
query("c1_totals", f"select count(*) as total_transactions, round(cast(sum(quantity) as double), 2) as total_units_sold, round(cast(sum(total_amount) as double), 2) as total_revenue from sales", "sales")(lambda t: sales.totals(t.sales()))
query("c2_by_month", f"select cast(date_trunc('month', sale_date) as date) as month, {_R}, {_Q}, count(*) as transactions from sales group by 1", "sales")(lambda t: sales.by_month(t.sales()))
query("c3_top_brands", f"select brand, {_R}, {_Q} from sales join cars using (car_id) group by 1 order by sum(total_amount) desc, brand limit 10", "sales", "cars")(lambda t: sales.ranked(t.sales(), t.cars(), "car_id", ["brand"], 10))
query("c4_top_models", f"select brand, model, model_year, {_R}, {_Q} from sales join cars using (car_id) group by 1, 2, 3 order by sum(total_amount) desc, 1, 2, 3 limit 10", "sales", "cars")(
    lambda t: sales.ranked(t.sales(), t.cars(), "car_id", ["brand", "model", "model_year"], 10)
)
query("c5_by_country", f"select coalesce(country, 'unknown') as country, {_R}, {_Q} from sales join dealers using (dealer_id) group by 1", "sales", "dealers")(
    lambda t: sales.ranked(t.sales(), t.dealers(), "dealer_id", ["country"], labels={"country": "unknown"})
)
query("c6_by_city", f"select coalesce(city, 'unknown') as city, coalesce(country, 'unknown') as country, {_R} from sales join dealers using (dealer_id) group by 1, 2 order by sum(total_amount) desc, 1, 2 limit 15", "sales", "dealers")(
    lambda t: sales.ranked(t.sales(), t.dealers(), "dealer_id", ["city", "country"], 15, {"city": "unknown", "country": "unknown"}, units=False)
)
query("c7_average_price", "select brand, round(cast(sum(total_amount) as double) / nullif(cast(sum(quantity) as double), 0), 2) as avg_selling_price from sales join cars using (car_id) group by 1", "sales", "cars")(
    lambda t: sales.average_price(t.sales(), t.cars())
)
query("c8_by_category", f"select coalesce(category, 'unknown') as category, {_R}, {_Q}, count(*) as transactions from sales join cars using (car_id) group by 1", "sales", "cars")(
    lambda t: sales.ranked(t.sales(), t.cars(), "car_id", ["category"], labels={"category": "unknown"}, count=True)
)
query("c9_by_year", f"select year(sale_date) as year, {_R}, {_Q} from sales group by 1", "sales")(lambda t: sales.by_year(t.sales()))
query(
    "c10_best_month",
    """, b as (select brand, cast(date_trunc('month', sale_date) as date) as month, sum(total_amount) as r from sales join cars using (car_id) group by 1, 2)
    select brand, month, round(cast(r as double), 2) as revenue from (select *, dense_rank() over (partition by brand order by r desc) as k from b) where k = 1""",
    "sales", "cars",
)(lambda t: sales.best_month(t.sales(), t.cars()))
query("c11_state_distribution", "select state, count(*) as n from car_prices group by 1", "car_prices")(lambda t: agg.value_counts(t.car_prices(), "state"))
query("c11_condition_distribution", "select condition, count(*) as n from car_prices group by 1", "car_prices")(lambda t: agg.value_counts(t.car_prices(), "condition"))
query("c12_mean_price_by_state", "select state, round(avg(sellingprice), 2) as mean from car_prices where state is not null group by 1", "car_prices")(
    lambda t: agg.mean_by(t.car_prices(), "state", "sellingprice").withColumn("mean", F.round("mean", 2))
)
query("c13_top_sellers_by_rows", "select seller, count(*) as n from car_prices group by 1 order by n desc, seller limit 10", "car_prices")(lambda t: agg.top(t.car_prices().groupBy("seller").agg(F.count(F.lit(1)).alias("n")), 10, F.desc("n"), "seller"))
query("c13_top_sellers_by_value", "select seller, round(cast(sum(cast(sellingprice as decimal(14,2))) as double), 2) as value from car_prices group by 1 order by sum(cast(sellingprice as decimal(14,2))) desc, seller limit 10", "car_prices")(
    lambda t: agg.top(t.car_prices().groupBy("seller").agg(F.sum(F.col("sellingprice").cast("decimal(14,2)")).alias("v")), 10, F.desc("v"), "seller").select("seller", commerce.money("v").alias("value"))
)
query(
    "c14_price_histogram",
    """, e as (select min(sellingprice) as lo, max(sellingprice) as hi from car_prices)
    select condition, cast(least(30, floor((sellingprice - lo) / (hi - lo) * 30) + 1) as bigint) as bin, count(*) as n from car_prices, e group by 1, 2""",
    "car_prices",
)(lambda t: agg.histogram(t.car_prices(), "sellingprice", "condition"))
query(
    "c15_profile", "select count(*) as rows, 6 as columns, count(*) - count(nullif(o_orderpriority, '4-NOT SPECIFIED')) as missing_cells from orders",
)(lambda t: agg.profile(t.orders.withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")))))

# ---------------------------------------------------------------- sources and sinks

query("s5_latest_partition", "select o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m') as month from orders where strftime(o_orderdate, '%Y-%m') = (select max(strftime(o_orderdate, '%Y-%m')) from orders)")(
    lambda t: files.latest_partition(t.orders.withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), "month").select("o_orderkey", "o_totalprice", "month")
)
query(
    "s6_completeness",
    """select count(*) filter (where f is null) = 0 as is_valid, count(e) as expected_count, count(f) as actual_count from
    (select distinct r_regionkey + 100 as e from region union all select distinct n_nationkey from nation) x full join (select distinct c_nationkey as f from customer) on e = f""",
)(lambda t: files.completeness(t.customer.select(F.col("c_nationkey").alias("k")), t.nation.select(F.col("n_nationkey").alias("k")).unionByName(t.region.select((F.col("r_regionkey") + 100).alias("k"))), "k").select("is_valid", "expected_count", "actual_count"))

_UPD = """, u as (select c_custkey * 2 as c_custkey, 'new' || c_custkey as c_name, c_acctbal * 2 as c_acctbal, s from customer, (select unnest([1, 2]) as s)), l as (select * from u where s = 2)"""


def _updates(t: Tables) -> DataFrame:
    return t.customer.select((F.col("c_custkey") * 2).alias("c_custkey"), F.concat(F.lit("new"), "c_custkey").alias("c_name"), (F.col("c_acctbal") * 2).alias("c_acctbal"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))


def _with(text: str) -> str:
    return "with " + text.lstrip(", ")


query(
    "k7_upsert",
    _with(_UPD) + """ select coalesce(c.c_custkey, l.c_custkey) as c_custkey, coalesce(l.c_name, c.c_name) as c_name, c.c_nationkey, coalesce(l.c_acctbal, c.c_acctbal) as c_acctbal, c.c_mktsegment
    from customer c full join l on c.c_custkey = l.c_custkey""",
)(lambda t: upsert.upsert(t.customer, _updates(t), ["c_custkey"], ["seq"]))
query(
    "k7_upsert_do_nothing",
    _with(_UPD) + """ select coalesce(c.c_custkey, l.c_custkey) as c_custkey, case when c.c_custkey is null then l.c_name else c.c_name end as c_name, c.c_nationkey,
    case when c.c_custkey is null then l.c_acctbal else c.c_acctbal end as c_acctbal, c.c_mktsegment from customer c full join l on c.c_custkey = l.c_custkey""",
)(lambda t: upsert.upsert(t.customer, _updates(t), ["c_custkey"], ["seq"], updates=[]))
query(
    "k8_upsert_from_staging",
    """with s as (select o_orderkey + 1000 as o_orderkey, o_totalprice + 1 as o_totalprice, 'X' as o_orderstatus from orders)
    select coalesce(o.o_orderkey, s.o_orderkey) as o_orderkey, o.o_custkey, case when o.o_orderkey is null then s.o_orderstatus else o.o_orderstatus end as o_orderstatus, coalesce(s.o_totalprice, o.o_totalprice) as o_totalprice
    from orders o full join s on o.o_orderkey = s.o_orderkey""",
)(
    lambda t: upsert.upsert_from_staging(
        t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), t.orders.select((F.col("o_orderkey") + 1000).alias("o_orderkey"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("X").alias("o_orderstatus")), ["o_orderkey"], ["o_totalprice"]
    )
)
query(
    "k9_delete_insert",
    """select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey not in (select o_orderkey * 3 from orders) union all select o_orderkey * 3, 1, 0.5 from orders""",
)(lambda t: upsert.delete_insert(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), t.orders.select((F.col("o_orderkey") * 3).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.5).alias("l_quantity")), ["l_orderkey"]))

# ---------------------------------------------------------------- conforming


def _untidy(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("Order ID"), F.col("o_totalprice").alias(" Amount ($) "), F.col("o_orderstatus").alias("Order-Status "))


query("p1_snake_names", "select o_orderkey as order_id, o_totalprice as amount, o_orderstatus as order_status from orders")(lambda t: snake_names(_untidy(t)))
query("p2_plain_names", "select o_orderkey as order_id, o_totalprice as amount, o_orderstatus as order_status from orders")(lambda t: plain_names(_untidy(t)))
query(
    "p3_cast_columns",
    """select l_orderkey, try_cast(case when l_linenumber = 3 then 'n/a' else cast(l_quantity as varchar) end as double) as q, try_cast(strftime(l_shipdate, '%Y-%m-%d') as date) as d,
    cast(l_linenumber as varchar) as n from lineitem""",
)(
    lambda t: conform.cast_columns(
        t.lineitem.select("l_orderkey", F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("q"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"), F.col("l_linenumber").alias("n")),
        {"q": "double", "d": "date", "n": "string"},
    )
)
query("p3_lost_in_cast", "select count(*) filter (where l_linenumber = 3) as q from lineitem")(lambda t: conform.lost_in_cast(t.lineitem.select(F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("q")), {"q": "double"}))
query("p4_numeric_where_whole", "select l_orderkey, l_quantity as a, case when l_linenumber = 3 then 'n/a' else 'x' end as b from lineitem")(
    lambda t: conform.numeric_where_whole(t.lineitem.select("l_orderkey", F.col("l_quantity").cast("string").alias("a"), F.when(F.col("l_linenumber") == 3, "n/a").otherwise("x").alias("b")))[0]
)


def _holes(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("A")).alias("flag"), F.nullif("l_quantity", F.lit(10.0)).alias("quantity"), F.nullif("l_tax", F.lit(0.05)).alias("tax"))


_HOLES = "with h as (select l_orderkey, l_linenumber, nullif(l_returnflag, 'A') as flag, nullif(l_quantity, 10) as quantity, nullif(l_tax, 0.05) as tax from lineitem) "
query("p5_handle_nulls", _HOLES + "select l_orderkey, l_linenumber, coalesce(flag, 'none') as flag, quantity, coalesce(tax, 0) as tax from h where quantity is not null")(lambda t: conform.handle_nulls(_holes(t), {"quantity": "drop", "flag": "none", "tax": 0}))
query("p6_drop_any", _HOLES + "select * from h where flag is not null and quantity is not null and tax is not null")(lambda t: conform.handle_missing(_holes(t), "drop_any"))
query("p6_drop_all", "select nullif(l_returnflag, 'A') as flag, nullif(l_quantity, 10) as quantity from lineitem where not (l_returnflag = 'A' and l_quantity = 10)")(lambda t: conform.handle_missing(_holes(t).select("flag", "quantity"), "drop_all"))
query("p6_fill_mean", _HOLES + ", m as (select avg(quantity) as q, avg(tax) as x from h) select l_orderkey, flag, round(coalesce(quantity, q), 6) as quantity, round(coalesce(tax, x), 6) as tax from h, m")(
    lambda t: conform.handle_missing(_holes(t), "fill_mean").select("l_orderkey", "flag", F.round("quantity", 6).alias("quantity"), F.round("tax", 6).alias("tax"))
)
query("p7_addresses", "select c_custkey, upper(c_name) as c_name, c_mktsegment from customer")(lambda t: conform.standardize_addresses(t.customer.select("c_custkey", F.concat(F.lit("  "), F.lower("c_name"), F.lit(" ")).alias("c_name"), "c_mktsegment"), ["c_name", "absent"]))
query("p8_codes", "select event_id, lower(event_type) as status from events")(lambda t: t.events.select("event_id", fn.standard_code(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))).alias("status")))
query(
    "p10_age_band", """, a as (select patient_id, nullif(age, 50) as age from patients) select patient_id, age, case when age is null then '70+' when age < 18 then '<18' when age < 30 then '18-29' when age < 40 then '30-39' when age < 50 then '40-49'
    when age < 60 then '50-59' when age < 70 then '60-69' else '70+' end as age_group from a""", "patients",
)(lambda t: t.patients().select("patient_id", F.nullif("age", F.lit(50)).alias("age")).withColumn("age_group", fn.age_band("age")))
query("p11_price_tier", "select p_partkey, case when p_retailprice <= 1000 then 'Low' when p_retailprice <= 1500 then 'Medium' else 'High' end as tier from part")(lambda t: t.part.select("p_partkey", fn.price_tier("p_retailprice", 1000, 1500).alias("tier")))


@query("p11_price_tier_cuts", "select tier, count(*) between n * (s - 0.02) and n * (s + 0.02) as near from (select unnest(['Low', 'Medium', 'High']) as tier, unnest([0.33, 0.34, 0.33]) as s), (select count(*) as n from part), part "
       "where case when p_retailprice <= (select quantile_disc(p_retailprice, 0.33) from part) then 'Low' when p_retailprice <= (select quantile_disc(p_retailprice, 0.67) from part) then 'Medium' else 'High' end = tier group by tier, n, s")  # fmt: skip
def _tier(t: Tables) -> DataFrame:
    """Tiers by cuts from a sketch hold their shares of the parts within its error."""
    low, high = agg.quantile_cuts(t.part, "p_retailprice")
    share = F.when(F.col("tier") == "Medium", 0.34).otherwise(0.33)
    tiers = t.part.select(fn.price_tier("p_retailprice", low, high).alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return agg.with_total(tiers, "n").select("tier", F.col("n").between(F.col("total") * (share - 0.02), F.col("total") * (share + 0.02)).alias("near"))


query("p12_size_band", "select p_partkey, cast(p_size * 10 * (p_size % 7) as bigint) as v, case when p_size * 10 * (p_size % 7) < 1000 then 'Small' when p_size * 10 * (p_size % 7) < 10000 then 'Medium' else 'Large' end as size from part")(
    lambda t: t.part.select("p_partkey", fn.volume("p_size", F.lit(10), F.col("p_size") % 7).cast("long").alias("v")).withColumn("size", fn.size_band("v"))
)
query("p13_delivery_days", "select order_id, delivery_days from fact_orders", "fact_orders")(lambda t: t.fact_orders().select("order_id", fn.days_between("order_delivered_customer_date", "order_purchase_timestamp").cast("long").alias("delivery_days")))
query("p14_is_delayed", "select order_id, is_delayed from fact_orders", "fact_orders")(lambda t: t.fact_orders().select("order_id", fn.is_late("order_delivered_customer_date", "order_estimated_delivery_date").alias("is_delayed")))
query("p15_date_parts", "select event_id, year(ts) as ts_year, month(ts) as ts_month, day(ts) as ts_day, quarter(ts) as ts_quarter from events")(
    lambda t: conform.add_date_parts(t.events.select("event_id", "ts"), "ts").select("event_id", *[F.col(f"ts_{p}").cast("long").alias(f"ts_{p}") for p in ("year", "month", "day", "quarter")])
)
query("p16_surrogate_key", "select l_orderkey, l_linenumber, md5(concat_ws('_', l_orderkey, nullif(l_returnflag, 'A'), l_linenumber)) as k from lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", fn.surrogate_key("l_orderkey", F.nullif("l_returnflag", F.lit("A")), "l_linenumber").alias("k"))
)
query("p17_email_domain", "select event_id, case when event_type = 'click' then '' else event_type || '.example.com' end as domain from events")(
    lambda t: t.events.select("event_id", fn.email_domain(F.when(F.col("event_type") == "click", F.lit("none")).otherwise(F.concat(F.lit("user"), "user_id", F.lit("@"), "event_type", F.lit(".example.com")))).alias("domain"))
)
query("p18_parse_json", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")(lambda t: conform.parse_json(t.events.select("event_id", "props"), "props", "k bigint", flatten=True))
query("p18_json_map", "select event_id, 'k' as key, json_extract_string(props, '$.k') as value from events")(lambda t: conform.parse_json(t.events.select("event_id", "props"), "props", flatten=True))
query("p19_line_total", "select order_id, product_id, cast(price + freight_value as double) as total from fact_order_items", "fact_order_items")(lambda t: t.fact_order_items().select("order_id", "product_id", (F.col("price") + F.col("freight_value")).cast("double").alias("total")))
query("p20_amount", "select l_orderkey, round(l_quantity * p_retailprice, 4) as amount from lineitem join part on l_partkey = p_partkey where l_quantity > 0 and p_retailprice >= 0")(
    lambda t: quality.split_rows(t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")), {"quantity": F.col("l_quantity") > 0, "price": F.col("p_retailprice") >= 0})[0].select("l_orderkey", F.round(F.col("l_quantity") * F.col("p_retailprice"), 4).alias("amount"))
)
query("p21_clean", "select distinct l_orderkey as order_id, l_quantity as amount, nullif(l_returnflag, 'A') as flag from lineitem")(
    lambda t: conform.clean(t.lineitem.select(F.col("l_orderkey").alias("Order ID"), F.col("l_quantity").cast("string").alias("Amount $"), F.nullif("l_returnflag", F.lit("A")).alias("Flag ")))[0]
)

# ---------------------------------------------------------------- star schema


def _raw_orders(t: Tables) -> DataFrame:
    """Orders as untyped rows with an exact copy and a later, delivered version of each."""
    ship = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("s"))
    o = t.orders.join(ship, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("v", F.explode(F.array(F.lit(0), F.lit(0), F.lit(1))))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    bought = F.col("o_orderdate") + F.make_interval(days="v")
    return o.select(
        F.col("o_orderkey").cast("string").alias("Order ID"), F.col("o_custkey").cast("string").alias("customer_id"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(" "), "o_orderstatus")).alias("order_status"),
        text(bought).alias("order_purchase_timestamp"), text("s").alias("order_delivered_customer_date"), text(F.col("o_orderdate") + F.expr("interval 30 days")).alias("order_estimated_delivery_date"),
    )


_FACT = """, f as (select cast(order_id as varchar) as order_id, cast(customer_id as varchar) as customer_id, {status} as order_status, {bought} as order_purchase_timestamp,
      order_delivered_customer_date, order_estimated_delivery_date from fact_orders)"""
query(
    "b1_fact_orders",
    _FACT.format(status="case when order_status = 'P' then 'unknown' else ' ' || order_status end", bought="order_purchase_timestamp")
    + """select *, date_diff('day', cast(order_purchase_timestamp as date), cast(order_delivered_customer_date as date)) as delivery_days, coalesce(order_delivered_customer_date > order_estimated_delivery_date, false) as is_delayed,
    year(order_purchase_timestamp) as order_year, month(order_purchase_timestamp) as order_month, quarter(order_purchase_timestamp) as order_quarter from f""",
    "fact_orders",
)(lambda t: star.fact_orders(_raw_orders(t)))
query(
    "b2_dim_customers",
    """select cast(c_custkey as varchar) as customer_id, 'u' || c_custkey || '-0' as customer_unique_id, case when c_mktsegment = 'BUILDING' then 'Unknown' else c_mktsegment end as customer_city,
    case when c_nationkey = 3 then 'UNKNOWN' else 'N' || c_nationkey end as customer_state, md5(cast(c_custkey as varchar)) as customer_key from customer""",
)(
    lambda t: star.dim_customers(
        t.customer.withColumn("v", F.explode(F.array(F.lit(1), F.lit(0)))).select(F.col("c_custkey").alias("Customer ID"), F.concat(F.lit("u"), "c_custkey", F.lit("-"), "v").alias("customer_unique_id"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("customer_city"),
                          F.when(F.col("c_nationkey") != 3, F.concat(F.lit("n"), "c_nationkey")).alias("customer_state"))
    )
)
query(
    "b3_dim_products",
    """select p_partkey as product_id, p_type as product_category_name, case when p_type = 'PROMO' then null else lower(p_type) end as product_category_name_english, cast(p_size as double) as product_length_cm, 20.0::double as product_height_cm,
    cast(p_size % 9 as double) as product_width_cm, cast(p_size * 20 * (p_size % 9) as double) as product_volume_cm3, case when p_size * 20 * (p_size % 9) < 1000 then 'Small' when p_size * 20 * (p_size % 9) < 10000 then 'Medium' else 'Large' end as product_size_category,
    md5(cast(p_partkey as varchar)) as product_key from part""",
)(
    lambda t: star.dim_products(
        t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("product_category_name"), F.col("p_size").cast("string").alias("product_length_cm"), F.lit("20").alias("product_height_cm"), (F.col("p_size") % 9).cast("string").alias("product_width_cm"))
        .withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy"),
        t.part.where("p_type <> 'PROMO'").select(F.col("p_type").alias("product_category_name"), F.lower("p_type").alias("product_category_name_english")).distinct(),
    )
)
query("b4_dim_sellers", "select cast(s_suppkey as varchar) as seller_id, upper(n_name) as seller_state, md5(cast(s_suppkey as varchar)) as seller_key from supplier join nation on s_nationkey = n_nationkey")(
    lambda t: star.dim_sellers(t.dim_sellers().select("seller_id", F.lower("seller_state").alias("seller_state")).unionByName(t.dim_sellers()))
)
query(
    "b5_fact_order_items",
    """, i as (select cast(l_orderkey * 2 as varchar) as order_id, l_linenumber as order_item_id, l_extendedprice as price, l_tax as freight_value from lineitem)
    select i.*, price + freight_value as total_value, order_year, order_month from i left join fact_orders f on i.order_id = cast(f.order_id as varchar)""",
    "fact_orders",
)(
    lambda t: star.fact_order_items(
        t.lineitem.select((F.col("l_orderkey") * 2).cast("string").alias("order_id"), F.col("l_linenumber").cast("string").alias("order_item_id"), F.col("l_extendedprice").cast("string").alias("price"), F.col("l_tax").cast("string").alias("freight_value")),
        t.fact_orders().withColumn("order_id", F.col("order_id").cast("string")),
    )
)
_STAGED = _FACT.format(status="case when order_status <> 'P' then lower(order_status) end", bought="order_purchase_timestamp + interval 1 day")
query("b6_staged_orders", _STAGED + "select * from f", "fact_orders")(lambda t: star.staged_orders(snake_names(_raw_orders(t))))
query("b7_order_mart", _STAGED + "select *, coalesce(order_delivered_customer_date > order_estimated_delivery_date, false) as is_delayed from f", "fact_orders")(lambda t: star.order_mart(star.staged_orders(snake_names(_raw_orders(t)))))

# ---------------------------------------------------------------- joins, aggregates, windows, sets

query("j3_star_join", "select r_name, n_name, count(*) as n, round(cast(sum(cast(l_extendedprice as decimal(14,2))) as double), 2) as revenue from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")(
    lambda t: t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name")
    .agg(F.count(F.lit(1)).alias("n"), commerce.money(F.sum(F.col("l_extendedprice").cast("decimal(14,2)"))).alias("revenue"))
)
query("j4_orphans", "select o_orderkey, nullif(o_custkey, 5) as o_custkey from orders where nullif(o_custkey, 5) is null or o_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')")(
    lambda t: quality.orphans(t.orders.select("o_orderkey", F.nullif("o_custkey", F.lit(5)).alias("o_custkey")), "o_custkey", t.customer.where("c_mktsegment <> 'BUILDING'"), "c_custkey")
)
query("j5_semi_join", "select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')")(
    lambda t: t.lineitem.join(t.orders.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")
)
query(
    "a1_daily_rollup", "select cast(ts as date) as date, event_type, round(sum(value), 2) as value_sum, round(avg(value), 2) as value_avg, count(value) as value_count, min(value) as value_min, max(value) as value_max, count(user_id) as user_id_count from events group by 1, 2",
)(lambda t: agg.daily_rollup(t.events, "ts", ["event_type"], {"value": ["sum", "avg", "count", "min", "max", "other"], "user_id": ["count"]}).withColumns({c: F.round(c, 2) for c in ("value_sum", "value_avg")}))


def _running(t: Tables) -> DataFrame:
    """Running totals over all orders, and within each status, by day."""
    o = t.orders.select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(14,2)").alias("price"))
    names = ["o_orderkey", "o_orderstatus", "day", "price"]
    o = ordered(o, ["day"], (), ["o_orderkey"], "price").select(*names, F.col("__running").cast("double").alias("upto"), F.round(F.col("price").cast("double") / F.col("__total").cast("double"), 12).alias("share"))
    return ordered(o, ["day"], ["o_orderstatus"], ["o_orderkey"], "price").select("o_orderkey", "upto", F.col("__running").cast("double").alias("of_status"), "share")


query("a8_percentiles", "select l_returnflag, quantile_cont(l_extendedprice, 0.5) as p50, quantile_cont(l_extendedprice, 0.95) as p95 from lineitem group by 1")(
    lambda t: percentiles(t.lineitem, "l_extendedprice", {"p50": 0.5, "p95": 0.95}, ["l_returnflag"])
)
_PLACES = "row_number() over (order by o_custkey, o_orderkey) as place, rank() over (order by o_custkey) as rnk, dense_rank() over (order by o_custkey) as dense, round(percent_rank() over (order by o_custkey), 9) as share, ntile(5) over (order by o_custkey, o_orderkey) as fifth"
query("w8_ranks", f"select o_orderkey, {_PLACES}, lag(o_orderkey, 12) over (order by o_custkey, o_orderkey) as back from orders")(
    lambda t: lagged(ordered(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], (), ["o_orderkey"]), "o_orderkey", 12, "back").select(
        "o_orderkey", F.col("__place").alias("place"), F.col("__rank").alias("rnk"), F.col("__dense").alias("dense"), F.round(percent_rank(), 9).alias("share"), tile(5).cast("long").alias("fifth"), "back")
)
_PRICE = "cast(o_totalprice as decimal(14,2))"
query(
    "w7_running_total",
    f"""select o_orderkey, cast(sum({_PRICE}) over (order by cast(o_orderdate as date) range unbounded preceding) as double) as upto, cast(sum({_PRICE}) over (partition by o_orderstatus order by cast(o_orderdate as date) range unbounded preceding) as double) as of_status,
    round(cast({_PRICE} as double) / cast(sum({_PRICE}) over () as double), 12) as share from orders""",
)(lambda t: _running(t))
query("a16_missing_cells", _HOLES + "select count(*) as rows, 5 as columns, count(*) - count(flag) + count(*) - count(quantity) + count(*) - count(tax) as missing_cells from h")(lambda t: agg.profile(_holes(t)))
_DUP = "select *, row_number() over (partition by l_orderkey, l_linenumber order by {o}, l_partkey {d}, l_suppkey {d}, l_extendedprice {d}, l_quantity {d}) as k from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, nullif(l_shipdate, timestamp '1998-01-01') as shipped from lineitem)"


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", F.nullif("l_shipdate", F.lit("1998-01-01").cast("timestamp")).alias("shipped"))


_REST = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
query("w1_keep_first", f"select * exclude (k) from ({_DUP.format(o='shipped nulls first', d='')}) where k = 1")(lambda t: dedupe.keep_first(_lines(t), ["l_orderkey", "l_linenumber"], ["shipped", *_REST]))
query("w2_keep_last", f"select * exclude (k) from ({_DUP.format(o='shipped desc nulls last', d='desc')}) where k = 1")(lambda t: dedupe.keep_last(_lines(t), ["l_orderkey", "l_linenumber"], ["shipped", *_REST]))
query("t5_distinct_rows", "select distinct l_orderkey, l_returnflag, l_linestatus from lineitem")(lambda t: dedupe.distinct_rows(t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus")))
query("t7_distinct_keys", "select distinct l_partkey, l_suppkey from lineitem")(lambda t: dedupe.distinct_keys(t.lineitem, ["l_partkey", "l_suppkey"]))
query("t8_stacked", "select o_orderkey as k, o_orderstatus as status, null as flag from orders union all select l_orderkey, null, l_returnflag from lineitem")(
    lambda t: dedupe.stacked(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status")), t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("flag")))
)
query("t9_set_difference", "select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'P'")(lambda t: dedupe.set_difference(t.customer.select(F.col("c_custkey").alias("k")), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))))

# ---------------------------------------------------------------- scalar functions

query("f6_elapsed_days", "select event_id, cast(floor(epoch_us(timestamp '2024-02-01 00:00:00') / 86400000000.0 - epoch_us(ts) / 86400000000.0) as bigint) as days from events")(
    lambda t: t.events.select("event_id", fn.whole_days_between(F.lit("2024-02-01").cast("timestamp"), "ts").alias("days"))
)
query("f16_messy_dates", "select o_orderkey, o_orderdate as t from orders")(
    lambda t: t.orders.select(
        "o_orderkey",
        fn.messy_timestamp(
            F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.date_format("o_orderdate", "EEE MMM dd yyyy HH:mm:ss"), F.lit(" GMT+0000 (UTC)"))).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
        ).alias("t"),
    )
)
query("f17_blanks", "select o_orderkey, o_orderkey % 5 in (0, 1) as blank from orders")(
    lambda t: t.orders.select("o_orderkey", fn.is_blank(F.when(F.col("o_orderkey") % 5 == 0, "  ").when(F.col("o_orderkey") % 5 == 1, " NaN ").otherwise(F.col("o_orderstatus"))).alias("blank"))
)

# ---------------------------------------------------------------- quality


def _checked(t: Tables) -> DataFrame:
    c = quality.Checks(_holes(t)).row_count(100).null_share("flag", 0.1).null_share("tax", 0.5).value_range("quantity", 0, 49).completeness(0.5)
    return c.duplicates(["l_orderkey", "l_linenumber"]).results()


query(
    "q1_checks",
    _HOLES + """, n as (select count(*) as n, count(flag) as f, count(tax) as x, count(quantity) as q, count(*) filter (where quantity < 0 or quantity > 49) as o, (select count(*) from (select distinct l_orderkey, l_linenumber from h)) as d from h)
    select 'row_count' as "check", n >= 100 as passed, cast(n as double) as value, 100.0::double as bound from n union all select 'null_share:flag', 1 - f / n <= 0.1, round(1 - f / n, 6), 0.1 from n
    union all select 'null_share:tax', 1 - x / n <= 0.5, round(1 - x / n, 6), 0.5 from n union all select 'value_range:quantity', o = 0, o, 0 from n
    union all select 'completeness', (2 * n + f + x + q) / (5 * n) >= 0.5, round((2 * n + f + x + q) / (5 * n), 6), 0.5 from n union all select 'duplicates:l_orderkey,l_linenumber', (n - d) / n <= 0.01, round((n - d) / n, 6), 0.01 from n""",
)(lambda t: _checked(t).select("check", "passed", F.round("value", 6).alias("value"), "bound"))
query("q6_references", "select 'references:o_custkey' as \"check\", count(*) = 0 as passed, cast(count(*) as double) as value from orders where o_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')")(
    lambda t: quality.Checks(t.orders).references("o_custkey", t.customer.where("c_mktsegment <> 'BUILDING'"), "c_custkey").results().select("check", "passed", "value")
)
query("q7_freshness", "select 'freshness:o_orderdate' as \"check\", date_diff('day', cast(max(o_orderdate) as date), date '2002-01-01') <= 30 as passed, cast(date_diff('day', cast(max(o_orderdate) as date), date '2002-01-01') as double) as value from orders")(
    lambda t: quality.Checks(t.orders).freshness("o_orderdate", AS_OF, 30).results().select("check", "passed", "value")
)
query(
    "q8_summary",
    _HOLES + """, n as (select count(*) as n, count(flag) as f, count(tax) as x, count(*) filter (where quantity < 0 or quantity > 49) as o, (select count(*) from (select distinct l_orderkey, l_linenumber from h)) as d from h),
    p as (select (n >= 100)::int + (1 - f / n <= 0.1)::int + (1 - x / n <= 0.5)::int + (o = 0)::int + 1 + ((n - d) / n <= 0.01)::int as k from n)
    select 6 as total, k as passed, 6 - k as failed, round(k * 100.0 / 6, 4) as success_rate, k = 6 as all_passed from p""",
)(lambda t: quality.summary(_checked(t)).withColumn("success_rate", F.round("success_rate", 4)))
_CONTRACT = quality.Contract(required_columns=("flag", "quantity"), unique_columns=("l_orderkey",), max_null_ratio=0.2, allowed_values={"flag": ("R",)}, allow_extra_columns=False)
query(
    "q12_contract",
    _HOLES + """, n as (select count(*) as n, count(flag) as f from h), d as (select coalesce(sum(c - 1), 0) as d from (select count(*) as c from h group by l_orderkey))
    select 'extra_columns' as rule, unnest(['l_orderkey', 'l_linenumber', 'tax']) as "column", 1.0::double as found union all select 'max_null_ratio', 'flag', round(1 - f / n, 6) from n where 1 - f / n > 0.2
    union all select 'allowed_values', 'flag', cast(count(*) as double) from h where flag <> 'R' union all select 'unique_columns', 'l_orderkey', cast(d as double) from d""",
)(lambda t: quality.contract_violations(_holes(t), _CONTRACT).select("rule", "column", F.round("found", 6).alias("found")))
query("q14_unique", "select l_orderkey, count(*) as n_records from lineitem group by 1 having count(*) > 1")(lambda t: quality.failing_unique(t.lineitem, "l_orderkey"))
query("q14_accepted", "select o_orderpriority as value_field, count(*) as n_records from orders where o_orderpriority not in ('1-URGENT', '2-HIGH') group by 1")(lambda t: quality.failing_accepted(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"]))
query("q14_not_null", _HOLES + "select * from h where flag is null")(lambda t: quality.failing_not_null(_holes(t), "flag"))
query(
    "q16_rejected_rows", _HOLES + "select l_orderkey, l_linenumber, concat_ws(',', case when quantity is null or quantity > 40 then 'quantity' end, case when flag is null then 'flag' end) as reasons from h where quantity is null or quantity > 40 or flag is null",
)(lambda t: quality.split_rows(_holes(t), {"quantity": F.col("quantity") <= 40, "flag": F.col("flag").isNotNull()})[1].select("l_orderkey", "l_linenumber", F.array_join("reasons", ",").alias("reasons")))

# ---------------------------------------------------------------- runs on tables


def _run_events(t: Tables) -> DataFrame:
    """Events as a run ledger: each event starts a run and, a second later, ends it."""
    e = t.events.withColumn("phase", F.explode(F.array(F.lit(0), F.lit(1))))
    end = F.when(F.col("event_type") == "error", "failed").otherwise("succeeded")
    return e.select(
        F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("dataset"), F.concat(F.lit("u"), "user_id").alias("source_uri"), F.col("props").alias("source_checksum"), F.lit("v1").alias("version"),
        F.when(F.col("phase") == 0, "running").otherwise(end).alias("status"), (F.col("ts") + F.make_interval(secs="phase")).alias("at"), F.when(F.col("phase") == 1, F.col("user_id")).alias("rows_out"),
    )


_DONE = """with c as (select *, row_number() over (partition by event_type, user_id order by ts desc, event_id) as k from events where event_type <> 'error')"""
query(
    "i1_to_process",
    _DONE + """ select e.event_id, e.event_type as dataset, 'u' || e.user_id as source_uri from events e left join c on c.k = 1 and c.event_type = e.event_type and c.user_id = e.user_id and c.props = e.props where c.event_id is null""",
)(
    lambda t: runs.to_process(
        t.events.select("event_id", F.col("event_type").alias("dataset"), F.concat(F.lit("u"), "user_id").alias("source_uri"), F.col("props").alias("source_checksum"), F.lit("v1").alias("version")), runs.checkpoints(_run_events(t))
    ).select("event_id", "dataset", "source_uri")
)
query("i5_checkpoints", _DONE + " select event_type as dataset, 'u' || user_id as source_uri, cast(event_id as varchar) as run_id, props as source_checksum from c where k = 1")(
    lambda t: runs.checkpoints(_run_events(t)).select("dataset", "source_uri", "run_id", "source_checksum")
)
query("i4_ledger_state", "select cast(event_id as varchar) as run_id, case when event_type = 'error' then 'failed' else 'succeeded' end as status from events")(lambda t: runs.latest(_run_events(t), ["run_id"]).select("run_id", "status"))
query("i7_quarantined", _HOLES + "select case when flag is null then 'flag' end as reason, count(*) as n from h where flag is null group by 1")(
    lambda t: quality.split_rows(_holes(t), {"flag": F.col("flag").isNotNull()})[1].groupBy(F.array_join("reasons", ",").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
)
query(
    "i8_resolvable",
    """with q as (select event_id, user_id, ts from events where event_type = 'error'), g as (select event_id, user_id, ts + interval 1 second as at from events where event_type <> 'error'),
    j as (select q.event_id, cast(g.event_id as varchar) as run, row_number() over (partition by q.event_id order by g.at, cast(g.event_id as varchar)) as k from q left join g on g.user_id = q.user_id and g.at > q.ts)
    select cast(event_id as varchar) as id, run as by_run from j where k = 1""",
)(
    lambda t: runs.resolvable(
        t.events.where("event_type = 'error'").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("dataset"), F.lit("pending").alias("status"), F.col("ts").alias("at")),
        t.events.where("event_type <> 'error'").select(F.col("event_id").cast("string").alias("run_id"), F.col("user_id").cast("string").alias("dataset"), F.lit("succeeded").alias("status"), (F.col("ts") + F.expr("interval 1 second")).alias("at")),
    ).select("id", "by_run")
)
query("i9_outcomes", "select case when event_type = 'error' then 'failed' else 'succeeded' end as status, count(*) as runs, cast(sum(user_id) as bigint) as rows_out from events group by 1")(lambda t: runs.outcomes(_run_events(t)))

# ---------------------------------------------------------------- service levels

query("r3_hourly_counts", "select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by 1, 2")(lambda t: slo.windowed_counts(t.events, "1 hour", by=("event_type",)).drop("window_end"))
query("r3_sliding_counts", "select time_bucket(interval 15 minute, ts) - o * interval 15 minute as window_start, count(*) as n from events, (select unnest([0, 1, 2, 3]) as o) group by 1")(lambda t: slo.windowed_counts(t.events, "1 hour", "15 minutes").drop("window_end"))
_HOURS = """, w as (select date_trunc('hour', ts) as window_start, count(*) filter (where status = 'failed') as failed, count(*) as runs from job_runs group by 1)"""
query("r4_failure_ratio", _HOURS + "select window_start, failed, runs, round(failed / greatest(runs, 1), 6) as failure_ratio, round(failed / greatest(runs, 1) / (1 - 0.995::double), 4) as budget_burn from w", "job_runs")(lambda t: slo.failure_ratio(t.job_runs(), "1 hour"))
query(
    "r5_latency", """select date_trunc('hour', ts) as window_start, round(quantile_cont(duration, 0.95), 4) as p95, round(quantile_cont(duration, 0.99), 4) as p99, quantile_cont(duration, 0.95) > 300 as p95_breached,
    quantile_cont(duration, 0.99) > 600 as p99_breached from job_runs group by 1""", "job_runs",
)(lambda t: slo.latency(t.job_runs(), "1 hour"))
query(
    "r6_freshness", """, l as (select source, max(ts) filter (where status = 'succeeded') as m from job_runs group by 1) select source, cast(epoch(timestamp '2024-02-01 00:00:00' - date_trunc('second', m)) as bigint) as lag_seconds,
    coalesce(epoch(timestamp '2024-02-01 00:00:00' - date_trunc('second', m)) > 3600, true) as stale from l""", "job_runs",
)(lambda t: slo.freshness(t.job_runs(), "2024-02-01"))
query(
    "r7_drift", """with a as (select l_suppkey % 25 as k, count(*) as actual from lineitem group by 1), e as (select c_nationkey as k, count(*) * 40 as expected from customer group by 1)
    select coalesce(a.k, e.k) as k, coalesce(actual, 0) as actual, coalesce(expected, 0) as expected, round(abs(coalesce(actual, 0) - coalesce(expected, 0)) / greatest(coalesce(expected, 0), 1), 6) as drift,
    abs(coalesce(actual, 0) - coalesce(expected, 0)) / greatest(coalesce(expected, 0), 1) > 0.2 as breached from a full join e on a.k = e.k""",
)(lambda t: slo.drift(t.lineitem.select((F.col("l_suppkey") % 25).alias("k")), t.customer.select(F.col("c_nationkey").cast("long").alias("k")).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(40)))), "k"))
query("r8_dead_letters", "select event_type as dataset, count(*) filter (where value > 400) as depth, count(*) filter (where value > 400) > 0 as breached from events group by 1")(
    lambda t: slo.dead_letters(t.events.select(F.col("event_type").alias("dataset"), F.when(F.col("value") > 400, "pending").otherwise("replayed").alias("status")))
)
query(
    "r9_sustained", _HOURS + """, h as (select *, epoch(window_start) / 3600 - row_number() over (order by window_start) as g from w where failed >= 3)
    select min(window_start) as first_start, max(window_start) as last_start, count(*) as windows from h group by g having count(*) >= 2""", "job_runs",
)(lambda t: slo.sustained(slo.failure_ratio(t.job_runs(), "1 hour"), F.col("failed") >= 3, 3600, 7200))

# ---------------------------------------------------------------- marts

query(
    "m1_dim_dates",
    """with d as (select cast(unnest(generate_series(date '1995-01-01', date '2001-12-31', interval 1 day)) as date) as date), t as (select distinct cast(l_shipdate as date) as date, true as x from lineitem)
    select d.date, cast(strftime(d.date, '%Y%m%d') as bigint) as date_key, year(d.date) as year, quarter(d.date) as quarter, month(d.date) as month, day(d.date) as day, weekofyear(d.date) as iso_week, isodow(d.date) as iso_weekday, isodow(d.date) >= 6 as is_weekend,
    d.date in (date '1996-12-25', date '1997-12-25') as is_holiday, year(d.date) // 10 * 10 as decade, cast(ceil(year(d.date) / 100) as bigint) as century, coalesce(x, false) as is_trading_day from d left join t using (date)""",
)(lambda t: marts.dim_dates(t.spark, "1995-01-01", "2001-12-31", ["1996-12-25", "1997-12-25"], t.stock_prices()))
query(
    "m2_daily_prices",
    """, b as (select *, lag(price) over w as before, lag(volume) over w as vb from stock_prices window w as (partition by stock order by day)),
    r as (select *, (cast(price as double) - cast(before as double)) / nullif(cast(before as double), 0) as r from b)
    select stock, day, cast(price as double) as price, round(cast(price as double) - cast(before as double), 2) as change, round(r * 100, 2) as change_pct, round((cast(volume as double) - cast(vb as double)) / nullif(cast(vb as double), 0) * 100, 2) as volume_change_pct,
    round(stddev_samp(r) over (partition by stock order by day rows between 19 preceding and current row), 3) as volatility, price > before as is_up_day from r""",
    "stock_prices",
)(lambda t: marts.daily_prices(t.stock_prices()))
query(
    "m3_monthly_prices",
    """, b as (select *, lag(price) over (partition by stock order by day) as before from stock_prices)
    select stock, cast(date_trunc('month', day) as date) as month, cast(arg_min(price, day) as double) as open, cast(max(price) as double) as high, cast(min(price) as double) as low, cast(arg_max(price, day) as double) as close,
    cast(sum(volume) as double) as volume, count(*) filter (where price > before) as up_days, count(*) filter (where price < before) as down_days from b group by 1, 2""",
    "stock_prices",
)(lambda t: marts.monthly_prices(t.stock_prices()))
query(
    "m4_temperatures",
    """, w as (select *, cast(sum(celsius) over m as double) / count(*) over m as mean, max(celsius) over e as hi, min(celsius) over e as lo from temperatures
      window m as (partition by location, month(day)), e as (partition by location order by day rows between unbounded preceding and 1 preceding))
    select location, day, cast(celsius as double) as celsius, round(cast(celsius as double) * 9 / 5 + 32, 2) as fahrenheit, round(cast(celsius as double) - mean, 6) as anomaly, cast(celsius as double) > mean as above_average,
    coalesce(celsius > hi, false) as record_high, coalesce(celsius < lo, false) as record_low from w""",
    "temperatures",
)(lambda t: marts.temperatures(t.temperatures()))
query(
    "m5_yearly_temperatures",
    """, m as (select location, year(day) as year, month(day) as month, round(cast(sum(celsius) as double) / count(*), 4) as mean, min(celsius) as lo, max(celsius) as hi from temperatures group by 1, 2, 3)
    select location, year, round(avg(mean), 2) as mean_celsius, cast(max(hi) - min(lo) as double) as range_celsius, round(var_samp(mean), 2) as variance, arg_max(month, mean * 100 + month / 1000) as warmest_month,
    arg_min(month, mean * 100 + month / 1000) as coldest_month, round(regr_slope(mean, month), 2) as trend, round(count(*) * 100 / 12, 2) as completeness_pct from m group by 1, 2""",
    "temperatures",
)(lambda t: marts.yearly_temperatures(t.temperatures()))
query(
    "m6_global_temperatures",
    """select day, round(cast(sum(celsius) as double) / count(*), 6) as global_mean, round(cast(sum(celsius) filter (where latitude >= 0) as double) / nullif(count(*) filter (where latitude >= 0), 0), 6) as north_mean,
    round(cast(sum(celsius) filter (where latitude < 0) as double) / nullif(count(*) filter (where latitude < 0), 0), 6) as south_mean, round(cast(sum(celsius) filter (where abs(latitude) <= 23.5) as double) / nullif(count(*) filter (where abs(latitude) <= 23.5), 0), 6) as tropics_mean,
    year(day) // 10 * 10 as decade, cast(ceil(year(day) / 100) as bigint) as century from temperatures group by day""",
    "temperatures",
)(lambda t: marts.global_temperatures(t.temperatures()))
query("m7_match_results", "select match_id, league, season, home, away, home_goals + away_goals as total_goals, home_goals - away_goals as goal_difference, home_goals > away_goals as home_win, home_goals < away_goals as away_win, home_goals = away_goals as draw from matches", "matches")(
    lambda t: marts.match_results(t.matches())
)
query(
    "m8_standings",
    """, s as (select league, season, home as team, home_goals as o, away_goals as x from matches union all select league, season, away, away_goals, home_goals from matches)
    select league, season, team, count(*) as played, count(*) filter (where o > x) as wins, count(*) filter (where o = x) as draws, count(*) filter (where o < x) as losses, cast(sum(o) as bigint) as goals_for, cast(sum(x) as bigint) as goals_against,
    cast(sum(o - x) as bigint) as goal_difference, 3 * count(*) filter (where o > x) + count(*) filter (where o = x) as points, count(*) filter (where x = 0) as clean_sheets from s group by 1, 2, 3""",
    "matches",
)(lambda t: marts.standings(t.matches()))
query(
    "m9_patients",
    """select patient_id, age, case when age < 18 then '<18' when age < 30 then '18-29' when age < 40 then '30-39' when age < 50 then '40-49' when age < 60 then '50-59' when age < 70 then '60-69' else '70+' end as age_group, code,
    case code when 'E11' then 'Type 2 diabetes' when 'I10' then 'Hypertension' when 'J45' then 'Asthma' else 'Examination' end as description, code <> 'Z00' as has_chronic_disease,
    case when code <> 'Z00' and age >= 65 then 'High' when code <> 'Z00' or age >= 65 then 'Medium' when age >= 40 then 'Moderate' else 'Low' end as risk_level from patients""",
    "patients",
)(lambda t: marts.patients(t.patients()))
query("m10_segment_dim", "select distinct c_mktsegment, c_nationkey, md5(concat_ws('_', c_mktsegment, c_nationkey)) as segment_key from customer")(lambda t: marts.attribute_dim(t.customer, ["c_mktsegment", "c_nationkey"], "segment_key"))

from . import trips  # noqa: E402, F401  registers its queries, which need query()
