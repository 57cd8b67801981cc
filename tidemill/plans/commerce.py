"""Questions about orders, customers, delivery and sellers.

As asked, averages and percentiles are over items, so that orders weigh by their items, and a
seller's delay rate divides items by orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio, whole_days_between
from ..operators.aggregate import with_total
from ..operators.ordered import ordered, percentiles, tile
from ..sources.scratch import staged

DELIVERED = "delivered"


def money(c, digits: int = 2):
    return F.round(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"), digits)


def _delivered(orders: DataFrame, items: DataFrame, status: str) -> DataFrame:
    return items.join(orders.where(F.col("order_status") == status), "order_id")


def monthly_revenue(orders: DataFrame, items: DataFrame, status: str = DELIVERED, months: int = 24, by_calendar: bool = False) -> DataFrame:
    """Revenue by month with the change against twelve rows before (or, by_calendar, the same month
    a year before), the latest months."""
    by = _delivered(orders, items, status).groupBy("order_year", "order_month", F.to_date(F.date_trunc("month", "order_purchase_timestamp")).alias("month_date"))
    m = by.agg(F.count_distinct("order_id").alias("total_orders"), F.count_distinct("customer_id").alias("unique_customers"), F.sum("total_value").alias("revenue"), F.count("total_value").alias("n_items"))
    if by_calendar:
        before = m.select(F.add_months("month_date", 12).alias("month_date"), F.col("revenue").alias("before"))
        m = m.join(before, "month_date", "left")
    else:  # some rows a year: a window over one partition of months
        m = m.withColumn("before", F.lag("revenue", 12).over(Window.orderBy("order_year", "order_month")))
    change = F.col("revenue") - F.col("before")
    out = m.select(
        "order_year", "order_month", "month_date", "total_orders", "unique_customers", money("revenue").alias("monthly_revenue"), money(F.col("revenue").cast("double") / F.col("n_items")).alias("avg_order_value"),
        money(change).alias("yoy_revenue_change"), F.round(safe_ratio(change.cast("double"), F.col("before").cast("double")) * 100, 2).alias("yoy_growth_pct"),
    )
    return out.orderBy(F.desc("order_year"), F.desc("order_month")).limit(months)


def category_revenue(orders: DataFrame, items: DataFrame, products: DataFrame, status: str = DELIVERED, least_orders: int = 100, n: int = 20) -> DataFrame:
    named = products.where(F.col("product_category_name").isNotNull()).select("product_id", F.col("product_category_name").alias("category"))
    by = _delivered(orders.select("order_id", "order_status"), items, status).join(named, "product_id").groupBy("category")
    c = by.agg(F.count_distinct("order_id").alias("total_orders"), F.sum("price").alias("p"), F.sum("freight_value").alias("f"), F.sum("total_value").alias("t"), F.count(F.lit(1)).alias("n"))
    c = c.where(F.col("total_orders") >= least_orders).withColumn("revenue_percentile", F.percent_rank().over(Window.orderBy(F.desc("t"))))  # a row a category
    d = lambda x: F.col(x).cast("double")
    out = c.orderBy(F.desc("t"), "category").limit(n)
    return out.select(
        "category", "total_orders", money("p").alias("total_product_revenue"), money("f").alias("total_freight_revenue"), money("t").alias("total_revenue"), money(d("p") / d("n")).alias("avg_product_price"),
        money(d("f") / d("n")).alias("avg_freight_cost"), F.round(safe_ratio(d("f"), d("p")) * 100, 2).alias("freight_to_price_ratio"), F.round(safe_ratio(d("t"), F.col("total_orders")), 2).alias("revenue_per_order"),
        F.round("revenue_percentile", 6).alias("revenue_percentile"),
    )


#: Segments in the order in which they are tried.
SEGMENTS = (
    ("r >= 4 and f >= 4 and m >= 4", "Champions"), ("r >= 3 and f >= 3", "Loyal Customers"), ("r >= 4 and f <= 2", "Potential Loyalists"), ("r >= 3 and m >= 3", "Big Spenders"),
    ("r <= 2 and f >= 3", "At Risk"), ("r <= 2 and f <= 2", "Lost Customers"),
)
OTHER_SEGMENT = "Regular Customers"


def customer_metrics(customers: DataFrame, orders: DataFrame, items: DataFrame, as_of, status: str = DELIVERED) -> DataFrame:
    by = _delivered(orders, items, status).join(customers, "customer_id").groupBy("customer_id", "customer_state", "customer_city")
    m = by.agg(F.max("order_purchase_timestamp").alias("last_purchase_date"), F.count_distinct("order_id").alias("frequency"), F.sum("total_value").alias("monetary"), F.count(F.lit(1)).alias("n"))
    return m.withColumn("recency_days", whole_days_between(F.lit(as_of).cast("timestamp"), "last_purchase_date"))


def with_fifths(df: DataFrame, key: str, orders: dict[str, Column]) -> DataFrame:
    """df (a row a key) with each name's fifth, 1 to 5, in the order of its column and then the key.

    All orders are groups of one sequence of keys and order columns, which ordered() deals to range
    partitions; df is written once, and the fifths are joined to it."""
    names, df = list(orders), staged(df)
    which = F.explode(F.array(*[F.lit(i) for i in range(len(names))]))
    at = [F.when(F.col("__which") == i, o).alias(f"__a{i}") for i, o in enumerate(orders.values())]
    long = df.withColumn("__which", which).select(key, "__which", *at)
    placed = ordered(long, [f"__a{i}" for i in range(len(names))], ["__which"], [key])
    tiles = placed.groupBy(key).agg(*[F.max(F.when(F.col("__which") == i, tile(5))).alias(name) for i, name in enumerate(names)])
    return df.join(tiles, key)


def rfm_segments(customers: DataFrame, orders: DataFrame, items: DataFrame, as_of, status: str = DELIVERED, best_is_high: bool = False) -> DataFrame:
    """Segments by fifths of recency, frequency and spending.  By default the first fifth is the most
    recent, frequent and highest, as the question puts it, though labels treat 5 as best;
    best_is_high turns the fifths round."""
    m = customer_metrics(customers, orders, items, as_of, status)
    sign = -1 if best_is_high else 1
    m = with_fifths(m.drop("customer_state", "customer_city", "last_purchase_date"), "customer_id", {"r": sign * F.col("recency_days"), "f": -sign * F.col("frequency"), "m": -sign * F.col("monetary")})
    label = F
    for rule, name in SEGMENTS:
        label = label.when(F.expr(rule), F.lit(name))
    m = m.withColumn("customer_segment", label.otherwise(F.lit(OTHER_SEGMENT)))
    each = F.round(F.col("monetary").cast("double") / F.col("n"), 6).cast("decimal(20,6)")
    g = m.withColumn("each", each).groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("customer_count"), F.sum("recency_days").alias("rd"), F.sum("frequency").alias("fq"), F.sum("monetary").alias("mv"), F.sum("each").alias("ao"))
    g, n = with_total(g, "mv"), F.col("customer_count")
    d = lambda x: F.col(x).cast("double")
    return g.select(
        "customer_segment", "customer_count", F.round(d("rd") / n, 0).alias("avg_recency_days"), F.round(d("fq") / n, 2).alias("avg_frequency"), F.round(d("mv") / n, 2).alias("avg_monetary_value"),
        F.round(d("ao") / n, 2).alias("avg_order_value"), money("mv").alias("total_segment_value"), F.round(d("mv") * 100 / d("total"), 2).alias("pct_of_total_revenue"),
    ).orderBy(F.desc("total_segment_value"))


def delivery_by_state(orders: DataFrame, customers: DataFrame, items: DataFrame, status: str = DELIVERED, least_orders: int = 50, n: int = 30) -> DataFrame:
    o = orders.where(F.col("order_delivered_customer_date").isNotNull() & F.col("delivery_days").isNotNull())
    # A row an order first: an order has one state and one delivery, so only customers are counted distinctly.
    each = _delivered(o, items, status).groupBy("order_id", "customer_id", "delivery_days", "is_delayed").agg(F.sum("total_value").alias("v"), F.count(F.lit(1)).alias("items"))
    each = staged(each.join(customers, "customer_id").select("customer_state", "customer_id", "delivery_days", "is_delayed", "v", "items"))
    s = each.groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("total_orders"), F.count_if("is_delayed").alias("delayed_orders"), (F.sum(F.col("delivery_days") * F.col("items")) / F.sum("items")).alias("a"),
        F.min("delivery_days").alias("min_delivery_days"), F.max("delivery_days").alias("max_delivery_days"), F.sum("v").alias("t"), F.count_distinct("customer_id").alias("unique_customers"),
    ).where(F.col("total_orders") >= least_orders)
    s = s.join(percentiles(each, "delivery_days", {"q50": 0.5, "q95": 0.95}, ["customer_state"], "items"), "customer_state")
    return s.orderBy(F.desc("t"), "customer_state").limit(n).select(
        "customer_state", "total_orders", "delayed_orders", F.round(safe_ratio(F.col("delayed_orders") * 100.0, F.col("total_orders")), 2).alias("delay_rate_pct"), F.round("a", 1).alias("avg_delivery_days"),
        F.round("q50", 1).alias("median_delivery_days"), F.round("q95", 1).alias("p95_delivery_days"), "min_delivery_days", "max_delivery_days", money("t").alias("total_revenue"), "unique_customers",
    )


def seller_ranking(sellers: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame, status: str = DELIVERED, least_orders: int = 10, n: int = 100) -> DataFrame:
    """Sellers by revenue with market share and cumulative share (equal revenues share a value)."""
    by = _delivered(orders, items, status).join(products, "product_id").join(sellers, "seller_id").groupBy("seller_id", "seller_state")
    s = by.agg(
        F.count_distinct("order_id").alias("total_orders"), F.count_distinct("customer_id").alias("unique_customers"), F.sum("total_value").alias("t"), F.sum("price").alias("p"), F.count(F.lit(1)).alias("n"),
        F.count_distinct("product_id").alias("unique_products_sold"), F.count_distinct("product_category_name").alias("category_diversity"), F.avg("delivery_days").alias("a"), F.sum(F.when(F.col("is_delayed"), 1).otherwise(0)).alias("late"),
    ).where(F.col("total_orders") >= least_orders)
    # One pass over the base: rank, running and whole revenue come from the ordered sellers, which are written once.
    s, d = ordered(s, [-F.col("t")], (), ["seller_id"], "t"), lambda x: F.col(x).cast("double")
    return s.where(F.col("__place") <= n).select(
        F.col("__place").alias("seller_rank"), "seller_id", "seller_state", "total_orders", "unique_customers", money("t").alias("total_revenue"), F.round(d("t") * 100 / d("__total"), 4).alias("market_share_pct"),
        F.round(d("__running") * 100 / d("__total"), 2).alias("cumulative_market_share_pct"), money(d("p") / F.col("n")).alias("avg_product_price"), "unique_products_sold", "category_diversity", F.round("a", 1).alias("avg_delivery_days"),
        F.round(safe_ratio(F.col("late") * 100.0, F.col("total_orders")), 2).alias("delay_rate_pct"), money(safe_ratio(d("t"), F.col("total_orders"))).alias("revenue_per_order"), money(safe_ratio(d("t"), F.col("unique_customers"))).alias("revenue_per_customer"),
    ).orderBy("seller_rank")
