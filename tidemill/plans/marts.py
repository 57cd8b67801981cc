"""Derived marts.  Only their columns are given elsewhere; the formulas are stated here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import age_band, replaced, surrogate_key


def dim_dates(spark: SparkSession, first: str, last: str, holidays: Sequence[str] = (), trading: DataFrame | None = None) -> DataFrame:
    """A row a date: ISO week and weekday (Monday 1), weekend, holiday by list, trading day by the dates of a table of prices(day)."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    d = d.select(
        "date", F.date_format("date", "yyyyMMdd").cast("long").alias("date_key"), F.year("date").cast("long").alias("year"), F.quarter("date").cast("long").alias("quarter"), F.month("date").cast("long").alias("month"),
        F.dayofmonth("date").cast("long").alias("day"), F.weekofyear("date").cast("long").alias("iso_week"), (F.weekday("date") + 1).cast("long").alias("iso_weekday"), (F.weekday("date") >= 5).alias("is_weekend"),
        F.col("date").cast("string").isin(list(holidays)).alias("is_holiday"), (F.floor(F.year("date") / 10) * 10).cast("long").alias("decade"), F.ceil(F.year("date") / 100).cast("long").alias("century"),
    )
    if trading is None:
        return d
    days = trading.select(F.col("day").alias("date")).distinct().withColumn("is_trading_day", F.lit(True))
    return d.join(days, "date", "left").fillna(False, ["is_trading_day"])


def daily_prices(prices: DataFrame, rows: int = 20) -> DataFrame:
    """Change against the row before, volatility as the sample deviation of the last `rows` returns."""
    by = Window.partitionBy("stock").orderBy("day")
    p = prices.withColumns({"before": F.lag("price").over(by), "volume_before": F.lag("volume").over(by)})
    d = lambda c: F.col(c).cast("double")
    p = p.withColumn("r", (d("price") - d("before")) / F.nullif(d("before"), F.lit(0.0)))
    n = F.count("r").over(by.rowsBetween(1 - rows, 0))
    vol = F.when(n >= 2, F.stddev_samp("r").over(by.rowsBetween(1 - rows, 0)))
    return p.select(
        "stock", "day", d("price").alias("price"), F.round(d("price") - d("before"), 2).alias("change"), F.round(F.col("r") * 100, 2).alias("change_pct"),
        F.round((d("volume") - d("volume_before")) / F.nullif(d("volume_before"), F.lit(0.0)) * 100, 2).alias("volume_change_pct"), F.round(vol, 3).alias("volatility"), (F.col("price") > F.col("before")).alias("is_up_day"),
    )


def monthly_prices(prices: DataFrame) -> DataFrame:
    """Open, high, low, close, volume a month, and days on which the price rose or fell."""
    by = Window.partitionBy("stock").orderBy("day")
    p = prices.withColumn("before", F.lag("price").over(by))
    g = p.groupBy("stock", F.to_date(F.date_trunc("month", "day")).alias("month"))
    return g.agg(
        F.min_by("price", "day").cast("double").alias("open"), F.max("price").cast("double").alias("high"), F.min("price").cast("double").alias("low"), F.max_by("price", "day").cast("double").alias("close"),
        F.sum("volume").cast("double").alias("volume"), F.count_if(F.col("price") > F.col("before")).alias("up_days"), F.count_if(F.col("price") < F.col("before")).alias("down_days"),
    )


def temperatures(t: DataFrame) -> DataFrame:
    """Fahrenheit, anomaly against the location's mean of the calendar month, records against all earlier rows."""
    month = Window.partitionBy("location", F.month("day"))
    before = Window.partitionBy("location").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    c = F.col("celsius").cast("double")
    mean = F.sum("celsius").over(month).cast("double") / F.count(F.lit(1)).over(month)
    return t.select(
        "location", "day", c.alias("celsius"), F.round(c * 9 / 5 + 32, 2).alias("fahrenheit"), F.round(c - mean, 6).alias("anomaly"), (c > mean).alias("above_average"),
        F.coalesce(F.col("celsius") > F.max("celsius").over(before), F.lit(False)).alias("record_high"), F.coalesce(F.col("celsius") < F.min("celsius").over(before), F.lit(False)).alias("record_low"),
    )


def yearly_temperatures(t: DataFrame) -> DataFrame:
    """Range, variance, warmest and coldest month by mean, trend over months, completeness of months in percent."""
    m = t.groupBy("location", F.year("day").cast("long").alias("year"), F.month("day").cast("long").alias("month")).agg((F.sum("celsius").cast("double") / F.count(F.lit(1))).alias("mean"), F.min("celsius").alias("lo"), F.max("celsius").alias("hi"))
    m = m.withColumn("mean", F.round("mean", 4))
    g = m.groupBy("location", "year")
    return g.agg(
        F.round(F.avg("mean"), 2).alias("mean_celsius"), (F.max("hi") - F.min("lo")).cast("double").alias("range_celsius"), F.round(F.var_samp("mean"), 2).alias("variance"),
        F.max_by("month", F.struct("mean", "month")).alias("warmest_month"), F.min_by("month", F.struct("mean", "month")).alias("coldest_month"), F.round(F.regr_slope("mean", "month"), 2).alias("trend"),
        F.round(F.count(F.lit(1)) * 100 / 12, 2).alias("completeness_pct"),
    )


def global_temperatures(t: DataFrame) -> DataFrame:
    """A row a day: means of the world, the hemispheres (the equator is north) and the tropics (to 23.5 degrees)."""
    mean = lambda cond: F.round(F.sum(F.when(cond, F.col("celsius"))).cast("double") / F.nullif(F.count_if(cond), F.lit(0)), 6)
    lat = F.col("latitude")
    g = t.groupBy("day").agg(mean(F.lit(True)).alias("global_mean"), mean(lat >= 0).alias("north_mean"), mean(lat < 0).alias("south_mean"), mean(F.abs(lat) <= 23.5).alias("tropics_mean"))
    return g.withColumns({"decade": (F.floor(F.year("day") / 10) * 10).cast("long"), "century": F.ceil(F.year("day") / 100).cast("long")})


def match_results(m: DataFrame) -> DataFrame:
    h, a = F.col("home_goals"), F.col("away_goals")
    return m.select("match_id", "league", "season", "home", "away", (h + a).alias("total_goals"), (h - a).alias("goal_difference"), (h > a).alias("home_win"), (h < a).alias("away_win"), (h == a).alias("draw"))


def standings(m: DataFrame) -> DataFrame:
    """Season tables: wins, draws, losses, goals, points 3 / 1 / 0, clean sheets."""
    side = lambda team, own, other: m.select("league", "season", F.col(team).alias("team"), F.col(own).alias("own"), F.col(other).alias("other"))
    all_ = side("home", "home_goals", "away_goals").unionByName(side("away", "away_goals", "home_goals"))
    w, d, lost = F.count_if(F.col("own") > F.col("other")), F.count_if(F.col("own") == F.col("other")), F.count_if(F.col("own") < F.col("other"))
    return all_.groupBy("league", "season", "team").agg(
        F.count(F.lit(1)).alias("played"), w.alias("wins"), d.alias("draws"), lost.alias("losses"), F.sum("own").alias("goals_for"), F.sum("other").alias("goals_against"),
        (F.sum("own") - F.sum("other")).alias("goal_difference"), (3 * w + d).alias("points"), F.count_if(F.col("other") == 0).alias("clean_sheets"),
    )


#: Codes with descriptions, and those of chronic diseases.
CODES = {"E11": "Type 2 diabetes", "I10": "Hypertension", "J45": "Asthma", "Z00": "Examination"}
CHRONIC = ("E11", "I10", "J45")


def patients(p: DataFrame, codes: Mapping[str, str] = CODES, chronic: Sequence[str] = CHRONIC, cuts: tuple[int, int] = (40, 65)) -> DataFrame:
    """Age band, code description, disease flag, and risk by age cut points for the chronically ill."""
    ill = F.col("code").isin(list(chronic))
    risk = F.when(ill & (F.col("age") >= cuts[1]), "High").when(ill | (F.col("age") >= cuts[1]), "Medium").when(F.col("age") >= cuts[0], "Moderate").otherwise("Low")
    return p.select("patient_id", "age", age_band("age").alias("age_group"), "code", replaced("code", codes, "unknown").alias("description"), ill.alias("has_chronic_disease"), risk.alias("risk_level"))


def attribute_dim(df: DataFrame, columns: Sequence[str], key: str, run_ts=None) -> DataFrame:
    """A dimension of the distinct values of some columns, with a key and audit columns."""
    from ..operators.conform import add_audit

    d = df.select(*columns).distinct().withColumn(key, surrogate_key(*columns, null_token="~"))
    return d if run_ts is None else add_audit(d, run_ts)
