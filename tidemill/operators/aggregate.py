"""Rollups, distributions, profiles and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .ordered import percentiles

FUNCTIONS = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}


def daily_rollup(df: DataFrame, date_col: str, by: Sequence[str], measures: Mapping[str, Sequence[str]]) -> DataFrame:
    """A row a day and group; columns {measure}_{function}.  Unknown functions are ignored."""
    aggs = [FUNCTIONS[f](c).alias(f"{c}_{f}") for c, fs in measures.items() for f in fs if f in FUNCTIONS]
    return df.groupBy(F.to_date(date_col).alias("date"), *by).agg(*aggs)


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Values, a null among them, with their counts, most frequent first."""
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(c))


def mean_by(df: DataFrame, c: str, value: str, name: str = "mean") -> DataFrame:
    """Means by group, highest first; rows without a group are left out."""
    return df.where(F.col(c).isNotNull()).groupBy(c).agg(F.avg(value).alias(name)).orderBy(F.desc(name), c)


def histogram(df: DataFrame, value: str, by: str, bins: int = 30) -> DataFrame:
    """Counts of equal-width bins 1 .. bins over the whole range, stacked by a column."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))  # one row
    place = F.least(F.lit(bins), F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins) + 1)
    binned = df.where(F.col(value).isNotNull()).join(F.broadcast(ends)).withColumn("bin", F.coalesce(place, F.lit(1)).cast("long"))
    return binned.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells."""
    missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), missing.cast("long").alias("missing_cells"))


def sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42, then: Sequence[str] = ()) -> DataFrame:
    """n rows chosen by a hash of their keys (rows with equal keys by `then`): the same for every run and layout."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), *keys)), *keys, *then).limit(n)


def top(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in an order that ends in a unique column."""
    return df.orderBy(*[col(c) for c in order]).limit(n)


def with_total(df: DataFrame, value: str, name: str = "total") -> DataFrame:
    """df with the sum of a column over all rows, as a one-row aggregate joined to it instead of a window over one partition."""
    return df.join(F.broadcast(df.agg(F.sum(value).alias(name))))


#: Accuracy of quantile sketches: ranks are within 1 % at 200 (with a probability of 99 %), 0.3 % at 800.
SKETCH = 800


def quantile_sketches(df: DataFrame, c: str, by: Sequence[str] = (), k: int = SKETCH) -> DataFrame:
    """(*by, sketch): a KLL sketch of a column for each group, of some KB whatever its rows, nulls aside.  To be kept by day, say."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, sketch) of coarser groups, from sketches alone: the rows behind them aren't read again."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, at: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(*by, n, names of at): row counts and approximate quantiles; null where a group has no values."""
    n = F.kll_sketch_get_n_double("sketch")
    q = lambda x: F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(x))))
    return sketches.select(*by, n.alias("n"), *[q(x).alias(name) for name, x in at.items()])


def quantile_cuts(df: DataFrame, c: str, at: Sequence[float] = (0.33, 0.67), exact: bool = False) -> list[float]:
    """Cut points of a column: from a sketch of one pass, or exact."""
    names = {f"q{i}": x for i, x in enumerate(at)}
    found = (percentiles(df, c, names) if exact else sketch_quantiles(quantile_sketches(df, c), names)).first()
    return [found[n] if found else None for n in names]
