"""Deduplication.  Rows have no order of their own: first and last follow order columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col


def _one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row a key in ascending order, nulls first; the last order column should be unique."""
    return _one(df, keys, [col(c).asc_nulls_first() for c in order])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row a key, nulls counting as earliest."""
    return _one(df, keys, [col(c).desc_nulls_last() for c in order])


def distinct_rows(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Each row once.  With `parts` rows are dealt to so many tasks before they are held, so that a task holds its
    share whatever the size of the partitions read: first with the partition they come from, so that the
    copies of one row don't meet in one task, then without."""
    if parts is None:
        return df.dropDuplicates()
    own = df.withColumn("__from", F.spark_partition_id()).repartition(parts, *df.columns, "__from").dropDuplicates()
    return own.select(*df.columns).repartition(parts, *df.columns).dropDuplicates()


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def stacked(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows of all, columns matched by name; missing ones are null."""
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b lacks."""
    return a.select(*b.columns).subtract(b)
