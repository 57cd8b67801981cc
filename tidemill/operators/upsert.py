"""Idempotent upserts and merges as joins.

Plain Parquet takes no MERGE: the result is a new DataFrame, to be written to a new place (or,
by partition, with replace_partitions) and swapped in, as sources/snapshots.py does it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedupe import keep_last


def _checked(target: DataFrame, rows: DataFrame, keys: Sequence[str], updates: Sequence[str] | None) -> list[str]:
    if not keys:
        raise ValueError("an upsert needs key columns")
    unknown = [c for c in rows.columns if c not in target.columns]
    if unknown:
        raise ValueError(f"the target has no columns {unknown}")
    missing = [c for c in keys if c not in rows.columns]
    if missing:
        raise ValueError(f"the input has no key columns {missing}")
    updates = [c for c in rows.columns if c not in keys] if updates is None else list(updates)
    if set(updates) & set(keys):
        raise ValueError("key columns can't be updated")
    if any(c not in rows.columns for c in updates):
        raise ValueError("columns to update are missing from the input")
    return updates


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | None = None, updates: Sequence[str] | None = None, require_keys: bool = True, newest: Sequence[str] = ()) -> DataFrame:
    """target with rows merged in by keys.

    Of rows with equal keys the last by `order` counts (without an order they must be unique).
    Matched keys take the update columns (all others by default; with [] they stay), columns that
    the input lacks keep the target's values, new keys come in with nulls there.  Null keys are
    an error, raised when the result is computed.  With `newest`, columns of both, a stored row that
    isn't before the new one by them (nulls first) stays as it is.
    """
    new = keep_last(rows, keys, order) if order else rows
    # Columns that only order the input aren't the target's.
    new = new.drop(*[c for c in order or () if isinstance(c, str) and c not in target.columns])
    updates, own = _checked(target, new, keys, updates), new.columns
    if require_keys:
        null = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
        new = new.where(F.when(null, F.raise_error(F.lit("null in a key column")).cast("boolean")).otherwise(True))
    n = new.select(*[F.col(c).alias(f"__n_{c}") for c in own], F.lit(True).alias("__new"))
    t = target.withColumn("__old", F.lit(True))
    joined = t.join(n, [F.col(k) == F.col(f"__n_{k}") for k in keys], "full_outer")
    takes = F.col("__new")
    if newest:
        takes = takes & (F.col("__old").isNull() | (F.struct(*[F.col(f"__n_{c}").alias(c) for c in newest]) > F.struct(*newest)))
    out = []
    for c in target.columns:
        if c in keys:
            value = F.coalesce(F.col(c), F.col(f"__n_{c}"))
        elif c in updates:
            value = F.when(takes, F.col(f"__n_{c}")).otherwise(F.col(c))
        elif c in own:
            value = F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__n_{c}"))
        else:
            value = F.col(c)
        out.append(value.cast(target.schema[c].dataType).alias(c))
    return joined.select(*out)


def upsert_from_staging(target: DataFrame, staging: DataFrame, keys: Sequence[str], updates: Sequence[str] | None = None) -> DataFrame:
    """As upsert, from a table whose keys are unique already."""
    return upsert(target, staging, keys, None, updates, require_keys=False)


def delete_insert(target: DataFrame, staging: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target without the keys of staging, and all rows of staging."""
    return target.join(staging.select(*keys).distinct(), list(keys), "left_anti").select(*target.columns).unionByName(staging.select(*target.columns))


def touched_partitions(target: DataFrame, rows: DataFrame, partition: Sequence[str]) -> DataFrame:
    """The rows of target in partitions that rows falls into: all that an upsert within partitions must rewrite."""
    return target.join(rows.select(*partition).distinct(), list(partition), "left_semi")
