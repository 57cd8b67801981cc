"""Cleaning and conforming raw tables."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from ..functions.columns import date_parts, json_column, standard_address
from ..functions.naming import plain_names

TYPES = ("string", "integer", "long", "double", "float", "boolean", "date", "timestamp")


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast in one projection; what can't be read becomes null.  Unknown columns and types warn and stay."""
    for c, t in types.items():
        if c not in df.columns or t not in TYPES:
            warnings.warn(f"column {c} isn't cast to {t}", stacklevel=2)
    known = {c: t for c, t in types.items() if c in df.columns and t in TYPES}
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in known.items()})


def lost_in_cast(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """One row: for each column the values that a cast would lose."""
    return df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in types.items()])


def numeric_where_whole(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, int]:
    """Text columns all of whose values are numbers become double; the number of such columns.

    One aggregate decides for all columns.  Columns without any value stay as they are.
    """
    text = [c for c in columns or df.columns if isinstance(df.schema[c].dataType, StringType)]
    if not text:
        return df, 0
    tests = [F.struct(F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias("bad"), F.count(c).alias("n")).alias(f"_{i}") for i, c in enumerate(text)]
    found = df.agg(*tests).first()
    good = [c for i, c in enumerate(text) if found[i]["bad"] == 0 and found[i]["n"] > 0]
    return df.withColumns({c: F.col(c).try_cast("double") for c in good}), len(good)


def _fits(value: object, df: DataFrame, c: str) -> bool:
    t = df.schema[c].dataType
    if isinstance(value, bool):
        return isinstance(t, BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(t, NumericType)
    return isinstance(value, str) and isinstance(t, StringType)


def handle_nulls(df: DataFrame, rules: Mapping[str, object]) -> DataFrame:
    """Per column: `drop` leaves out rows without a value, any other value fills.  Fills of the
    wrong type and unknown columns warn and do nothing."""
    keep, fills = F.lit(True), {}
    for c, rule in rules.items():
        if c not in df.columns:
            warnings.warn(f"no column {c}", stacklevel=2)
        elif rule == "drop":
            keep = keep & F.col(c).isNotNull()
        elif _fits(rule, df, c):
            fills[c] = rule
        else:
            warnings.warn(f"{rule!r} can't fill {c}", stacklevel=2)
    out = df.where(keep)
    return out.fillna(fills) if fills else out


def handle_missing(df: DataFrame, rule: str) -> DataFrame:
    """drop_all: rows without any value; drop_any: rows that lack one; fill_mean: numeric columns by
    their means (one aggregate).  Other rules do nothing."""
    if rule == "drop_all":
        return df.dropna("all")
    if rule == "drop_any":
        return df.dropna("any")
    if rule == "fill_mean":
        numeric = [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
        if not numeric:
            return df
        means = df.agg(*[F.avg(c).alias(f"__mean_{c}") for c in numeric])  # one row, so the join is no product
        filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"__mean_{c}")) for c in numeric}
        return df.join(F.broadcast(means)).withColumns(filled).select(*df.columns)
    return df


def standardize_addresses(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: standard_address(c) for c in columns if c in df.columns})


def add_date_parts(df: DataFrame, c: str, parts: Sequence[str] = ("year", "month", "day", "quarter")) -> DataFrame:
    if c not in df.columns:
        raise ValueError(f"no column {c}")
    return df.withColumns(date_parts(c, parts))


def add_audit(df: DataFrame, run_ts) -> DataFrame:
    """Insert and update time and a batch id, all from the run's one timestamp."""
    ts = F.lit(run_ts).cast("timestamp")
    return df.withColumns({"etl_inserted_at": ts, "etl_updated_at": ts, "etl_batch_id": F.date_format(ts, "yyyyMMddHHmmss")})


def parse_json(df: DataFrame, c: str, schema=None, flatten: bool = False) -> DataFrame:
    """c parsed in place, and as parsed_json; flatten gives the struct's fields, or a row a map entry."""
    out = df.withColumn(c, json_column(c, schema))
    if not flatten:
        return out.withColumn("parsed_json", F.col(c))
    rest = [x for x in df.columns if x != c]
    return out.select(*rest, f"{c}.*") if schema else out.select(*rest, F.explode_outer(c))


@dataclass
class CleanStats:
    """Counts of a clean() run, known once an action has run over its result."""

    before: Observation
    after: Observation
    converted: int = 0

    def counts(self) -> dict[str, int]:
        a, b = self.before.get["rows"], self.after.get["rows"]
        return {"rows_before": a, "rows_after": b, "rows_removed": a - b, "columns_converted": self.converted}


def clean(df: DataFrame, names: bool = True, dedupe: bool = True, missing: str | None = "drop_all", convert: bool = True) -> tuple[DataFrame, CleanStats]:
    """Names, missing values, duplicates, types: each step can be left out.  Means are filled before
    types are converted, so text that looks numeric isn't filled."""
    stats = CleanStats(Observation(), Observation())
    out = df.observe(stats.before, F.count(F.lit(1)).alias("rows"))
    if names:
        out = plain_names(out)
    if missing:
        out = handle_missing(out, missing)
    if dedupe:
        out = out.dropDuplicates()
    if convert:
        whole = plain_names(df) if names else df  # decide on the input, without the observed steps
        _, stats.converted = numeric_where_whole(handle_missing(whole, missing) if missing else whole)
        if stats.converted:
            out, _ = numeric_where_whole(out)
    return out.observe(stats.after, F.count(F.lit(1)).alias("rows")), stats


def transformed(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The caller's own steps, in order."""
    for f in steps:
        df = df.transform(f)
    return df


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)
