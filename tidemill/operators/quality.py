"""Data quality: checks fused into as few passes as they need, contracts, and row-level splits.

Results are rows (check, passed, value, limit, detail); checks never stop a job by themselves.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_blank

RESULT = "check string, passed boolean, value double, bound double, detail string"


class QualityError(ValueError):
    """A gate or contract that didn't hold."""


@dataclass
class Checks:
    """Checks of one table.  Those that are plain aggregates run as one."""

    df: DataFrame
    measures: list[tuple[str, Column, object]] = field(default_factory=list)
    tables: list[DataFrame] = field(default_factory=list)

    def _add(self, name: str, value: Column, test, bound: float | None, detail: Column | str = "") -> Checks:
        i = len(self.measures)
        v = F.col(f"v{i}")
        passed = F.coalesce(test(v), F.lit(False))
        d = detail if isinstance(detail, Column) else F.lit(detail)
        row = F.struct(F.lit(name).alias("check"), passed.alias("passed"), v.alias("value"), F.lit(bound).cast("double").alias("bound"), d.alias("detail"))
        self.measures.append((f"v{i}", value.cast("double"), row))
        return self

    def row_count(self, least: int | None = None, most: int | None = None) -> Checks:
        test = lambda v: (v >= (least or 0)) & (F.lit(True) if most is None else v <= most)
        return self._add("row_count", F.count(F.lit(1)), test, least if least is not None else most)

    def null_share(self, c: str, most: float = 0.1) -> Checks:
        """Share of nulls; 0 without rows."""
        return self._add(f"null_share:{c}", F.coalesce(F.avg(F.col(c).isNull().cast("int")), F.lit(0.0)), lambda v: v <= most, most)

    def value_range(self, c: str, low: float | None = None, high: float | None = None) -> Checks:
        """Values outside low .. high; fails, with a reason, where the column has no value at all."""
        x = F.col(c)
        outside = F.count_if((x < low if low is not None else F.lit(False)) | (x > high if high is not None else F.lit(False)))
        value = F.when(F.count(x) > 0, outside)
        return self._add(f"value_range:{c}", value, lambda v: v == 0, 0, F.when(F.col(f"v{len(self.measures)}").isNull(), "no values").otherwise(""))

    def freshness(self, c: str, as_of, most_days: int) -> Checks:
        """Age in days of the latest value."""
        return self._add(f"freshness:{c}", F.datediff(F.lit(as_of).cast("timestamp"), F.max(F.col(c).cast("timestamp"))), lambda v: v <= most_days, most_days)

    def completeness(self, least: float = 0.0) -> Checks:
        """Share of cells with a value."""
        cells = sum((F.count(F.col(c)) for c in self.df.columns), F.lit(0))
        return self._add("completeness", F.coalesce(cells / F.nullif(F.count(F.lit(1)) * len(self.df.columns), F.lit(0)), F.lit(1.0)), lambda v: v >= least, least)

    def duplicates(self, keys: Sequence[str], most: float = 0.01) -> Checks:
        """Share of rows beyond the first of their key."""
        by = self.df.groupBy(*keys).count().agg(F.coalesce((F.sum("count") - F.count(F.lit(1))) / F.nullif(F.sum("count"), F.lit(0)), F.lit(0.0)).alias("value"))
        return self._table(f"duplicates:{','.join(keys)}", by, F.col("value") <= most, most)

    def references(self, c: str, parent: DataFrame, parent_key: str) -> Checks:
        """Rows whose key the parent lacks; a null key is one."""
        n = orphans(self.df, c, parent, parent_key).agg(F.count(F.lit(1)).alias("value"))
        return self._table(f"references:{c}", n, F.col("value") == 0, 0)

    def schema(self, expected: Sequence[str], strict: bool = False) -> Checks:
        missing, extra = sorted(set(expected) - set(self.df.columns)), sorted(set(self.df.columns) - set(expected))
        bad = missing + (extra if strict else [])
        one = self.df.sparkSession.range(1).select(F.lit(float(len(bad))).alias("value"))
        return self._table("schema", one, F.col("value") == 0, 0, f"missing {missing}, extra {extra}" if bad else "")

    def _table(self, name: str, one_row: DataFrame, passed: Column, bound: float, detail: str = "") -> Checks:
        self.tables.append(one_row.select(F.lit(name).alias("check"), passed.alias("passed"), F.col("value").cast("double").alias("value"), F.lit(bound).cast("double").alias("bound"), F.lit(detail).alias("detail")))
        return self

    def results(self) -> DataFrame:
        parts = list(self.tables)
        if self.measures:
            one = self.df.agg(*[v.alias(n) for n, v, _ in self.measures])
            parts.insert(0, one.select(F.explode(F.array(*[r for _, _, r in self.measures])).alias("r")).select("r.*"))
        if not parts:
            return self.df.sparkSession.createDataFrame([], RESULT)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def orphans(child: DataFrame, c: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose key isn't among the parent's; null keys are orphans."""
    keys = parent.select(F.col(parent_key).alias(f"__{parent_key}")).distinct()
    return child.join(keys, child[c] == F.col(f"__{parent_key}"), "left_anti")


def summary(results: DataFrame) -> DataFrame:
    """One row: total, passed, failed, success rate, all_passed."""
    good = F.count_if("passed")
    n = F.count(F.lit(1))
    return results.agg(n.alias("total"), good.alias("passed"), (n - good).alias("failed"), F.coalesce(good * 100.0 / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("success_rate"), (n == good).alias("all_passed"))


def run_checks(df: DataFrame, config: Mapping[str, object]) -> DataFrame:
    """Checks by a configuration: row_count {min, max}, null_checks {column: share}, expected_columns [..], unique_keys [..]."""
    checks = Checks(df)
    if rows := config.get("row_count"):
        checks.row_count(rows.get("min"), rows.get("max"))
    for c, most in (config.get("null_checks") or {}).items():
        checks.null_share(c, most)
    if names := config.get("expected_columns"):
        checks.schema(names)
    if keys := config.get("unique_keys"):
        checks.duplicates(keys)
    return checks.results()


def gate(results: DataFrame) -> None:
    """Raise if any check failed; the message has the number of all and names the first 20."""
    failed = results.where("not passed")
    bad = [r.asDict() for r in failed.limit(20).collect()]
    if bad:
        raise QualityError(f"{failed.count()} failed checks: {bad}")


@dataclass(frozen=True)
class Contract:
    """A declarative contract; rules come from a dict or JSON."""

    required_columns: tuple[str, ...] = ()
    unique_columns: tuple[str, ...] = ()
    min_rows: int = 1
    max_null_ratio: float = 1.0
    allowed_values: Mapping[str, Sequence[str]] = field(default_factory=dict)
    allow_extra_columns: bool = True
    version: str = "1"

    @classmethod
    def from_json(cls, text: str) -> Contract:
        raw = json.loads(text)
        for k in ("required_columns", "unique_columns"):
            if k in raw:
                raw[k] = column_list(raw[k])
        return cls(**{k: v for k, v in raw.items() if k in cls.__dataclass_fields__})


def column_list(names: str | Sequence[str] | None) -> tuple[str, ...]:
    """Columns from a list or from text with commas."""
    parts = names.split(",") if isinstance(names, str) else list(names or ())
    return tuple(p.strip() for p in parts if p.strip())


def contract_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """All violations (rule, column, found, detail): one aggregate, and one grouping a unique or listed column."""
    spark = df.sparkSession
    missing = [c for c in contract.required_columns if c not in df.columns]
    extra = [] if contract.allow_extra_columns else [c for c in df.columns if c not in contract.required_columns]
    rows = [("required_columns", c, 1.0, "missing") for c in missing] + [("extra_columns", c, 1.0, "not in the contract") for c in extra]
    out = spark.createDataFrame(rows, "rule string, column string, found double, detail string")
    row = lambda rule, c, value, detail: F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column"), value.cast("double").alias("found"), F.lit(detail).alias("detail"))
    n = F.count(F.lit(1))
    tests = [F.when(n < max(1, contract.min_rows), row("min_rows", "", n, f"fewer than {max(1, contract.min_rows)}"))]
    for c in df.columns:
        share = F.coalesce(F.avg(F.col(c).isNull().cast("int")), F.lit(0.0))
        tests.append(F.when(share > contract.max_null_ratio, row("max_null_ratio", c, share, f"above {contract.max_null_ratio}")))
        blank = is_blank(c) if c in contract.required_columns else F.col(c).isNull()
        if c in contract.required_columns or not contract.required_columns:
            tests.append(F.when((n > 0) & (F.count_if(~blank) == 0), row("no_values", c, n, "missing, blank or nan throughout")))
    found = df.agg(F.array_compact(F.array(*tests)).alias("v")).select(F.explode("v").alias("v")).select("v.*")
    out = out.unionByName(found)
    for c, values in contract.allowed_values.items():
        if c in df.columns:
            text = F.col(c).cast("string")
            by = df.where(F.col(c).isNotNull() & ~text.isin([str(v) for v in values])).groupBy(text.alias("value")).agg(n.alias("n"))
            # The count is over all values; the detail names the first ten of them.
            named = by.select("value").orderBy("value").limit(10).select(F.lit(0).cast("long").alias("n"), "value")
            one = by.select("n", F.lit(None).cast("string").alias("value")).unionByName(named).agg(F.sum("n").cast("double").alias("found"), F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("detail"))
            out = out.unionByName(one.where("found > 0").select(F.lit("allowed_values").alias("rule"), F.lit(c).alias("column"), "found", "detail"))
    for c in contract.unique_columns:
        if c in df.columns:  # repeated nulls count
            again = df.groupBy(c).count().where("count > 1").agg(F.sum(F.col("count") - 1).alias("found")).where("found > 0")
            out = out.unionByName(again.select(F.lit("unique_columns").alias("rule"), F.lit(c).alias("column"), F.col("found").cast("double").alias("found"), F.lit("repeated").alias("detail")))
    return out


def enforce(df: DataFrame, contract: Contract) -> DataFrame:
    """df, or an error with the number of violations and the first 50 of them."""
    found = contract_violations(df, contract)
    bad = found.limit(50).collect()
    if bad:
        raise QualityError(f"{len(bad) if len(bad) < 50 else found.count()} violations: " + "; ".join(f"{r['rule']} {r['column']}: {r['found']:g} ({r['detail']})" for r in bad))
    return df


def split_rows(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy all rules, the others with the names of the broken ones in `reasons`)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))
    marked = df.withColumn("reasons", broken)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def failing_not_null(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNull())


def failing_unique(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")


def failing_accepted(df: DataFrame, c: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(F.col(c).alias("value_field")).agg(F.count(F.lit(1)).alias("n_records")).where(F.col("value_field").isNotNull() & ~F.col("value_field").isin(list(values)))
