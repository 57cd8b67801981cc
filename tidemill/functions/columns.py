"""Column functions: bands, parts, keys, parsing.  All are built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Upper ends (exclusive) and labels of the age bands; others are in the last band.
AGE_BANDS = ((18, "<18"), (30, "18-29"), (40, "30-39"), (50, "40-49"), (60, "50-59"), (70, "60-69"))
LAST_AGE_BAND = "70+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def banded(value: str | Column, ends: Sequence[tuple[object, str]], last: str, null_label: str | None = None) -> Column:
    """The label of the first band whose end is above value, else `last`.  A null is in the last
    band, unless null_label names another."""
    value = col(value)
    out = F.when(value.isNull(), F.lit(null_label)) if null_label is not None else F
    for end, label in ends:
        out = out.when(value < end, F.lit(label))
    return out.otherwise(F.lit(last))


def age_band(age: str | Column, null_label: str | None = None) -> Column:
    return banded(age, AGE_BANDS, LAST_AGE_BAND, null_label)


def price_tier(price: str | Column, low: float, high: float, null_label: str | None = None) -> Column:
    """Low up to and including `low`, Medium up to and including `high`, else High."""
    price = col(price)
    out = F.when(price.isNull(), F.lit(null_label)) if null_label is not None else F
    return out.when(price <= low, F.lit("Low")).when(price <= high, F.lit("Medium")).otherwise(F.lit("High"))


def volume(length: str | Column, height: str | Column, width: str | Column) -> Column:
    return col(length) * col(height) * col(width)


def size_band(v: str | Column, null_label: str | None = None) -> Column:
    return banded(v, ((1000, "Small"), (10000, "Medium")), "Large", null_label)


def standard_address(c: str | Column) -> Column:
    return F.trim(F.upper(col(c)))


def standard_code(c: str | Column) -> Column:
    return F.lower(F.trim(col(c)))


def email_domain(c: str | Column) -> Column:
    """All after the first @; an empty string where there is none."""
    return F.regexp_extract(col(c), "@(.+)$", 1)


def surrogate_key(*keys: str | Column, null_token: str | None = None) -> Column:
    """MD5 of the keys joined by `_`.  Nulls are skipped, so (a, null, b) meets (a, b); a
    null_token stands for them instead."""
    parts = [col(k).cast("string") for k in keys]
    if null_token is not None:
        parts = [F.coalesce(p, F.lit(null_token)) for p in parts]
    return F.md5(F.concat_ws("_", *parts))


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """Calendar days."""
    return F.datediff(col(later), col(earlier))


def whole_days_between(later: str | Column, earlier: str | Column) -> Column:
    """Elapsed units of 24 hours."""
    return F.expr("1").cast("long") * F.floor((F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))) / 86_400_000_000)


def is_late(actual: str | Column, due: str | Column) -> Column:
    """Whether actual is after due; false where either is missing."""
    return F.coalesce(col(actual) > col(due), F.lit(False))


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is zero."""
    return col(a) / F.nullif(col(b), F.lit(0))


def is_blank(c: str | Column) -> Column:
    """Null, white space alone, or the text nan."""
    c = col(c)
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin("", "nan")


def date_parts(c: str, parts: Sequence[str] = ("year", "month", "day", "quarter")) -> dict[str, Column]:
    """{column}_{part} columns of a date-like column."""
    t = F.col(c).cast("timestamp")
    known = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "quarter": F.quarter(t)}
    return {f"{c}_{p}": known[p] for p in parts}


#: Formats tried in order, after the weekday and a trailing zone name are cut (fixed values).
DATE_FORMATS = ("MMM dd yyyy HH:mm:ss 'GMT'Z", "MMM dd yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy", "MMM dd, yyyy")


def messy_timestamp(c: str | Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """A timestamp from text in any of the formats, such as `Tue Dec 16 2014 12:30:00 GMT-0800 (PST)`; else null."""
    t = F.trim(F.regexp_replace(col(c), r"\s*\([^)]*\)\s*$", ""))
    t = F.regexp_replace(t, r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+", "")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats])


def json_column(c: str | Column, schema: DataType | str | None = None) -> Column:
    """A struct of the schema, or map<string,string>."""
    return F.from_json(col(c), schema or "map<string,string>")


def replaced(c: str | Column, values: Mapping[str, str], other: str | None = None) -> Column:
    """Codes to descriptions by a small map."""
    c, out = col(c), F
    for k, v in values.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(other) if other is not None else c)
