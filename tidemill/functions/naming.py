"""Column naming rules.  Both raise where names collide or vanish."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def renamed(df: DataFrame, names: list[str]) -> DataFrame:
    if any(not n for n in names) or len(set(names)) < len(names):
        bad = sorted({n for n in names if not n or names.count(n) > 1})
        raise ValueError(f"column names collide or are empty: {bad}")
    return df.toDF(*names)


def snake_names(df: DataFrame, snake_case: bool = True) -> DataFrame:
    """Symbols become `_`, runs of blanks and `_` one `_`, none at the ends, lower case; or lower case alone."""
    rule = (lambda n: re.sub(r"[\s_]+", "_", re.sub(r"[^\w\s]", "_", n)).lower().strip("_")) if snake_case else str.lower
    return renamed(df, [rule(c) for c in df.columns])


def plain_names(df: DataFrame) -> DataFrame:
    """Trimmed lower case, blanks and `-` become `_`, other symbols are dropped, no `_` at the ends."""
    rule = lambda n: re.sub(r"[^a-z0-9_]", "", re.sub(r"[ -]", "_", n.strip().lower())).strip("_")
    return renamed(df, [rule(c) for c in df.columns])
