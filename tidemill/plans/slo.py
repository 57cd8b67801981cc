"""Service-level rules over run events, as windowed aggregates that hold in batch and in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ordered, percentiles


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, by: tuple[str, ...] = (), ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """Counts a window (and key): (window_start, window_end, *by, n)."""
    df = events.withWatermark(ts, watermark) if watermark else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def failure_ratio(runs: DataFrame, size: str, objective: float = 0.995, ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """Failed share a window, and how fast it burns the error budget; the denominator is 1 at least."""
    df = runs.withWatermark(ts, watermark) if watermark else runs
    g = df.groupBy(F.window(ts, size).alias("w")).agg(F.sum((F.col("status") == "failed").cast("long")).alias("failed"), F.count(F.lit(1)).alias("runs"))
    ratio = F.col("failed") / F.greatest("runs", F.lit(1))
    return g.select(F.col("w.start").alias("window_start"), "failed", "runs", F.round(ratio, 6).alias("failure_ratio"), F.round(ratio / (1 - objective), 4).alias("budget_burn"))


def latency(runs: DataFrame, size: str, p95: float = 300.0, p99: float = 600.0, duration: str = "duration", ts: str = "ts") -> DataFrame:
    """Exact 95th and 99th percentiles of durations a window, against their limits; a window without durations has none."""
    timed = runs.select(F.window(ts, size)["start"].alias("window_start"), F.col(duration).alias("duration"))
    q = percentiles(timed, "duration", {"q95": 0.95, "q99": 0.99}, ["window_start"])
    return q.select("window_start", F.round("q95", 4).alias("p95"), F.round("q99", 4).alias("p99"), (F.col("q95") > p95).alias("p95_breached"), (F.col("q99") > p99).alias("p99_breached"))


def freshness(runs: DataFrame, as_of: str, most_seconds: int = 3600, key: str = "source", ts: str = "ts") -> DataFrame:
    """Seconds since the last success of each source."""
    lag = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", F.max(F.when(F.col("status") == "succeeded", F.col(ts)))))
    return runs.groupBy(key).agg(lag.alias("lag_seconds")).withColumn("stale", F.coalesce(F.col("lag_seconds") > most_seconds, F.lit(True)))


def drift(actual: DataFrame, expected: DataFrame, key: str, most: float = 0.2) -> DataFrame:
    """Counts that moved by more than a share: abs(actual - expected) / max(expected, 1)."""
    a, e = actual.groupBy(key).agg(F.count(F.lit(1)).alias("actual")), expected.groupBy(key).agg(F.count(F.lit(1)).alias("expected"))
    j = a.join(e, key, "full_outer").fillna(0, ["actual", "expected"])
    d = F.abs(F.col("actual") - F.col("expected")) / F.greatest("expected", F.lit(1))
    return j.withColumn("drift", F.round(d, 6)).withColumn("breached", d > most)


def dead_letters(quarantine: DataFrame, key: str = "dataset") -> DataFrame:
    """Pending entries a dataset."""
    return quarantine.groupBy(key).agg(F.count_if(F.col("status") == "pending").alias("depth")).withColumn("breached", F.col("depth") > 0)


def sustained(windows: DataFrame, breached: Column, size_seconds: int, least_seconds: int, by: tuple[str, ...] = (), start: str = "window_start") -> DataFrame:
    """Runs of adjoining breached windows that last long enough: (first_start, last_start, windows)."""
    hit = windows.where(breached).withColumn("__s", F.unix_timestamp(start))
    # Windows of one run keep their distance to their place.
    hit = ordered(hit, ["__s"], by).withColumn("__g", F.col("__s") - size_seconds * F.col("__place"))
    g = hit.groupBy(*by, "__g").agg(F.min(start).alias("first_start"), F.max(start).alias("last_start"), F.count(F.lit(1)).alias("windows"))
    return g.where(F.col("windows") * size_seconds >= least_seconds).drop("__g")


def sustained_stream(runs: DataFrame, size: str, size_seconds: int, failures: int, least_seconds: int, delay: str, by: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """sustained() for a stream: windows of failures under a watermark, and breached ones that adjoin as sessions.

    A run of windows is appended when the watermark has passed its end by a window."""
    counted = runs.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), *by).agg(F.count_if(F.col("status") == "failed").alias("failed"))
    hit = counted.where(F.col("failed") >= failures).select("w", *by, F.window_time("w").alias("at"))
    # A session goes on while the next window begins before its end: a second more than a window.  Streams
    # want a key beside a session; without one it is 0 for all windows.
    key = [] if by else [F.pmod(F.unix_timestamp("w.start"), F.lit(1)).alias("key")]
    g = hit.groupBy(F.session_window("at", f"{size_seconds + 1} seconds").alias("s"), *by, *key).agg(F.min("w.start").alias("first_start"), F.max("w.start").alias("last_start"), F.count(F.lit(1)).alias("windows"))
    return g.where(F.col("windows") * size_seconds >= least_seconds).select(*by, "first_start", "last_start", "windows")
