import pytest
from pyspark.sql import functions as F

from tidemill.plans import slo
from tidemill.streaming import streams

from .conftest import rows

EVENTS = "k long, seq long, v string, ts timestamp"


def put(spark, path, data):
    spark.createDataFrame(data, "k long, seq long, v string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def test_ingest_takes_new_files_only(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    put(spark, src, [(1, 1, "a", "2024-01-01 00:00:00")])
    for extra in ([], [(2, 1, "b", "2024-01-01 00:01:00")]):
        if extra:
            put(spark, src, extra)
        streams.ingest(streams.file_stream(spark, src, EVENTS), out, cp).awaitTermination()
    assert rows(spark.read.parquet(out).select("k")) == [(1,), (2,)]


def test_upsert_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    batches = [[(1, 5, "late", "2024-01-01 00:00:00"), (1, 2, "b", "2024-01-01 00:00:00")], [(1, 3, "c", "2024-01-02 00:00:00"), (2, 1, "d", "2024-01-02 00:00:00")], [(2, 1, "same", "2024-01-03 00:00:00"), (3, None, "n", "2024-01-03 00:00:00")]]
    for data in batches:  # an older row never replaces a newer one, whatever batch it is in
        put(spark, src, data)
        streams.upsert_stream(streams.file_stream(spark, src, EVENTS), out, cp, ["k"], ["seq"]).awaitTermination()
    want = [(1, "late"), (2, "d"), (3, "n")]
    assert rows(streams.current(spark, out).select("k", "v")) == want
    again = spark.read.parquet(src)
    for number in (0, 2):  # repeated batches
        streams.upsert_batches(out, ["k"], ["seq"])(again.withColumn("v", F.lit("wrong")).withColumn("seq", F.lit(9).cast("long")), number)
    assert rows(streams.current(spark, out).select("k", "v")) == want
    assert streams.current(spark, str(tmp_path / "none"), again.schema).count() == 0


def test_windows_agree_with_batch(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    put(spark, src, [(i, 1, "a", f"2024-01-01 {i // 4:02d}:{15 * (i % 4):02d}:00") for i in range(20)])
    put(spark, src, [(99, 1, "a", "2024-01-03 00:00:00")])
    stream = slo.windowed_counts(streams.file_stream(spark, src, EVENTS, files_a_batch=1), "1 hour", watermark="10 minutes")
    streams.window_stream(stream, out, cp).awaitTermination()
    batch = slo.windowed_counts(spark.read.parquet(src), "1 hour")
    closed = rows(spark.read.parquet(out))
    assert closed == [r for r in rows(batch) if r[0].day == 1] and len(closed) == 5


def test_sustained(spark):
    data = [(h, 3 if h in (1, 2, 5, 7, 8, 9) else 0) for h in range(12)]
    df = spark.createDataFrame(data, "h int, failed int").select(F.timestamp_seconds(F.col("h") * 3600).alias("window_start"), "failed")
    out = slo.sustained(df, F.col("failed") >= 3, 3600, 7200)
    assert [r[0] for r in rows(out.select("windows"))] == [2, 3]


def test_dead_letters_arrive_once_after_a_crash(spark, tmp_path, monkeypatch):
    """The run ends between its two sinks; the batch is repeated, and each sink has it once."""
    src, good, dead, cp = (str(tmp_path / n) for n in ("in", "good", "dead", "cp"))
    rules = {"NO_V": F.col("v").isNotNull(), "SEQ": F.col("seq") > 0}
    put(spark, src, [(1, 1, "a", "2024-01-01 00:00:00"), (2, 0, None, "2024-01-01 00:00:00"), (3, None, "c", "2024-01-01 00:00:00")])
    append, broken = streams.Snapshots.append, [True]

    def fails_once(self, df, batch=None):
        if self.root == dead and broken.pop():
            raise RuntimeError("crash")
        return append(self, df, batch)

    monkeypatch.setattr(streams.Snapshots, "append", fails_once)
    run = lambda: streams.split_stream(streams.file_stream(spark, src, EVENTS), good, dead, cp, rules).awaitTermination()
    with pytest.raises(Exception, match="crash"):
        run()
    assert streams.current(spark, good).count() == 1 and not (tmp_path / "dead").exists()
    broken.append(False)
    run()
    broken.append(False)
    put(spark, src, [(4, 2, "d", "2024-01-01 00:00:00")])
    run()
    assert rows(streams.current(spark, good).select("k")) == [(1,), (4,)]
    assert rows(streams.current(spark, dead).select("k", F.array_join("reasons", ","), "batch")) == [(2, "NO_V,SEQ", 0), (3, "SEQ", 0)]


def test_sustained_by_source(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    hours = {"x": (1, 2, 5, 7, 8, 9), "y": (3, 4, 5, 6)}
    data = [(s, "failed", f"2024-01-01 {h:02d}:{m:02d}:00") for s, hs in hours.items() for h in hs for m in (0, 10, 20)] + [("x", "failed", "2024-01-01 03:00:00"), ("z", "ok", "2024-06-01 00:00:00")]
    df = spark.createDataFrame(data, "source string, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(src)
    found = slo.sustained_stream(streams.file_stream(spark, src, df.schema), "1 hour", 3600, 3, 7200, "1 hour", by=("source",))
    streams.window_stream(found, out, cp).awaitTermination()
    hit = df.groupBy("source", F.window("ts", "1 hour")["start"].alias("window_start")).agg(F.count_if(F.col("status") == "failed").alias("failed"))
    batch = slo.sustained(hit, F.col("failed") >= 3, 3600, 7200, ("source",))
    assert rows(spark.read.schema(found.schema).parquet(out)) == rows(batch.select("source", "first_start", "last_start", "windows")) and batch.count() == 3


def test_deduplicated_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    put(spark, src, [(1, 1, "a", "2024-01-01 00:00:00"), (1, 2, "b", "2024-01-01 00:05:00"), (2, 1, "c", "2024-01-01 00:00:00")])
    streams.ingest(streams.deduplicated(streams.file_stream(spark, src, EVENTS), ["k"], "ts", "1 hour"), out, cp).awaitTermination()
    assert rows(spark.read.parquet(out).select("k")) == [(1,), (2,)]
