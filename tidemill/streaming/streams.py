"""Incremental ingest, upserts and windows as streams.

Checkpoints decide what has been processed: a restarted stream takes only new files, and a batch
that is repeated after a failure has the same id and the same effect.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.quality import split_rows
from ..sources.snapshots import Snapshots


def file_stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", files_a_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("header", True).format(kind).load(path)


def ingest(stream: DataFrame, out: str, checkpoint: str, partitions: Sequence[str] = ()) -> StreamingQuery:
    """Append all files that are new since the last run, then stop."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.partitionBy(*partitions) if partitions else writer).start(out)


def current(spark: SparkSession, root: str, schema: StructType | None = None) -> DataFrame:
    """The rows of an upserted dataset as they are now; no rows before its first batch."""
    return Snapshots(spark, root).read(schema=schema)


def upsert_batches(root: str, keys: Sequence[str], order: Sequence[str], name: str = "stream", parts: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges batches into a dataset by snapshots.  Of a key's rows in any
    batch the last by `order` stays; a batch that is repeated after a failure is left out by its number,
    which the snapshot holds; other parts of the dataset than those of the batch's keys aren't touched."""

    def step(batch: DataFrame, batch_id: int) -> None:
        Snapshots(batch.sparkSession, root).upsert(batch, keys, order, parts, (name, batch_id))

    return step


def upsert_stream(stream: DataFrame, root: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], name: str = "stream", parts: int = 16) -> StreamingQuery:
    return stream.writeStream.foreachBatch(upsert_batches(root, keys, order, name, parts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_batches(good: str, bad: str, rules: Mapping[str, Column], name: str = "stream") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function with two sinks: rows that satisfy all rules, and the others as dead letters with
    their reasons.  Both datasets hold the number of the last batch that they have taken, so a batch that
    is repeated, also after a crash between the two, reaches each exactly once."""

    def step(batch: DataFrame, batch_id: int) -> None:
        rows, dead = split_rows(batch, rules)
        for root, df in ((good, rows), (bad, dead.withColumn("batch", F.lit(batch_id).cast("long")))):
            Snapshots(batch.sparkSession, root).append(df, (name, batch_id))

    return step


def split_stream(stream: DataFrame, good: str, bad: str, checkpoint: str, rules: Mapping[str, Column], name: str = "stream") -> StreamingQuery:
    return stream.writeStream.foreachBatch(split_batches(good, bad, rules, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_stream(windows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows (of a windowed aggregate with a watermark) to Parquet."""
    return windows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def deduplicated(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Each key once within the watermark's delay."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
