"""Sinks: partitioned writes, whole replacements, immutable layers with manifests, tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import database
from .files import table_fingerprint
from .snapshots import Snapshots

# Layer names, and the names that are safe in paths (at most 128 characters).
LAYERS = ("bronze", "silver", "gold")
_SAFE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,127}")
#: Formats by the ending of a dataset's name.
FORMATS = {"csv": "csv", "parquet": "parquet", "pq": "parquet"}
_TABLE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")


def write_partitioned(df: DataFrame, path: str, partitions: Sequence[str] = (), mode: str = "overwrite", codec: str = "snappy", sort: Sequence[str] = ()) -> None:
    """Parquet by partitions.  Rows meet by partition first, so that a partition gets few files
    (a rebalance, which splits partitions that are too large)."""
    if partitions:
        df = df.hint("rebalance", *partitions)
    if sort:
        df = df.sortWithinPartitions(*partitions, *sort)
    writer = df.write.mode(mode).option("compression", codec)
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Overwrite only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def _paths(spark: SparkSession, *names: str):
    jvm = spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), paths


def _dataset(spark: SparkSession, path: str) -> Snapshots:
    kind = FORMATS.get(path.rstrip("/").rpartition(".")[2].lower())
    if kind is None:
        raise ValueError(f"{path} ends in none of {tuple(FORMATS)}")
    return Snapshots(spark, path, kind)


def replace_dataset(df: DataFrame, path: str) -> None:
    """Replace a dataset as a whole (CSV or Parquet by its name).  A snapshot file points to the new data
    when they are complete: readers (read_dataset) find the old or the new ones at any moment, and the
    old ones stay if writing fails."""
    _dataset(df.sparkSession, path).replace(df)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A dataset that replace_dataset has written, as it is now."""
    return _dataset(spark, path).read()


def publish_layer(df: DataFrame, root: str, layer: str, dataset: str, run_id: str, ingestion_date: str, kind: str = "parquet", source_uri: str = "", source_checksum: str = "", schema_version: str = "1") -> str:
    """Publish a run's data, once and for all, at layer/dataset/ingestion_date=/run_id=, and append
    its manifest row.  Returns the path; a second publication of the run is a FileExistsError."""
    layer = layer.strip().lower()
    if layer not in LAYERS:
        raise ValueError(f"layer {layer!r} is none of {LAYERS}")
    if kind not in ("csv", "parquet"):
        raise ValueError(f"format {kind!r} is neither csv nor parquet")
    for name in (dataset, run_id, ingestion_date):
        if not _SAFE.fullmatch(name):
            raise ValueError(f"unsafe name {name!r}")
    spark, path = df.sparkSession, f"{root}/{layer}/{dataset}/ingestion_date={ingestion_date}/run_id={run_id}"
    fs, (p,) = _paths(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    df.write.mode("errorifexists").option("header", True).format(kind).save(path)
    written = spark.read.schema(df.schema).option("header", True).format(kind).load(path)
    facts = table_fingerprint(written).select(
        F.lit(layer).alias("layer"), F.lit(dataset).alias("dataset"), F.lit(run_id).alias("run_id"), F.lit(ingestion_date).alias("ingestion_date"), F.lit(path).alias("path"),
        F.col("rows").alias("row_count"), F.array(*[F.lit(c) for c in df.columns]).alias("column_names"), "fingerprint", F.lit(source_uri).alias("source_uri"),
        F.lit(source_checksum).alias("source_checksum"), F.lit(schema_version).alias("schema_version"),
    )
    # A folder each: writers that append to one folder at the same time disturb one another.
    facts.coalesce(1).write.parquet(f"{root}/_manifests/{uuid.uuid4().hex}")
    return path


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(f"{root}/_manifests")


def load_table(df: DataFrame, table: str, mode: str = "append", url: str | None = None, batch: int = 10_000, **options: str) -> int:
    """Load into a table of the catalogue, of a database by JDBC, or of a SQLite file (sqlite: and its path); modes append, replace, fail.
    Returns the number of rows; an empty frame loads nothing."""
    modes = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}
    if mode not in modes:
        raise ValueError(f"mode {mode!r} is none of {tuple(modes)}")
    if not _TABLE.fullmatch(table):
        raise ValueError(f"unsafe table name {table!r}")
    if not isinstance(df, DataFrame):
        raise TypeError("a DataFrame is needed")
    if url and url.startswith(database.PREFIX):
        return database.load(df, url.removeprefix(database.PREFIX), table, mode, batch)
    n = df.count()
    if n == 0:
        return 0
    writer = df.write.mode(modes[mode])
    if url:
        writer.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).save()
    else:
        writer.saveAsTable(table)
    return n


def materialise(df: DataFrame, name: str, as_table: bool) -> None:
    """Staging models as views, marts as tables."""
    df.write.mode("overwrite").saveAsTable(name) if as_table else df.createOrReplaceTempView(name)
