"""Files and partitions as sources."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import database


class SourceError(ValueError):
    """A source that is missing or holds nothing."""


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; the schema is inferred where none is given."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", schema: StructType | str | None = None, timestamps: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of delimited text with a header.

    Lines with too many fields are rejected, short ones are padded with nulls.  Without a schema all
    columns are text.  A path without files or with an empty file only is an error; a header alone
    gives no rows.
    """
    try:
        header = spark.read.option("sep", sep).option("encoding", encoding).option("header", True).csv(path)
    except AnalysisException as e:
        raise SourceError(f"can't read {path}: {e}") from e
    if not header.columns:
        raise SourceError(f"{path} is empty")
    own = StructType([StructField(c, StringType()) for c in header.columns]) if schema is None else (StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    full = StructType([*own.fields, StructField("_corrupt", StringType())])
    df = spark.read.schema(full).option("sep", sep).option("encoding", encoding).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    # Quoted separators don't count as fields.
    fields = F.size(F.split(F.regexp_replace("_corrupt", r'"(?:[^"]|"")*"', ""), f"\\Q{sep}\\E"))
    # Lines are only checked if all columns are read, which the last condition, always true, asks for.
    whole = F.length(F.concat_ws("", *[F.col(c).cast("string") for c in own.names])) >= 0
    df = df.where(whole)
    long = F.col("_corrupt").isNotNull() & (fields > len(own.fields))
    rows = df.where(~long).drop("_corrupt")
    rows = rows.withColumns({c: F.col(c).try_cast("timestamp") for c in timestamps if c in rows.columns})
    rejected = df.where(long).select(F.col("_corrupt").alias("line"), F.col("_metadata.file_path").alias("file"))
    return rows, rejected


def read_directory(spark: SparkSession, path: str, pattern: str = "*.csv", schema: StructType | str | None = None) -> DataFrame:
    """All files of a folder as one table, with the file of each row in source_file."""
    reader = spark.read.option("header", True).option("pathGlobFilter", pattern)
    reader = reader.schema(schema) if schema else reader
    return reader.csv(path).withColumn("source_file", F.col("_metadata.file_path"))


def read_table(spark: SparkSession, name: str, url: str | None = None, split_by: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of the catalogue, or of a database if a JDBC url, or sqlite: and a file's path, is given.

    split_by, a whole number, date or timestamp column, parts the read: the database is asked for its ends
    first, and `parts` tasks then read a range each (rows without a value go with the first).  A SQLite table is always read in parts: by a whole
    number column, or by the numbers of its rows, which need no index."""
    if url is None:
        return spark.table(name)
    if url.startswith(database.PREFIX):
        return database.read(spark, url.removeprefix(database.PREFIX), name, split_by, parts)
    reader = spark.read.format("jdbc").options(url=url, **options)
    if split_by:
        c = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(split_by)
        low, high = reader.option("query", f"select min({c}) as low_end, max({c}) as high_end from {name}").load().first()
        if low is not None and low != high:
            reader = spark.read.format("jdbc").options(url=url, **options).options(partitionColumn=split_by, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
        else:
            reader = spark.read.format("jdbc").options(url=url, **options)
    return reader.option("dbtable", name).load()


def latest_partition(df: DataFrame, c: str) -> DataFrame:
    """The rows of the greatest partition in text order; the filter prunes all other partitions."""
    last = df.agg(F.max(F.col(c).cast("string"))).first()[0]
    if last is None:
        raise SourceError(f"no partition in {c}")
    return df.where(F.col(c).cast("string") == last)


def landed_files(df: DataFrame) -> DataFrame:
    """(file, bytes, rows) of the files behind a table."""
    return df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))


def landing_check(files: DataFrame) -> DataFrame:
    """One row: files, megabytes, rows, verified (false if nothing landed)."""
    n = F.count(F.lit(1))
    return files.agg(n.alias("files"), F.coalesce(F.round(F.sum("bytes") / 1048576, 2), F.lit(0.0)).alias("megabytes"), F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows"), (n > 0).alias("verified"))


def differences(found: DataFrame, expected: DataFrame, c: str) -> DataFrame:
    """(c, state) of each value that is expected and not found (missing) or found and not expected (extra)."""
    both = _compared(found, expected, c).where("__e is null or __f is null")
    return both.select(c, F.when(F.col("__f").isNull(), "missing").otherwise("extra").alias("state"))


def completeness(found: DataFrame, expected: DataFrame, c: str, names: int = 1000) -> DataFrame:
    """One row: is_valid, expected_count, actual_count, missing, extra: expected values of c against those found.

    Counts and verdict are over all values; the lists report the first `names` in order, and differences() gives every one."""
    both = _compared(found, expected, c)
    counts = both.agg(F.count("__e").alias("expected_count"), F.count("__f").alias("actual_count"), (F.count_if(F.col("__f").isNull()) == 0).alias("is_valid"))
    listed = differences(found, expected, c).select(F.col(c).cast("string").alias("name"), "state")
    first = lambda state: listed.where(F.col("state") == state).orderBy("name").limit(names)
    own = lambda state: F.array_sort(F.collect_list(F.when(F.col("state") == state, F.col("name")))).alias(state)
    lists = first("missing").unionByName(first("extra")).agg(own("missing"), own("extra"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    return one(counts).join(one(lists), "__one").select("is_valid", "expected_count", "actual_count", "missing", "extra")


def _compared(found: DataFrame, expected: DataFrame, c: str) -> DataFrame:
    f, e = found.select(c).distinct(), expected.select(c).distinct()
    return e.withColumn("__e", F.lit(True)).join(f.withColumn("__f", F.lit(True)), c, "full_outer")


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of each file (of at most 2 GB)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def table_fingerprint(df: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """(rows, fingerprint) of a table or of its partitions, whatever the order of rows."""
    h = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("fingerprint"))
