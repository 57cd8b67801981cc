"""A run over a folder of delimited files, with counts and failures by file.

All files are read once, whatever their number: rows are written with their file and outcome, and what a
file has given is counted from that column of the written table.  A file that fails keeps its rows out of
the result and leaves the others alone.
"""

from __future__ import annotations

import fnmatch
import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.columns import is_blank
from ..operators.dedupe import distinct_rows
from .runs import Ledger
from .scratch import staged
from .snapshots import Snapshots, file_system

FILE = "source_file"
_LISTED = 20
#: Rows that a task of tidy() holds.
_ROWS = 500_000


@dataclass
class Landed:
    """What a run has made: files(source_file, status, rows_extracted, rows_transformed, rows_loaded, error), and totals of all files."""

    files: DataFrame
    totals: dict[str, int]
    rows: DataFrame


def tidy(df: DataFrame, parts: int | None = None) -> DataFrame:
    """The usual transformation: rows with any value, each once a file; in `parts` tasks, if given."""
    some = [c for c in df.columns if c != FILE]
    filled = F.lit(False)
    for c in some:
        filled = filled | ~is_blank(c)
    return distinct_rows(df.where(filled), parts)


def run_files(
    spark: SparkSession, path: str, out: str, columns: Sequence[str], required: Sequence[str] = (), transform: Callable[[DataFrame], DataFrame] | None = None, sep: str = ",", pattern: str = "*.csv",
    load: Callable[[DataFrame], object] | None = None,
) -> Landed:
    """Take all files below a path with the given header through extraction, checks, transformation and load.

    A file fails, with the reasons in `error`, if it has no rows, no such header, a row with another number
    of fields, or a row without a required value.  transform() gets the rows of the other files with
    `source_file` and must keep it (without one: tidy(), in tasks of bounded size); load() gets its result, and what it raises ends the run.  The result is
    a dataset of snapshots at out/rows, put in place as a whole, so a run that ends early changes nothing.
    """
    # Spark's readers leave files without a byte out.
    listed = spark.createDataFrame([(f,) for f in empty_files(spark, path, pattern)], f"{FILE} string").withColumn("bytes", F.lit(0).cast("long"))
    listed = listed.unionByName(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select(F.col("path").alias(FILE), F.col("length").alias("bytes")))
    schema = StructType([StructField(c, StringType()) for c in (*columns, "_corrupt")])
    raw = spark.read.schema(schema).option("sep", sep).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).csv(path)
    head = F.lit(True)
    for c in columns:
        head = head & F.coalesce(F.trim(c) == c, F.lit(False))
    missing = F.lit(False)
    for c in required:
        missing = missing | is_blank(c)
    outcome = F.when(head, "head").when(F.col("_corrupt").isNotNull(), "fields").when(missing, "missing").otherwise("good")
    seen, made = Observation(), Observation()
    marked = raw.select(*columns, "_corrupt", F.col("_metadata.file_path").alias(FILE)).withColumn("outcome", outcome)
    # The counts of the run come with the write itself.
    marked = marked.observe(seen, F.count_if(F.col("outcome") != "head").alias("rows_extracted"), F.count_if(F.col("outcome").isin("fields", "missing")).alias("rows_bad"))
    # No folders by outcome: a task would sort its rows for them, and rows with a path are wide.
    marked.drop("_corrupt").write.parquet(f"{out}/bronze", mode="overwrite")
    bronze = spark.read.schema(StructType([*(StructField(c, StringType()) for c in (*columns, FILE, "outcome"))])).parquet(f"{out}/bronze")
    n = lambda x: F.count_if(F.col("outcome") == x)
    per = bronze.groupBy(FILE).agg(n("head").alias("heads"), n("fields").alias("fields"), n("missing").alias("missing"), F.count_if(F.col("outcome") != "head").alias("rows_extracted"))
    zero = {"heads": 0, "fields": 0, "missing": 0, "rows_extracted": 0}
    per = listed.join(per, FILE, "left").fillna(zero)
    says = F.concat_ws(
        "; ", F.when(F.col("rows_extracted") == 0, "no rows"), F.when((F.col("rows_extracted") > 0) & (F.col("heads") == 0), "no header"),
        F.when(F.col("fields") > 0, F.concat("fields", F.lit(" rows with another number of fields"))), F.when(F.col("missing") > 0, F.concat("missing", F.lit(" rows without a required value"))),
    )
    per = staged(per.withColumn("error", F.nullif(says, F.lit(""))))
    failed = per.where("error is not null").select(FILE)
    good = bronze.where("outcome = 'good'").drop("outcome").join(failed, FILE, "left_anti")
    if transform is None:
        transform = functools.partial(tidy, parts=int(seen.get.get("rows_extracted") or 0) // _ROWS + 1)
    silver = transform(good).observe(made, F.count(F.lit(1)).alias("rows_transformed"))
    Snapshots(spark, f"{out}/rows").replace(silver)
    rows = Snapshots(spark, f"{out}/rows").read()
    if load:
        load(rows)
    done = rows.groupBy(FILE).agg(F.count(F.lit(1)).alias("rows_transformed"))
    files = per.join(done, FILE, "left").fillna({"rows_transformed": 0})
    files = staged(files.select(FILE, F.when(F.col("error").isNull(), "processed").otherwise("failed").alias("status"), "rows_extracted", "rows_transformed", F.col("rows_transformed").alias("rows_loaded"), "error"))
    ends = files.agg(F.count_if(F.col("status") == "processed").alias("files_processed"), F.count_if(F.col("status") == "failed").alias("files_failed")).first().asDict()
    # No file at all: nothing was observed.
    counts = {**zero_totals(), **ends, **seen.get, **made.get}
    counts["rows_loaded"] = counts["rows_transformed"]
    return Landed(files, {k: int(v or 0) for k, v in counts.items()}, rows)


def empty_files(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Files below a path without a byte."""
    (fs, p), out = file_system(spark, path), []
    it = fs.listFiles(p, True)
    while it.hasNext():
        s = it.next()
        if not s.getLen() and fnmatch.fnmatch(s.getPath().getName(), pattern):
            out.append(s.getPath().toString())
    return out


def zero_totals() -> dict[str, int]:
    return dict.fromkeys(("files_processed", "files_failed", "rows_extracted", "rows_bad", "rows_transformed", "rows_loaded"), 0)


def record_files(ledger: Ledger, dataset: str, path: str, checksum: str, out: str, columns: Sequence[str], version: str | None = None, **how) -> Landed:
    """run_files() as a run of the ledger: its counts end up with the run, and each failed file in quarantine."""
    run_id = ledger.start(dataset, path, checksum, version)
    try:
        landed = run_files(ledger.spark, path, out, columns, **how)
    except Exception as e:
        ledger.fail(run_id, str(e))
        raise
    bad = landed.files.where("status = 'failed'")
    ledger.quarantine_rows(run_id, dataset, path, bad.select(FILE, "rows_extracted", "error").withColumn("reasons", F.array(F.lit("FILE_FAILURE"))))
    t = landed.totals
    named = [f"{r[FILE].rpartition('/')[2]}: {r['error']}" for r in bad.orderBy(FILE).limit(_LISTED).collect()]
    more = f"; {t['files_failed'] - _LISTED} more in quarantine" if t["files_failed"] > _LISTED else ""
    ledger.finish(run_id, t["rows_extracted"], t["rows_loaded"], t["rows_bad"], files_processed=t["files_processed"], files_failed=t["files_failed"], rows_transformed=t["rows_transformed"], error="; ".join(named) + more or None)
    return landed
