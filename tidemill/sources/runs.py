"""Incremental runs on tables: ledger, checkpoints, lineage, quarantine, replay.

All control tables are append-only; the state of a thing is its latest event.  The last write of a run
is its success event, which is its commit.  Writers race for the ledger's next number: of two runs over
one source one commits.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampType

from ..operators.quality import QualityError
from .files import SourceError
from .scratch import staged
from .sinks import publish_layer, read_manifests
from .snapshots import names, put_if_absent, read_text, remove

SCHEMAS = {
    "runs": "run_id string, dataset string, source_uri string, source_checksum string, version string, status string, at timestamp, rows_in long, rows_out long, rows_rejected long, error string, files_processed long, files_failed long, rows_transformed long, seq long",
    "lineage": "run_id string, parent string, child string, details string, at timestamp, seq long",
    "quarantine": "id string, run_id string, dataset string, source_uri string, reason string, payload string, status string, replay_run_id string, at timestamp, seq long",
}


def latest(events: DataFrame, keys: Iterable[str]) -> DataFrame:
    """The latest event a key; of events at one time a final one wins."""
    final = (F.col("status") != "running").cast("int") if "status" in events.columns else F.lit(0)
    by = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc(final))
    return events.withColumn("__k", F.row_number().over(by)).where("__k = 1").drop("__k")


def checkpoints(runs: DataFrame) -> DataFrame:
    """The latest succeeded run of each (dataset, source)."""
    return latest(runs.where("status = 'succeeded'"), ["dataset", "source_uri"])


def to_process(sources: DataFrame, done: DataFrame) -> DataFrame:
    """Sources(dataset, source_uri, source_checksum, version) that no checkpoint covers: same source,
    checksum and version; a source without a version takes any."""
    d = done.select(*[F.col(c).alias(f"__{c}") for c in ("dataset", "source_uri", "source_checksum", "version")])
    same = (F.col("dataset") == F.col("__dataset")) & (F.col("source_uri") == F.col("__source_uri")) & (F.col("source_checksum") == F.col("__source_checksum")) & (F.col("version").isNull() | (F.col("version") == F.col("__version")))
    return sources.join(d, same, "left_anti")


def outcomes(runs: DataFrame) -> DataFrame:
    """Runs by their final status."""
    return latest(runs, ["run_id"]).groupBy("status").agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("rows_out"), F.lit(0)).cast("long").alias("rows_out"))


def rows_by_layer(manifests: DataFrame) -> DataFrame:
    """(layer, runs, rows) published."""
    return manifests.groupBy("layer").agg(F.count_distinct("run_id").alias("runs"), F.sum("row_count").alias("rows"))


def quarantine_counts(quarantine: DataFrame) -> DataFrame:
    """(reason, status, entries) by the latest event of each entry."""
    return latest(quarantine, ["id"]).groupBy("reason", "status").agg(F.count(F.lit(1)).alias("entries"))


def durations(runs: DataFrame) -> DataFrame:
    """(dataset, runs, p50, p95, longest): seconds from the start to the end of ended runs."""
    seconds = lambda c: F.unix_micros(c) / 1e6
    each = runs.groupBy("dataset", "run_id").agg(F.min(F.when(F.col("status") == "running", F.col("at"))).alias("start"), F.max(F.when(F.col("status") != "running", F.col("at"))).alias("end"))
    each = each.where("start is not null and end is not null").withColumn("s", seconds("end") - seconds("start"))
    return each.groupBy("dataset").agg(F.count(F.lit(1)).alias("runs"), F.percentile("s", 0.5).alias("p50"), F.percentile("s", 0.95).alias("p95"), F.max("s").alias("longest"))


def trace(lineage: DataFrame, child: str) -> DataFrame:
    """(parent, child, level) of all that a dataset comes from.  Each level joins the parents that the one
    before has found, until none is new; an edge counts at its first level, so cycles end."""
    edges = staged(lineage.select("parent", "child").distinct())
    step = staged(edges.where(F.col("child") == child).withColumn("level", F.lit(1)))
    found, level = step, 1
    while not step.isEmpty():
        level += 1
        ups = step.select(F.col("parent").alias("child")).distinct()
        step = staged(edges.join(ups, "child").select("parent", "child").join(found.select("parent", "child"), ["parent", "child"], "left_anti").withColumn("level", F.lit(level)))
        found = found.unionByName(step)
    return found


def resolvable(quarantine: DataFrame, runs: DataFrame) -> DataFrame:
    """Pending quarantine entries with the first later succeeded run of their dataset (replay_run_id), if any."""
    pending = latest(quarantine, ["id"]).where("status = 'pending'")
    # Both in one order by time: an entry takes the next success behind it.  Days are looked at first,
    # so that a window holds a dataset's events of one day; entries with no success on their day take
    # the first one of the next day that has any.
    day = lambda c: F.date_trunc("day", c)
    good = runs.where("status = 'succeeded'").select("dataset", F.col("at").alias("when"), F.col("run_id").alias("good"), F.lit(0).alias("entry"), F.lit(None).cast("string").alias("id"))
    asked = pending.select("dataset", F.col("at").alias("when"), F.lit(None).cast("string").alias("good"), F.lit(1).alias("entry"), "id")
    # At one time runs come first: an entry takes a later one.
    behind = lambda *part: Window.partitionBy("dataset", *part).orderBy(F.col("when").desc(), F.col("entry").desc(), F.col("good").desc()).rowsBetween(Window.unboundedPreceding, -1)
    events = good.unionByName(asked).withColumn("day", day("when"))
    on_day = events.withColumn("next", F.last("good", ignorenulls=True).over(behind("day"))).where("entry = 1").select("dataset", "day", "id", "next")
    first = good.groupBy("dataset", day("when").alias("when")).agg(F.min_by("good", F.struct("when", "good")).alias("good"))
    days = first.withColumn("entry", F.lit(0)).unionByName(on_day.select("dataset", F.col("day").alias("when"), F.lit(None).cast("string").alias("good"), F.lit(1).alias("entry")).distinct())
    later = days.withColumn("after", F.last("good", ignorenulls=True).over(behind())).where("entry = 1").select("dataset", F.col("when").alias("day"), "after")  # a row a dataset and day
    own = on_day.join(later, ["dataset", "day"], "left").select("id", F.coalesce("next", "after").alias("by_run"))
    return pending.join(own, "id")


def version_of(contract: object, required: Iterable[str], transform_version: str) -> str:
    return hashlib.sha256(json.dumps([contract, sorted(required), transform_version], sort_keys=True, default=str).encode()).hexdigest()


class RunConflict(RuntimeError):
    """Another run has committed the same source since this one started."""


_ENTRY, _CHECKPOINT = re.compile(r"([0-9]{20})\.json"), re.compile(r"([0-9]{20})\.checkpoint\.json")


class Ledger:
    """Control tables in a folder, as a log of numbered entries that are put in place only if no other
    writer has put that number there.  Every `every` entries are folded into Parquet files that a checkpoint
    lists, so that a table is the checkpoint's files and the few entries behind it."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), every: int = 50):
        self.spark, self.root, self.clock, self.every = spark, root, clock, every

    def _path(self, n: int, kind: str = "json") -> str:
        return f"{self.root}/_log/{n:020d}.{kind}"

    def _state(self) -> tuple[int, int, dict[str, list[str]], list[dict]]:
        """(last number, checkpoint's number, files by table, entries' rows behind the checkpoint)."""
        while True:
            found = names(self.spark, f"{self.root}/_log")
            marks = [int(m[1]) for m in map(_CHECKPOINT.fullmatch, found) if m]
            base = max(marks, default=0)
            tail = sorted(n for n in (int(m[1]) for m in map(_ENTRY.fullmatch, found) if m) if n > base)
            texts = [read_text(self.spark, self._path(base, "checkpoint.json")) if base else "{}"] + [read_text(self.spark, self._path(n)) for n in tail]
            if None in texts:
                continue  # folded meanwhile
            files, rows = json.loads(texts[0]), []
            for n, text in zip(tail, texts[1:]):
                entry = json.loads(text)
                rows += [{**r, "seq": n} for r in entry["rows"]]
                for table, new in entry["files"].items():
                    files[table] = [*files.get(table, []), *new]
            return max([base, *tail]), base, files, rows

    def _frame(self, name: str, rows: list[dict]) -> DataFrame:
        schema = StructType.fromDDL(SCHEMAS[name])
        value = lambda r, f: dt.datetime.fromisoformat(r[f.name]) if isinstance(f.dataType, TimestampType) and r.get(f.name) else r.get(f.name)
        return self.spark.createDataFrame([tuple(value(r, f) for f in schema) for r in rows if r["table"] == name], schema)

    def table(self, name: str) -> DataFrame:
        _, _, files, rows = self._state()
        own = self._frame(name, rows)
        if not files.get(name):
            return own
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{f}" for f in files[name]]).unionByName(own)

    def commit(self, make: Callable[[], list[dict]], files: dict[str, list[str]] | None = None) -> int:
        """Put the rows that make() gives, and files of rows, under the next number.  make() checks what it
        needs; when another writer has taken the number, it is asked again."""
        while True:
            n, _, _, _ = self._state()
            entry = {"rows": [{k: v.isoformat() if isinstance(v, dt.datetime) else v for k, v in r.items()} for r in make()], "files": files or {}}
            if put_if_absent(self.spark, self._path(n + 1), json.dumps(entry)):
                if self._state()[1] > n + 1:  # this writer has slept while its number was folded away
                    remove(self.spark, self._path(n + 1))
                    continue
                if (n + 1) % self.every == 0:
                    self._fold()
                return n + 1

    def _fold(self) -> None:
        """Fold the entries into a checkpoint; the entries of the one before go."""
        n, base, files, rows = self._state()
        out = {}
        for name in SCHEMAS:
            own, new = files.get(name, []), [r for r in rows if r["table"] == name]
            if new:
                path = f"{name}/{uuid.uuid4().hex}"
                df = self._frame(name, new)
                if len(own) >= 16:  # few large files in place of many small ones
                    df, own = self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{f}" for f in own]).unionByName(df), []
                df.coalesce(1 if own else 8).write.parquet(f"{self.root}/{path}")
                own = [*own, path]
            out[name] = own
        if put_if_absent(self.spark, self._path(n, "checkpoint.json"), json.dumps(out)):
            for name in names(self.spark, f"{self.root}/_log"):
                m = _ENTRY.fullmatch(name) or _CHECKPOINT.fullmatch(name)
                if m and int(m[1]) < base or _ENTRY.fullmatch(name) and int(m[1]) <= base:
                    remove(self.spark, f"{self.root}/_log/{name}")

    def append(self, name: str, **row) -> None:
        self.commit(lambda: [{"table": name, **row}])

    def run(self, run_id: str) -> dict | None:
        r = latest(self.table("runs").where(F.col("run_id") == run_id), ["run_id"]).first()
        return r.asDict() if r else None

    def start(self, dataset: str, source_uri: str, checksum: str, version: str | None, run_id: str | None = None) -> str:
        run_id = run_id or uuid.uuid4().hex

        def make():
            if self.run(run_id):
                raise ValueError(f"run {run_id} exists")
            return [{"table": "runs", "run_id": run_id, "dataset": dataset, "source_uri": source_uri, "source_checksum": checksum, "version": version, "status": "running", "at": self.clock()}]

        self.commit(make)
        return run_id

    def _end(self, run_id: str, **more) -> None:
        def make():
            runs = self.table("runs")
            own = latest(runs.where(F.col("run_id") == run_id), ["run_id"]).first()
            if own is None or own["status"] != "running":
                raise ValueError(f"run {run_id} isn't running")
            if more["status"] == "succeeded":
                same = [F.col(c).eqNullSafe(F.lit(own[c])) for c in ("dataset", "source_uri", "source_checksum", "version")]
                other = runs.where((F.col("status") == "succeeded") & (F.col("seq") > own["seq"])).where(same[0] & same[1] & same[2] & same[3]).first()
                if other:
                    raise RunConflict(f"run {other['run_id']} has committed the source of run {run_id}")
            return [{"table": "runs", **own.asDict(), "at": self.clock(), **more}]

        self.commit(make)

    def finish(self, run_id: str, rows_in: int, rows_out: int, rows_rejected: int = 0, error: str | None = None, **counts: int) -> None:
        """Commit a run; `error` tells of files that failed in it.  If another run has committed the same source since this one started, it is a RunConflict."""
        if min(rows_in, rows_out, rows_rejected, *counts.values()) < 0:
            raise ValueError("counts can't be negative")
        self._end(run_id, status="succeeded", rows_in=rows_in, rows_out=rows_out, rows_rejected=rows_rejected, error=error, **counts)

    def fail(self, run_id: str, error: str, **counts: int) -> None:
        self._end(run_id, status="failed", error=error, **counts)

    def link(self, run_id: str, parent: str, child: str, **details) -> None:
        self.append("lineage", run_id=run_id, parent=parent, child=child, details=json.dumps(details, sort_keys=True), at=self.clock())

    def quarantine(self, run_id: str, dataset: str, source_uri: str, reason: str, payload: str = "") -> str:
        key = uuid.uuid4().hex
        self.append("quarantine", id=key, run_id=run_id, dataset=dataset, source_uri=source_uri, reason=reason, payload=payload, status="pending", at=self.clock())
        return key

    def quarantine_rows(self, run_id: str, dataset: str, source_uri: str, rejected: DataFrame) -> None:
        """Rows with `reasons`, as split_rows() gives them, each an entry."""
        own = rejected.select(
            F.sha2(F.concat(F.lit(run_id), F.to_json(F.struct(*rejected.columns)), F.monotonically_increasing_id().cast("string")), 256).alias("id"), F.lit(run_id).alias("run_id"), F.lit(dataset).alias("dataset"),
            F.lit(source_uri).alias("source_uri"), F.array_join("reasons", ",").alias("reason"), F.to_json(F.struct(*[c for c in rejected.columns if c != "reasons"])).alias("payload"),
            F.lit("pending").alias("status"), F.lit(None).cast("string").alias("replay_run_id"), F.lit(self.clock()).cast("timestamp").alias("at"), F.lit(None).cast("long").alias("seq"),
        )
        path = f"quarantine/{uuid.uuid4().hex}"
        own.write.parquet(f"{self.root}/{path}")
        self.commit(list, {"quarantine": [path]})

    def mark_replayed(self, key: str, run_id: str) -> None:
        """Close a pending entry by a later succeeded run of its dataset."""

        def make():
            entry = latest(self.table("quarantine").where(F.col("id") == key), ["id"]).first()
            run = self.run(run_id)
            if entry is None or entry["status"] != "pending":
                raise ValueError(f"{key} isn't pending")
            if run is None or run["status"] != "succeeded" or run["dataset"] != entry["dataset"] or run["at"] < entry["at"]:
                raise ValueError(f"run {run_id} can't close {key}")
            return [{"table": "quarantine", **entry.asDict(), "status": "replayed", "replay_run_id": run_id, "at": self.clock()}]

        self.commit(make)


def execute(
    ledger: Ledger, dataset: str, source_uri: str, checksum: str, extract: Callable[[], DataFrame], transform: Callable[[DataFrame], DataFrame], layer_root: str, ingestion_date: str,
    version: str | None = None, check_source: Callable[[DataFrame], object] | None = None, check_silver: Callable[[DataFrame], object] | None = None, gold: Callable[[DataFrame], DataFrame] | None = None, sink: Callable[[DataFrame], object] | None = None,
) -> str | None:
    """One layered run: extract, check, transform, check, bronze, silver, gold, sink, commit.

    Returns the run's id, or None if a committed run covers the source, also one that has overtaken this
    one.  Quality failures and extraction failures go to quarantine too; all failures end the run as
    failed and are raised.
    """
    spark = ledger.spark
    own = spark.createDataFrame([(dataset, source_uri, checksum, version)], "dataset string, source_uri string, source_checksum string, version string")
    if to_process(own, checkpoints(ledger.table("runs"))).isEmpty():
        return None
    run_id = ledger.start(dataset, source_uri, checksum, version)
    try:
        source = extract()
        if check_source:
            check_source(source)
        silver = transform(source)
        if check_silver:
            check_silver(silver)
        put = lambda df, layer: publish_layer(df, layer_root, layer, dataset, run_id, ingestion_date, source_uri=source_uri, source_checksum=checksum)
        parent, out = source_uri, None
        for layer, df in (("bronze", source), ("silver", silver), ("gold", gold(silver) if gold else None)):
            if df is not None:
                path = put(df, layer)
                ledger.link(run_id, parent, path, layer=layer)
                parent = path
                out = spark.read.schema(df.schema).parquet(path)
        if sink:
            sink(out)
        rows = {r["layer"]: r["row_count"] for r in read_manifests(spark, layer_root).where((F.col("run_id") == run_id) & (F.col("dataset") == dataset)).collect()}
        ledger.finish(run_id, rows["bronze"], rows.get("gold", rows["silver"]))
        return run_id
    except RunConflict as e:
        ledger.fail(run_id, str(e))
        return None
    except Exception as e:
        if isinstance(e, QualityError):
            ledger.quarantine(run_id, dataset, source_uri, "DATA_QUALITY_FAILURE", str(e))
        elif isinstance(e, SourceError):
            ledger.quarantine(run_id, dataset, source_uri, "SOURCE_EXTRACTION_FAILURE", str(e))
        ledger.fail(run_id, str(e))
        raise


def execute_all(runs: Iterable[Callable[[], object]]) -> tuple[bool, list[BaseException]]:
    """Run each; a failure stays with its source and makes the overall result false."""
    errors: list[BaseException] = []
    for run in runs:
        try:
            run()
        except Exception as e:
            errors.append(e)
    return not errors, errors
