import datetime as dt
import importlib.util
import itertools
import os
import subprocess
import sys
import threading
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.operators import dedupe
from tidemill.operators.quality import Contract, QualityError, enforce, split_rows
from tidemill.sources import database, files, landing, runs, sinks, snapshots

from .conftest import rows


def write(path, text):
    path.write_text(text)
    return str(path)


def test_delimited(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'id,name,value\n1,"a,b",2024-01-01\n2,b\n3,c,x,too,many\n')
    good, bad = files.read_delimited(spark, p, timestamps=["value"])
    assert rows(good.select("id", "name")) == [("1", "a,b"), ("2", "b")] and good.where("value is not null").count() == 1
    assert rows(bad.select("line")) == [("3,c,x,too,many",)]
    assert files.read_delimited(spark, write(tmp_path / "b.csv", "id,name\n"))[0].count() == 0
    assert rows(files.read_delimited(spark, write(tmp_path / "c.csv", "id;n\n1;2\n"), sep=";")[0]) == [("1", "2")]
    for missing in (str(tmp_path / "none.csv"), write(tmp_path / "e.csv", "")):
        with pytest.raises(files.SourceError):
            files.read_delimited(spark, missing)


def test_directory_and_landing(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    write(d / "b.csv", "id\n1\n2\n")
    write(d / "a.csv", "id\n3\n")
    write(d / "x.txt", "no")
    df = files.read_directory(spark, str(d))
    assert df.count() == 3 and df.select("source_file").distinct().count() == 2
    landed = files.landed_files(spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(str(d)))
    assert files.landing_check(landed).select("files", "rows", "verified").first() == (2, 3, True)
    assert files.landing_check(landed.where("false")).first()["verified"] is False
    sums = files.file_fingerprints(spark, str(d))
    assert sums.count() == 3 and sums.where("length(sha256) = 64").count() == 3
    found = files.completeness(spark.createDataFrame([("a",), ("c",)], "f string"), spark.createDataFrame([("a",), ("b",)], "f string"), "f").first()
    assert tuple(found) == (False, 2, 2, ["b"], ["c"])


def test_fingerprint_ignores_order(spark):
    a = spark.range(100).withColumn("x", F.col("id") * 2)
    assert rows(files.table_fingerprint(a)) == rows(files.table_fingerprint(a.orderBy(F.desc("id")).repartition(7)))
    assert rows(files.table_fingerprint(a)) != rows(files.table_fingerprint(a.where("id > 0")))


def test_latest_partition(spark):
    df = spark.createDataFrame([("2024-01", 1), ("2024-02", 2)], "p string, v int")
    assert rows(files.latest_partition(df, "p")) == [("2024-02", 2)]
    with pytest.raises(files.SourceError):
        files.latest_partition(df.where("false"), "p")


def test_partitioned_and_dynamic_overwrite(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.write_partitioned(spark.createDataFrame([(1, 2020), (2, 2021)], "v int, y int"), p, ["y"])
    sinks.replace_partitions(spark.createDataFrame([(3, 2021)], "v int, y int"), p, ["y"])
    assert rows(spark.read.parquet(p)) == [(1, 2020), (3, 2021)]


def test_replace_keeps_old_on_failure(spark, tmp_path):
    for name in ("d.parquet", "d.csv"):
        p = str(tmp_path / name)
        sinks.replace_dataset(spark.range(3), p)
        sinks.replace_dataset(spark.range(5), p)
        assert sinks.read_dataset(spark, p).count() == 5 and sinks.read_dataset(spark, p).dtypes == [("id", "bigint")]
        files = snapshots.files_below(spark, f"{p}/_data")
        broken = spark.range(2).select(F.raise_error(F.lit("no")).cast("string").alias("x"))
        with pytest.raises(Exception):
            sinks.replace_dataset(broken, p)
        assert sinks.read_dataset(spark, p).count() == 5 and snapshots.files_below(spark, f"{p}/_data") == files
    for bad in ("d.xls", "d"):
        with pytest.raises(ValueError):
            sinks.replace_dataset(spark.range(1), str(tmp_path / bad))
    with pytest.raises(FileNotFoundError):
        sinks.read_dataset(spark, str(tmp_path / "none.parquet"))


def test_readers_find_a_dataset_at_any_moment(spark, tmp_path):
    p, seen, stop = str(tmp_path / "d.parquet"), [], threading.Event()
    sinks.replace_dataset(spark.range(1).select(F.lit(0).alias("v")), p)

    def look():
        while not stop.is_set():
            seen.append([r[0] for r in sinks.read_dataset(spark, p).collect()])

    with ThreadPoolExecutor(1) as pool:
        reader = pool.submit(look)
        for k in range(1, 51):
            sinks.replace_dataset(spark.range(2).select(F.lit(k).alias("v")).coalesce(1), p)
        stop.set()
        reader.result()
    assert len(seen) > 5 and all(len(set(x)) == 1 and len(x) == (2 if x[0] else 1) for x in seen) and seen == sorted(seen)
    assert len(snapshots.Snapshots(spark, p).versions()) == 10 and len(snapshots.files_below(spark, f"{p}/_data")) == 10


def test_one_writer_gets_a_number(spark, tmp_path):
    p = f"{tmp_path}/log/1.json"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: snapshots.put_if_absent(spark, p, str(k) * 1000), range(8)))
    assert sum(won) == 1 and snapshots.read_text(spark, p) == str(won.index(True)) * 1000 and snapshots.names(spark, f"{tmp_path}/log") == ["1.json"]


def test_upserts_rewrite_what_they_touch(spark, tmp_path):
    t = snapshots.Snapshots(spark, str(tmp_path / "t"), keep=3)
    frame = lambda *r: spark.createDataFrame(list(r), "k long, seq int, v string")
    t.upsert(frame(*[(k, 1, "a") for k in range(60)]), ["k"], ["seq"], parts=8)
    before = t.snapshot()[1]["parts"]
    t.upsert(frame((7, 2, "b"), (7, 1, "x")), ["k"], ["seq"])
    after = t.snapshot()[1]["parts"]
    changed = [p for p in before if before[p] != after[p]]
    assert len(before) == 8 and len(changed) == 1 and t.read().where("v = 'b'").count() == 1 and t.read().count() == 60
    t.upsert(frame((7, 1, "older"), (8, None, "older"), (100, None, None)), ["k"], ["seq"])
    assert rows(t.read().where("k in (7, 8, 100)")) == [(100, None, None), (7, 2, "b"), (8, 1, "a")]
    assert t.upsert(frame(), ["k"], ["seq"]) == 4 and t.read().count() == 61 and t.versions() == [2, 3, 4]
    with pytest.raises(FileNotFoundError):
        t.read(1)
    with pytest.raises(Exception, match="null in a key"):
        t.upsert(frame((None, 1, "a")), ["k"], ["seq"])
    stray = tmp_path / "t" / "_data" / "stray"
    stray.mkdir()
    (stray / "x.parquet").write_text("left behind")
    assert t.vacuum() == 0 and t.vacuum(-1) == 1 and t.read().count() == 61


def test_writers_of_one_dataset_lose_nothing(spark, tmp_path):
    """Upserts that race for a number: those in other parts are carried over, those in the same part merge again."""
    t = lambda: snapshots.Snapshots(spark, str(tmp_path / "t"))
    frame = lambda w: spark.createDataFrame([(k, w * (1 if k % 2 else -1), f"w{w}") for k in range(w, w + 9)], "k long, seq int, v string")
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda w: t().upsert(frame(w), ["k"], ["seq"], parts=4, batch=(f"w{w}", 0)), range(6)))
    want = {}
    for w in range(6):
        for k, seq, v in frame(w).collect():
            want[k] = max(want.get(k, (-99, "")), (seq, v))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6] and rows(t().read()) == sorted(((k, *x) for k, x in want.items()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_layers(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, value string")
    sinks.publish_layer(df, root, "bronze", "orders", "run-001", "2026-10-31", source_uri="u", source_checksum="c")
    m = sinks.read_manifests(spark, root).first()
    assert (m["row_count"], m["column_names"], m["source_uri"]) == (2, ["id", "value"], "u")
    with pytest.raises(FileExistsError):
        sinks.publish_layer(df, root, "bronze", "orders", "run-001", "2026-10-31")
    for bad in ({"layer": "tin"}, {"dataset": "../x"}, {"kind": "xls"}):
        with pytest.raises(ValueError):
            sinks.publish_layer(df, root, **{"layer": "gold", "dataset": "d", "run_id": "r", "ingestion_date": "2026-01-01", **bad})


def test_load_table(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert sinks.load_table(df, "loaded_rows", "replace") == 1 and sinks.load_table(df, "loaded_rows") == 1
    assert files.read_table(spark, "loaded_rows").count() == 2 and sinks.load_table(df.where("false"), "loaded_rows") == 0
    for args in (("bad;drop", "append"), ("t", "upsert")):
        with pytest.raises(ValueError):
            sinks.load_table(df, *args)
    sinks.materialise(df, "a_view", False)
    assert spark.table("a_view").count() == 1


@pytest.fixture()
def ledger(spark, tmp_path):
    ticks = itertools.count()
    return runs.Ledger(spark, str(tmp_path / "control"), lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=next(ticks)))


def run(ledger, tmp_path, df, checksum="v1", version="contract-v1", **more):
    return runs.execute(ledger, "orders", "in.csv", checksum, lambda: df, lambda d: d, str(tmp_path / "lake"), "2026-10-31", version, **more)


def test_commit_skip_and_new_version(spark, tmp_path, ledger):
    df = spark.createDataFrame([(1, 2.0)], "id int, amount double")
    first = run(ledger, tmp_path, df)
    assert ledger.run(first)["status"] == "succeeded" and run(ledger, tmp_path, df) is None
    assert run(ledger, tmp_path, df, version="contract-v2") and run(ledger, tmp_path, df, checksum="v2")
    lineage = ledger.table("lineage").where(F.col("run_id") == first)
    silver = lineage.where("child like '%silver%'").first()["child"]
    assert runs.trace(ledger.table("lineage"), silver).count() == 2


def test_bad_silver_is_quarantined_and_replayed(spark, tmp_path, ledger):
    bad = spark.createDataFrame([(None,)], "id int")
    with pytest.raises(QualityError):
        run(ledger, tmp_path, bad, check_silver=lambda d: enforce(d, Contract(required_columns=("id",))))
    assert runs.checkpoints(ledger.table("runs")).isEmpty() and rows(runs.outcomes(ledger.table("runs")).select("status")) == [("failed",)]
    entry = ledger.table("quarantine").first()
    assert entry["reason"] == "DATA_QUALITY_FAILURE"
    good = run(ledger, tmp_path, spark.createDataFrame([(1,)], "id int"), checksum="fixed")
    assert runs.resolvable(ledger.table("quarantine"), ledger.table("runs")).first()["by_run"] == good
    ledger.mark_replayed(entry["id"], good)
    with pytest.raises(ValueError):
        ledger.mark_replayed(entry["id"], good)


def test_sink_failure_commits_nothing(spark, tmp_path, ledger):
    def sink(_):
        raise RuntimeError("sink")

    ok, errors = runs.execute_all([lambda: run(ledger, tmp_path, spark.range(1), sink=sink), lambda: run(ledger, tmp_path, spark.range(2), checksum="other")])
    assert not ok and len(errors) == 1 and runs.checkpoints(ledger.table("runs")).count() == 1
    assert ledger.table("quarantine").isEmpty()


def test_extraction_failure(spark, tmp_path, ledger):
    def extract():
        raise files.SourceError("gone")

    with pytest.raises(files.SourceError):
        runs.execute(ledger, "d", "u", "c", extract, lambda d: d, str(tmp_path / "lake"), "2026-01-01")
    assert ledger.table("quarantine").first()["reason"] == "SOURCE_EXTRACTION_FAILURE"


def test_ledger_rules(spark, ledger):
    r = ledger.start("d", "u", "c", None)
    with pytest.raises(ValueError):
        ledger.start("d", "u", "c", None, r)
    with pytest.raises(ValueError):
        ledger.finish(r, -1, 0)
    ledger.finish(r, 1, 1)
    with pytest.raises(ValueError):
        ledger.fail(r, "late")
    _, bad = split_rows(spark.createDataFrame([(7, -2)], "order_id int, amount int"), {"INVALID_AMOUNT": F.col("amount") >= 0})
    ledger.quarantine_rows(r, "d", "u", bad)
    assert rows(ledger.table("quarantine").select("reason", "payload")) == [("INVALID_AMOUNT", '{"order_id":7,"amount":-2}')]


def test_of_two_racing_runs_one_commits(spark, tmp_path):
    control, gate = str(tmp_path / "control"), threading.Barrier(2)
    ledgers = [runs.Ledger(spark, control, every=4) for _ in range(2)]

    def one(ledger):
        def transform(df):
            gate.wait()  # both have started before either commits
            return df

        return runs.execute(ledger, "orders", "in.csv", "c1", lambda: spark.range(3), transform, str(tmp_path / "lake"), "2026-10-31", "v1")

    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(one, ledgers))
    assert sum(r is not None for r in got) == 1
    assert rows(runs.outcomes(ledgers[0].table("runs")).select("status", "runs")) == [("failed", 1), ("succeeded", 1)]
    assert runs.checkpoints(ledgers[1].table("runs")).first()["run_id"] == next(r for r in got if r)
    assert run(ledgers[0], tmp_path, spark.range(3), checksum="c1", version="v1") is None


def test_ledger_folds_its_entries(spark, tmp_path):
    """Concurrent writers lose nothing; entries become Parquet files, and old ones go."""
    control = str(tmp_path / "control")
    with ThreadPoolExecutor(3) as pool:
        keys = list(pool.map(lambda k: runs.Ledger(spark, control, every=5).quarantine("r", f"d{k}", "u", "BAD", str(k)), range(23)))
    ledger = runs.Ledger(spark, control, every=5)
    found = ledger.table("quarantine")
    assert rows(found.select("dataset", "payload")) == sorted((f"d{k}", str(k)) for k in range(23)) and sorted(r["id"] for r in found.collect()) == sorted(keys)
    assert sorted(r["seq"] for r in found.collect()) == list(range(1, 24))
    log = snapshots.names(spark, f"{control}/_log")
    assert [n for n in log if "checkpoint" in n] == [f"{n:020d}.checkpoint.json" for n in (15, 20)] and [n for n in log if "checkpoint" not in n] == [f"{n:020d}.json" for n in range(16, 24)]
    r = ledger.start("d", "u", "c", None)
    for k in range(8):
        ledger.link(r, f"p{k}", f"p{k + 1}", k=k)
    ledger.finish(r, 5, 4, 1, files_processed=2)
    assert ledger.run(r)["files_processed"] == 2 and ledger.table("lineage").count() == 8


@pytest.mark.parametrize("cycle", [False, True])
def test_lineage_of_any_depth(spark, cycle):
    edges = [(f"n{k + 1}", f"n{k}") for k in range(40)] + [("side", "n20"), ("x", "y")] + ([("n0", "n40")] if cycle else [])
    found = runs.trace(spark.createDataFrame(edges + edges[:3], "parent string, child string"), "n0")
    want = [(f"n{k + 1}", f"n{k}", k + 1) for k in range(40)] + [("side", "n20", 21)] + ([("n0", "n40", 41)] if cycle else [])
    assert rows(found) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert runs.trace(spark.createDataFrame(edges, "parent string, child string"), "nobody").count() == 0


def test_files_of_a_run(spark, tmp_path):
    d = tmp_path / "in"
    (d / "deep").mkdir(parents=True)
    write(d / "good.csv", "id,name\n1,a\n1,a\n2,b\n,\n")
    write(d / "deep" / "quoted.csv", 'id,name\n3,"x,y"\n4,\n')
    write(d / "long.csv", "id,name\n5,a\n6,b,c\n")
    write(d / "headless.csv", "7,a\n8,b\n")
    write(d / "other.csv", "key,title\n9,a\n")
    write(d / "head.csv", "id,name\n")
    write(d / "empty.csv", "")
    write(d / "x.txt", "no")
    landed = landing.run_files(spark, str(d), str(tmp_path / "out"), ["id", "name"])
    name = F.regexp_extract("source_file", "([a-z]+).csv", 1)
    assert rows(landed.files.select(name, "status", "rows_extracted", "rows_transformed", "rows_loaded", "error")) == [
        ("empty", "failed", 0, 0, 0, "no rows"), ("good", "processed", 4, 2, 2, None), ("head", "failed", 0, 0, 0, "no rows"), ("headless", "failed", 2, 0, 0, "no header"),
        ("long", "failed", 2, 0, 0, "1 rows with another number of fields"), ("other", "failed", 2, 0, 0, "no header"), ("quoted", "processed", 2, 2, 2, None),
    ]
    assert landed.totals == {"files_processed": 2, "files_failed": 5, "rows_extracted": 12, "rows_bad": 1, "rows_transformed": 4, "rows_loaded": 4}
    assert rows(landed.rows.select("id", "name")) == [("1", "a"), ("2", "b"), ("3", "x,y"), ("4", None)]
    with pytest.raises(RuntimeError):  # a load that fails leaves the dataset and says so
        landing.run_files(spark, str(d), str(tmp_path / "out2"), ["id", "name"], load=lambda df: (_ for _ in ()).throw(RuntimeError("load")))


def test_file_runs_in_the_ledger(spark, tmp_path, ledger):
    d = tmp_path / "in"
    d.mkdir()
    write(d / "a.csv", "id,name\n1,a\n")
    write(d / "b.csv", "id,name\n,b\n3,c\n")
    landing.record_files(ledger, "d", str(d), "c1", str(tmp_path / "out"), ["id", "name"], required=["id"])
    r = ledger.table("runs").where("status = 'succeeded'").first()
    assert (r["rows_in"], r["rows_out"], r["rows_rejected"], r["files_processed"], r["files_failed"], r["rows_transformed"]) == (3, 1, 1, 1, 1, 1)
    assert r["error"] == "b.csv: 1 rows without a required value" and ledger.table("quarantine").first()["reason"] == "FILE_FAILURE"
    (tmp_path / "none").mkdir()
    landed = landing.record_files(ledger, "d", str(tmp_path / "none"), "c2", str(tmp_path / "out"), ["id"], version="2")
    assert landed.totals == landing.zero_totals() and landed.rows.count() == 0
    with pytest.raises(Exception, match="wrong"):
        landing.record_files(ledger, "d", str(d), "c3", str(tmp_path / "out"), ["id", "name"], transform=lambda df: df.select(F.raise_error(F.lit("wrong")).alias("x"), "source_file"))
    assert rows(runs.outcomes(ledger.table("runs")).select("status", "runs")) == [("failed", 1), ("succeeded", 2)]


def test_database_tables(spark):
    url = "jdbc:derby:memory:tests;create=true"
    df = spark.range(50).select("id", F.when(F.col("id") % 5 > 0, F.col("id") * 2).alias("k"), F.timestamp_seconds(F.col("id") * 86400).alias("at"))
    assert sinks.load_table(df, "t", "fail", url) == 50 and sinks.load_table(df.limit(0), "t", "replace", url) == 0
    for c, parts in (("id", 4), ("k", 3), ("at", 2)):
        got = files.read_table(spark, "t", url, split_by=c, parts=parts)
        assert got.rdd.getNumPartitions() == parts and rows(got) == rows(df)  # also the rows without a value
    assert files.read_table(spark, "t", url).count() == 50
    with pytest.raises(Exception, match="already exists"):
        sinks.load_table(df, "t", "fail", url)
    assert sinks.load_table(df.where("id = 7"), "t", "replace", url) == 1 and files.read_table(spark, "t", url, split_by="id").count() == 1
    assert sinks.load_table(df.where("id < 3"), "t", "append", url, batch=2) == 3 and rows(files.read_table(spark, "t", url).select("id")) == [(0,), (1,), (2,), (7,)]


def test_database_file(spark, tmp_path):
    """Modes, whole loads, types and nulls of a database file, written and read by several tasks."""
    url = database.database_url(spark, f"file://{tmp_path}/db")
    df = spark.range(0, 50, 1, 4).select(
        "id", F.when(F.col("id") % 5 > 0, F.col("id") * 2).alias("k"), F.timestamp_seconds(F.col("id") * 86400).alias("at"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.format_string("%05d", "id").alias("text"),
        (F.col("id") / 7).alias("x"), (F.col("id") == 3).alias("is"), F.expr("cast(id as decimal(30,0)) * 1000000000000000000000 + 0.01BD").alias("price"), F.encode(F.lit("ä"), "UTF-8").alias("raw"), F.lit(None).cast("smallint").alias("a \" b"),
    )
    load = lambda d, mode, table="t": sinks.load_table(d, table, mode, url, batch=7)
    assert load(df.limit(0), "fail", "u") == 0 and load(df, "fail") == 50 and load(df.limit(0), "replace") == 0
    for c, parts in (("id", 4), ("k", 3), (None, 5)):
        got = files.read_table(spark, "t", url, split_by=c, parts=parts)
        assert got.dtypes == df.dtypes and got.rdd.getNumPartitions() == parts and rows(got) == rows(df)
    for mode in ("append", "replace"):  # a load that fails on one task changes nothing
        with pytest.raises(Exception, match="NaN"):
            load(df.withColumn("x", F.when(F.col("id") != 30, F.col("x")).otherwise(F.lit(float("nan")))), mode)
        assert rows(files.read_table(spark, "t", url)) == rows(df)
    with pytest.raises(ValueError, match="already exists"):
        load(df, "fail")
    with pytest.raises(ValueError, match="has columns"):
        load(df.select("id"), "append")
    with pytest.raises(TypeError):
        load(spark.range(1).select(F.array("id").alias("a")), "replace")
    with pytest.raises(ValueError):
        files.read_table(spark, "u", url)
    assert load(df.where("id = 7"), "replace") == 1 and load(df.where("id < 3"), "append") == 3
    assert rows(files.read_table(spark, "t", url).select("id")) == [(0,), (1,), (2,), (7,)]


def test_a_repeated_task_adds_no_rows(spark, tmp_path):
    url = database.database_url(spark, f"file://{tmp_path}/db")
    path = url.removeprefix(database.PREFIX)
    with database._open(path) as db:
        db.execute(database._LOADS)
        db.execute("create table t (id bigint)")
        db.execute("insert into _loads values ('l', -1, 0, null, null)")
    for _ in range(2):
        spark.range(0, 10, 1, 3).mapInArrow(database._writer(path, "t", ["id"], "l", 4), "n long").collect()
        assert rows(files.read_table(spark, "t", url)) == [(k,) for k in range(10)]


def test_database_queries_on_a_cluster(tmp_path):
    """The database queries on executors of their own, by the entry of all queries."""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    code = f"""
import sys
import __spark_entry__
from pyspark.sql import SparkSession
conf = {{"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.checkpoint.dir": "file://{tmp_path}/shared", "spark.sql.warehouse.dir": "{tmp_path}/wh", "spark.sql.shuffle.partitions": "2"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
q = __spark_entry__.queries()
print("rows", q["s3_database_read"](spark, "/root/testdata/sf0.001").count(), q["k5_database_load"](spark, "/root/testdata/sf0.001").count())
"""
    top = Path(__file__).resolve().parent.parent
    home, own = Path(importlib.util.find_spec("pyspark").origin).parent, tmp_path / "home"
    (own / "work").mkdir(parents=True)
    for p in home.iterdir():
        if p.name != "work":
            (own / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK", "SPARK"))} | {"PYTHONPATH": str(top), "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(own), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.split("rows ")[-1].split() == [str(n) for n in _orders_by_status()], done.stderr[-2000:]


def _orders_by_status():
    c = duckdb.connect()
    return c.execute("select count(*) filter (where o_orderstatus <> 'P'), count(distinct o_orderstatus) from '/root/testdata/sf0.001/orders.parquet'").fetchall()[0]


def test_distinct_rows_in_bounded_tasks(spark):
    """As many tasks as asked for, none of which holds more than its share of the rows; copies, also those of other partitions, go."""
    df = spark.range(0, 4000, 1, 2).select((F.col("id") % 1000).alias("k"), F.when(F.col("id") % 2 == 0, "a").alias("v"))
    got = dedupe.distinct_rows(df.unionByName(spark.range(300).select(F.lit(7).alias("k"), F.lit(None).cast("string").alias("v"))), 8)
    held = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(held) == 8 and max(held) < 250 and rows(got) == rows(df.distinct())


def test_runs_of_files_sort_nothing(spark, tmp_path, monkeypatch):
    """Rows are written without a sort by outcome and deduplicated in tasks of bounded size."""
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.csv", "id,name\n" + "".join(f"{k},x\n" for k in range(40)) * 2)
    monkeypatch.setattr(landing, "_ROWS", 10)
    landed = landing.run_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["id", "name"])
    assert landed.totals["rows_extracted"] == 80 and landed.totals["rows_loaded"] == landed.rows.count() == 40
    assert not [n for n in snapshots.names(spark, f"{tmp_path}/out/bronze") if n.startswith("outcome=")]
    assert len(snapshots.files_below(spark, f"{tmp_path}/out/rows/_data")) > 4
