"""Queries over what sources and sinks have written: each writes given tables into a scratch folder of
its own, reads them again through the operator, and is compared with SQL over the tables themselves."""

from __future__ import annotations

import datetime as dt
import functools
import uuid
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..operators import conform, quality
from ..sources import database, files, landing, runs, sinks, snapshots
from ..sources.scratch import scratch_path
from ..streaming import streams
from . import slo, star
from .fixtures import AS_OF, Tables
from .registry import _raw_orders, query

RUN = dt.datetime(2002, 1, 1)


def scratch(t: Tables) -> str:
    return scratch_path(t.spark)


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").cast("decimal(14,2)").alias("price"), "l_returnflag")


@query("s1_csv_scan", "select l_orderkey, l_linenumber, l_returnflag, round(sum(cast(l_extendedprice as decimal(14,2))), 2)::double as price from lineitem group by all")
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    _lines(t).write.option("header", True).csv(path)
    return files.read_csv(t.spark, path).groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(F.sum(F.col("price").cast("decimal(14,2)")).cast("double").alias("price"))


def _delimited(t: Tables) -> tuple[DataFrame, DataFrame]:
    path, c = scratch(t), lambda n: F.col(n).cast("string")
    line = F.concat_ws("|", c("l_orderkey"), c("l_linenumber"), F.when(F.col("l_linenumber") != 2, c("l_returnflag")), F.when(F.col("l_linenumber") == 3, "too|many"))

    def headed(parts):  # each task writes a file that starts with the header
        yield pd.DataFrame({"line": ["order|number|flag"]})
        yield from parts

    t.lineitem.select(line.alias("line")).mapInPandas(headed, "line string").write.text(path)
    return files.read_delimited(t.spark, path, sep="|")


query("s2_delimited_rows", 'select cast(l_orderkey as varchar) as "order", cast(l_linenumber as varchar) as number, case when l_linenumber <> 2 then l_returnflag end as flag from lineitem where l_linenumber <> 3')(lambda t: _delimited(t)[0])
query("s2_rejected_lines", "select l_orderkey || '|3|' || l_returnflag || '|too|many' as line from lineitem where l_linenumber = 3")(lambda t: _delimited(t)[1].select("line"))


def _table(t: Tables, name: str) -> str:
    return f"tidemill_{name}_{uuid.uuid4().hex}"


@query("s3_table_source", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def _(t: Tables) -> DataFrame:
    name = _table(t, "source")
    sinks.materialise(t.orders, name, as_table=True)
    return files.read_table(t.spark, name).where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


def _database(t: Tables) -> str:
    """A new database in the shared folder, where all tasks of a cluster reach it."""
    return database.database_url(t.spark, scratch(t))


def _parts(t: Tables) -> int:
    return t.spark.sparkContext.defaultParallelism


@query("s3_database_read", "select o_orderkey, o_totalprice, o_orderpriority, cast(o_orderdate as date) as day from orders where o_orderstatus <> 'P'")
def _(t: Tables) -> DataFrame:
    """A database table, read back in parts."""
    url, o = _database(t), t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    sinks.load_table(o, "orders", url=url)
    return files.read_table(t.spark, "orders", url, parts=_parts(t)).where("o_orderstatus <> 'P'").drop("o_orderstatus")


@query("k5_database_load", "select o_orderstatus, count(*) * case when o_orderstatus = 'F' then 3 else 1 end as n, cast(sum(cast(o_totalprice as decimal(14,2))) * case when o_orderstatus = 'F' then 3 else 1 end as double) as price, 0 as of_nothing from orders group by 1")
def _(t: Tables) -> DataFrame:
    """A load, a replacement, two appended parts, and an empty one."""
    url, o = _database(t), t.orders.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(14,2)").alias("price"))
    load = lambda df, mode: sinks.load_table(df, "orders", mode, url, batch=500)
    load(o.where("o_orderstatus = 'P'"), "fail")
    load(o, "replace")
    for _ in range(2):
        load(o.where("o_orderstatus = 'F'"), "append")
    none = load(o.where("false"), "replace")
    got = files.read_table(t.spark, "orders", url, parts=_parts(t))
    return got.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("price").cast("double").alias("price"), F.lit(none).alias("of_nothing"))


@query("s4_directory", "select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus, true as from_csv from orders")
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    t.orders.select("o_orderkey", "o_orderstatus").repartition(3).write.option("header", True).csv(path)
    return files.read_directory(t.spark, path).select("o_orderkey", "o_orderstatus", F.col("source_file").endswith(".csv").alias("from_csv"))


@query("s7_landing", "select 4 as files, count(*) as rows, true as verified from lineitem")
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    _lines(t).repartition(4).write.parquet(path)
    return files.landing_check(files.landed_files(t.spark.read.parquet(path))).select("files", "rows", "verified")


@query("s8_file_fingerprints", "select cast(c_nationkey as varchar) as nation, cast(sum(strlen(c_name) + 1) as bigint) as bytes, sha256(string_agg(c_name || chr(10), '' order by c_custkey)) as sha256 from customer group by 1")
def _(t: Tables) -> DataFrame:
    """A file a nation."""
    path, by = scratch(t), t.customer.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    by.select(F.col("c_name").alias("line"), "c_nationkey").write.partitionBy("c_nationkey").text(path)
    return files.file_fingerprints(t.spark, f"{path}/*/*.txt").select(F.regexp_extract("file", "c_nationkey=([0-9]+)", 1).alias("nation"), "bytes", "sha256")


@query("s8_table_fingerprints", "select o_orderstatus, count(*) as rows, true as same, false as changed from orders group by 1")
def _(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderstatus", "o_orderkey", "o_totalprice")
    mark = lambda df, n: files.table_fingerprint(df, ["o_orderstatus"]).select("o_orderstatus", F.col("rows").alias(f"rows{n}"), F.col("fingerprint").alias(f"f{n}"))
    own = mark(o, 1).join(mark(o.repartition(7, "o_totalprice"), 2), "o_orderstatus").join(mark(o.withColumn("o_totalprice", F.col("o_totalprice") + 1), 3), "o_orderstatus")
    return own.select("o_orderstatus", F.col("rows1").alias("rows"), (F.col("f1") == F.col("f2")).alias("same"), (F.col("f1") == F.col("f3")).alias("changed"))


@query("k1_partitioned_write", "select o_orderkey, o_totalprice, o_orderstatus from orders")
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    sinks.write_partitioned(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"], sort=["o_orderkey"])
    return t.spark.read.parquet(path)


@query("k2_replaced", "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'O'")
def _(t: Tables) -> DataFrame:
    path, o = f"{scratch(t)}/orders.pq", t.orders.select("o_orderkey", "o_orderstatus")
    sinks.replace_dataset(o, path)
    sinks.replace_dataset(o.where("o_orderstatus = 'O'"), path)
    return sinks.read_dataset(t.spark, path)


def _published(t: Tables) -> tuple[str, str]:
    root = scratch(t)
    return root, sinks.publish_layer(t.orders.select("o_orderkey", "o_orderstatus"), root, "Bronze", "orders", "run-1", "2002-01-01", source_uri="orders.parquet", source_checksum="c1", schema_version="2")


query("k3_layer", "select o_orderkey, o_orderstatus from orders")(lambda t: t.spark.read.parquet(_published(t)[1]))
query("k4_manifest", "select 'bronze' as layer, 'orders' as dataset, 'run-1' as run_id, '2002-01-01' as ingestion_date, count(*) as row_count, 'o_orderkey,o_orderstatus' as columns, 'orders.parquet' as source_uri, 'c1' as source_checksum, '2' as schema_version from orders")(
    lambda t: sinks.read_manifests(t.spark, _published(t)[0]).select("layer", "dataset", "run_id", F.col("ingestion_date").cast("string").alias("ingestion_date"), "row_count", F.array_join("column_names", ",").alias("columns"), "source_uri", "source_checksum", "schema_version")
)


@query("k5_table_load", "select o_orderstatus, 2 * count(*) as n, 0 as of_nothing from orders group by 1")
def _(t: Tables) -> DataFrame:
    name, o = _table(t, "load"), t.orders.select("o_orderkey", "o_orderstatus")
    sinks.load_table(o, name, "replace")
    sinks.load_table(o, name)
    none = sinks.load_table(o.where("false"), name)
    return t.spark.table(name).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.lit(none).alias("of_nothing"))


@query("k6_materialised", "select o_orderstatus, count(*) as n from orders group by 1")
def _(t: Tables) -> DataFrame:
    staged, mart = _table(t, "stage"), _table(t, "mart")
    sinks.materialise(t.orders.select("o_orderkey", "o_orderstatus"), staged, as_table=False)
    sinks.materialise(t.spark.table(staged).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), mart, as_table=True)
    return t.spark.table(mart)


query("p9_audit", "select c_custkey, timestamp '2002-01-01' as etl_inserted_at, timestamp '2002-01-01' as etl_updated_at, '20020101000000' as etl_batch_id from customer")(lambda t: conform.add_audit(t.customer.select("c_custkey"), AS_OF))



@query("a12_quantile_rank_errors", "select l_returnflag, count(*) as n, true as low_holds, true as high_holds from lineitem group by 1 union all select 'all', count(*), true, true from lineitem")
def _(t: Tables) -> DataFrame:
    """Sketches by year are written, a year comes later, and quantiles by flag and over all come from the sketches: their ranks hold within 0.01."""
    path, lines = scratch(t), t.lineitem.select("l_returnflag", "l_extendedprice", F.year("l_shipdate").alias("year"))
    for years in (F.col("year") != 1995, F.col("year") == 1995):
        agg.quantile_sketches(lines.where(years), "l_extendedprice", ["year", "l_returnflag"]).write.mode("append").parquet(path)
    kept, at = t.spark.read.parquet(path), {"low": 0.33, "high": 0.67}
    cuts = agg.sketch_quantiles(agg.merged_sketches(kept, ["l_returnflag"]), at, ["l_returnflag"])
    every = agg.sketch_quantiles(agg.merged_sketches(kept), at).withColumn("l_returnflag", F.lit("all"))
    rows = lines.withColumn("l_returnflag", F.explode(F.array("l_returnflag", F.lit("all"))))
    # The cut's ranks reach its share within 0.01: rows below it are no more, rows up to it no less.
    below = lambda c, q: F.avg((F.col("l_extendedprice") < F.col(c)).cast("int")) <= q + 0.01
    upto = lambda c, q: F.avg((F.col("l_extendedprice") <= F.col(c)).cast("int")) >= q - 0.01
    return rows.join(F.broadcast(cuts.unionByName(every)), "l_returnflag").groupBy("l_returnflag").agg(F.max("n").alias("n"), *[(below(c, q) & upto(c, q)).alias(f"{c}_holds") for c, q in at.items()])


query(
    "c16_sample", "select mmr, sellingprice, condition from car_prices order by md5(concat_ws('|', '42', order_id, line, part, seller)), order_id, line, part, seller, sellingprice, mmr, condition limit 1000", "car_prices",
)(lambda t: agg.sample(t.car_prices(), 1000, ["order_id", "line", "part", "seller"], then=["sellingprice", "mmr", "condition"]).select("mmr", "sellingprice", "condition"))
query("t4_sample", "select o_orderkey, o_totalprice from orders order by md5('42|' || o_orderkey), o_orderkey limit 1000")(lambda t: agg.sample(t.orders, 1000, ["o_orderkey"]).select("o_orderkey", "o_totalprice"))

# ---------------------------------------------------------------- quality

@query("q3_schema", """select 'schema' as "check", missing + extra = 0 as passed, cast(missing + extra as double) as value from (select
       (select count(*) from (select distinct n_name from nation where n_regionkey < 4 except select n_name from nation join customer on n_nationkey = c_nationkey where c_acctbal > 9900)) as missing,
       (select count(*) from (select n_name from nation join customer on n_nationkey = c_nationkey where c_acctbal > 9900 except select n_name from nation where n_regionkey < 4)) as extra)""")
def _(t: Tables) -> DataFrame:
    """Columns that the data make: nations of rich customers, against the nations of the first regions."""
    rich = t.customer.where("c_acctbal > 9900").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    wide = rich.groupBy().pivot("n_name").agg(F.count(F.lit(1)))
    expected = [r[0] for r in t.nation.where("n_regionkey < 4").select("n_name").distinct().collect()]
    return quality.Checks(wide).schema(expected, strict=True).results().select("check", "passed", "value")


query(
    "q9_configured_checks",
    """select 'row_count' as "check", count(*) between 10 and 1000000000 as passed, count(*)::double as value from orders
    union all select 'null_share:priority', avg((o_orderpriority = '1-URGENT')::int) <= 0.1, round(avg((o_orderpriority = '1-URGENT')::int), 6) from orders
    union all select 'schema', true, 0 union all select 'duplicates:o_custkey', (count(*) - count(distinct o_custkey)) / count(*) <= 0.01, round((count(*) - count(distinct o_custkey)) / count(*), 6) from orders""",
)(
    lambda t: quality.run_checks(
        t.orders.withColumn("priority", F.nullif("o_orderpriority", F.lit("1-URGENT"))), {"row_count": {"min": 10, "max": 10**9}, "null_checks": {"priority": 0.1}, "expected_columns": ["o_orderkey"], "unique_keys": ["o_custkey"]},
    ).select("check", "passed", F.round("value", 6).alias("value"))
)
query(
    "q10_job_checks",
    """select 'row_count' as "check", count(*) >= 100 as passed, count(*)::double as value from orders union all select 'null_share:order_id', true, 0 union all select 'null_share:customer_id', true, 0
    union all select 'row_count', count(*) >= 100, count(*) from lineitem union all select 'null_share:order_id', true, 0""",
)(lambda t: star.job_checks(t.fact_orders(), t.fact_order_items()).select("check", "passed", "value"))
query("q11_validity", "select 'required_columns' as rule, 'city' as \"column\" union all select 'no_values', 'blank' from orders having count(*) > 0")(
    lambda t: quality.contract_violations(t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "  ").otherwise(" NaN ").alias("blank")), quality.Contract(required_columns=("o_orderkey", "blank", "city"))).select("rule", "column")
)


@query("q15_gate", "select o_orderstatus, count(*) >= (select count(*) // 4 from orders) as passes, count(*) <= (select count(*) // 4 from orders) as few from orders group by 1")
def _(t: Tables) -> DataFrame:
    """Whether a gate lets each status through that has a quarter of the orders at least, and at most."""
    quarter = t.orders.count() // 4

    def held(status: str, least: int | None, most: int | None) -> bool:
        try:
            quality.gate(quality.Checks(t.orders.where(F.col("o_orderstatus") == status)).row_count(least, most).results())
            return True
        except quality.QualityError:
            return False

    each = [(r[0], held(r[0], quarter, None), held(r[0], None, quarter)) for r in t.orders.select("o_orderstatus").distinct().collect()]
    return t.spark.createDataFrame(each, "o_orderstatus string, passes boolean, few boolean")


# ---------------------------------------------------------------- runs and streams


def _ledger(t: Tables) -> tuple[runs.Ledger, str]:
    """A ledger after two good runs, a skipped one and a failed one."""
    root = scratch(t)
    ledger, orders = runs.Ledger(t.spark, f"{root}/control"), t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")

    def step(name: str, checksum: str, least: int = 1) -> bool:
        def check(df: DataFrame) -> None:
            quality.enforce(df, quality.Contract(required_columns=("o_orderkey",), min_rows=least))

        try:
            return runs.execute(
                ledger, "orders", name, checksum, lambda: orders, lambda df: df.where("o_orderstatus <> 'P'"), f"{root}/layers", "2002-01-01", check_silver=check,
                gold=lambda df: df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")),
            ) is not None
        except quality.QualityError:
            return False

    ran = [step("a", "1"), step("a", "1"), step("a", "2"), step("b", "1", 10**9)]
    if ran != [True, False, True, False]:
        raise AssertionError(f"runs that committed: {ran}")
    return ledger, root


query(
    "i3_layered_runs",
    """with f as (select count(*) as b, count(*) filter (where o_orderstatus <> 'P') as s, count(distinct o_orderstatus) filter (where o_orderstatus <> 'P') as g from orders)
    select 'bronze' as layer, 2 as runs, 2 * b as rows from f union all select 'silver', 2, 2 * s from f union all select 'gold', 2, 2 * g from f""",
)(lambda t: runs.rows_by_layer(sinks.read_manifests(t.spark, f"{_ledger(t)[1]}/layers")))
query("i2_run_counts", "select 'succeeded' as status, 2 as runs, 2 * count(*) as rows_in, 2 * count(distinct o_orderstatus) filter (where o_orderstatus <> 'P') as rows_out from orders union all select 'failed', 1, 0, 0")(
    lambda t: runs.latest(_ledger(t)[0].table("runs"), ["run_id"]).groupBy("status").agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("rows_in"), F.lit(0)).alias("rows_in"), F.coalesce(F.sum("rows_out"), F.lit(0)).alias("rows_out"))
)
_PARENTS = "select c_custkey as child, c_custkey * 3 // 5 as parent from customer where c_custkey > 0"


def _parents(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey > 0").select(F.expr("c_custkey * 3 div 5").cast("string").alias("parent"), F.col("c_custkey").cast("string").alias("child"))


def _last(t: Tables) -> str:
    return str(t.customer.agg(F.max("c_custkey")).first()[0])


@query("i6_lineage", f"with recursive e as ({_PARENTS}), u as (select parent, child, 1 as level from e where child = (select max(child) from e) union all select e.parent, e.child, level + 1 from e join u on e.child = u.parent) select cast(parent as varchar) as parent, cast(child as varchar) as child, level from u")
def _(t: Tables) -> DataFrame:
    """A ledger's lineage with a link a customer: all that the last one comes from, a dozen levels up."""
    return runs.trace(_parents(t), _last(t))


@query("i6_lineage_cycle", f"with recursive e as ({_PARENTS} union all select 0, (select max(c_custkey) from customer) - 1 union all select 2, 3 union all select 3, 2), u as (select parent, child from e where child = (select max(child) from e) union select e.parent, e.child from e join u on e.child = u.parent) select cast(parent as varchar) as parent, cast(child as varchar) as child from u")
def _(t: Tables) -> DataFrame:
    """As i6_lineage, with links that go round."""
    last = int(_last(t))
    more = t.spark.createDataFrame([(str(last - 1), "0"), ("2", "3"), ("3", "2")], "parent string, child string")
    return runs.trace(_parents(t).unionByName(more), str(last)).select("parent", "child")


query("i9_quarantine_counts", "select event_type as reason, case when user_id % 3 = 0 then 'replayed' else 'pending' end as status, count(*) as entries from events group by 1, 2")(
    lambda t: runs.quarantine_counts(t.events.withColumn("later", F.explode(F.array(F.lit(0), F.lit(1)))).where("later = 0 or user_id % 3 = 0").select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("reason"), F.when(F.col("later") == 0, "pending").otherwise("replayed").alias("status"), (F.col("ts") + F.make_interval(secs="later")).alias("at")))
)
query("i9_durations", """with d as (select event_type as dataset, cast(floor(value * 100) as bigint) / 100.0::double as s from events)
      select dataset, count(*) as runs, round(quantile_cont(s, 0.5), 6) as p50, round(quantile_cont(s, 0.95), 6) as p95, round(max(s), 6) as longest from d group by 1""")(
    lambda t: runs.durations(t.events.withColumn("phase", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("dataset"), F.when(F.col("phase") == 0, "running").otherwise("succeeded").alias("status"),
        F.timestamp_micros(F.unix_micros("ts") + F.col("phase") * F.floor(F.col("value") * 100) * 10_000).alias("at"))).select("dataset", "runs", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "longest")])
)


@query(
    "i2_file_counts",
    """with l as (select *, case when l_linenumber = 6 and l_orderkey % 50 = 0 then null else l_returnflag end as flag from lineitem where l_linenumber < 8), f as (select l_linenumber as k, count(*) as n, count(*) filter (where flag is null) as missing, count(distinct l_orderkey || '|' || flag) as d from l group by 1)
    select 'file=' || k as file, case when k = 5 or missing > 0 then 'failed' else 'processed' end as status, n + case when k = 1 then n else 0 end as rows_extracted, case when k = 5 or missing > 0 then 0 else d end as rows_transformed,
      case when k = 5 or missing > 0 then 0 else d end as rows_loaded, case when k = 5 then 'no header' when missing > 0 then missing || ' rows without a required value' end as error from f
    union all select 'file=0', 'failed', 0, 0, 0, 'no rows' union all select 'all', (select count(*) from f where k <> 5 and missing = 0) || '/' || (select count(*) + 1 from f where k = 5 or missing > 0),
      (select sum(n) + max(case when k = 1 then n end) from f), (select sum(d) from f where k <> 5 and missing = 0), (select sum(d) from f where k <> 5 and missing = 0), null""",
)
def _(t: Tables) -> DataFrame:
    """A file a line number: one without a header, one with missing values, one with each row twice, and one without a byte."""
    path, out = scratch(t), scratch(t)
    k = F.col("l_linenumber")
    lines = t.lineitem.where(k < 8).select(F.col("l_orderkey").alias("order"), k.alias("number"), F.when(~((k == 6) & (F.col("l_orderkey") % 50 == 0)), F.col("l_returnflag")).alias("flag"), k.alias("file"))

    def put(k: int) -> None:  # one file, so one task, which streams: with folders by number it would sort its rows
        own = lines.where(F.col("file") == k).drop("file")
        (own.unionByName(own) if k == 1 else own).repartition(1).write.option("header", k != 5).csv(f"{path}/file={k}")

    with ThreadPoolExecutor(7) as pool:
        list(pool.map(put, range(1, 8)))
    snapshots.put_if_absent(t.spark, f"{path}/file=0/part-0.csv", "")
    ledger = runs.Ledger(t.spark, scratch(t))
    landed = landing.record_files(ledger, "lines", path, "c1", out, ["order", "number", "flag"], required=["order", "flag"])
    run = ledger.table("runs").where("status = 'succeeded'").select(
        F.lit("all").alias("file"), F.concat_ws("/", "files_processed", "files_failed").alias("status"), F.col("rows_in").alias("rows_extracted"), "rows_transformed", F.col("rows_out").alias("rows_loaded"), F.lit(None).cast("string").alias("error"))
    return landed.files.withColumn("source_file", F.regexp_extract("source_file", "(file=[0-9]+)", 1)).withColumnRenamed("source_file", "file").unionByName(run)


@query("r1_incremental_ingest", "select event_id, event_type, value from events")
def _(t: Tables) -> DataFrame:
    """Two arrivals and a third run without news: each file is taken once."""
    root, e = scratch(t), t.events.select("event_id", "event_type", "value")
    for k in (0, 1, 2):
        if k < 2:
            e.where(F.col("event_id") % 2 == k).write.mode("append").parquet(f"{root}/in")
        streams.ingest(streams.file_stream(t.spark, f"{root}/in", e.schema), f"{root}/out", f"{root}/check").awaitTermination()
    return t.spark.read.schema(e.schema).parquet(f"{root}/out")


@query("r2_streaming_upsert", "select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1")
def _(t: Tables) -> DataFrame:
    """Batches come out of order, a file each, and one of them twice; the stream's own table is the result."""
    root, e = scratch(t), t.events.select("user_id", "event_type", "event_id")
    own, args = e.schema, (["user_id"], ["event_id"])
    for k in (1, 0, 2):
        e.where(F.col("event_id") % 3 == k).repartition(2, "event_id").write.mode("append").parquet(f"{root}/in")
        streams.upsert_stream(streams.file_stream(t.spark, f"{root}/in", own, files_a_batch=1), f"{root}/out", f"{root}/check", *args).awaitTermination()
    streams.upsert_batches(f"{root}/out", *args)(e.where(F.col("event_id") % 3 == 1), 0)
    return streams.current(t.spark, f"{root}/out")


def _dead_letters(t: Tables, dead: bool) -> DataFrame:
    """Two arrivals, a file a batch, and the first batch once more; rows with a large value or without a user are dead letters."""
    root, e = scratch(t), t.events.select("event_id", F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("user_id"), "value")
    rules = {"NO_USER": F.col("user_id").isNotNull(), "LARGE": F.col("value") <= 400}
    for k in (0, 1):
        e.where(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
        streams.split_stream(streams.file_stream(t.spark, f"{root}/in", e.schema, files_a_batch=1), f"{root}/good", f"{root}/dead", f"{root}/check", rules).awaitTermination()
    streams.split_batches(f"{root}/good", f"{root}/dead", rules)(e, 0)
    return streams.current(t.spark, f"{root}/dead" if dead else f"{root}/good")


query("r1_stream_rows", "select event_id, user_id, value from events where user_id % 5 > 0 and value <= 400")(lambda t: _dead_letters(t, False))
query("r8_stream_dead_letters", "select event_id, nullif(user_id % 5, 0) * 0 + user_id as user_id, value, concat_ws(',', case when user_id % 5 = 0 then 'NO_USER' end, case when value > 400 then 'LARGE' end) as reasons from events where user_id % 5 = 0 or value > 400")(
    lambda t: _dead_letters(t, True).select("event_id", "user_id", "value", F.array_join("reasons", ",").alias("reasons"))
)


@query("r9_sustained_stream", """with w as (select date_trunc('hour', ts) as s, count(*) filter (where event_type = 'error') as failed from events group by 1), h as (select s, epoch(s) / 3600 - row_number() over (order by s) as g from w where failed >= 3)
       select min(s) as first_start, max(s) as last_start, count(*) as windows from h group by g having count(*) >= 2""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    """Events arrive in four files by time, and one run a year later closes the last windows."""
    root, jobs = scratch(t), t.job_runs().select("status", "ts")
    first, last = jobs.agg(F.unix_timestamp(F.min("ts")), F.unix_timestamp(F.max("ts"))).first()
    quarter = F.least(F.lit(3), F.floor((F.unix_timestamp("ts") - first) * 4 / max(1, last - first)))
    for k in range(4):
        jobs.where(quarter == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    jobs.limit(1).select(F.lit("succeeded").alias("status"), F.timestamp_seconds(F.lit(last + 366 * 86400)).alias("ts")).coalesce(1).write.mode("append").parquet(f"{root}/in")
    found = slo.sustained_stream(streams.file_stream(t.spark, f"{root}/in", jobs.schema, files_a_batch=1), "1 hour", 3600, 3, 7200, "2 hours")
    streams.window_stream(found, f"{root}/out", f"{root}/check").awaitTermination()
    return t.spark.read.schema(found.schema).parquet(f"{root}/out")


@query(
    "b8_star_job",
    """select 'fact_orders' as name, cast(order_id as varchar) as id, concat_ws('|', customer_id, case when order_status = 'P' then 'unknown' else order_status end, delivery_days, is_delayed, order_year, order_month) as detail from fact_orders
    union all select 'dim_customers', cast(c_custkey as varchar), concat_ws('|', 'u' || c_custkey, c_mktsegment, upper(n_name), md5(cast(c_custkey as varchar))) from customer join nation on c_nationkey = n_nationkey
    union all select 'dim_products', cast(p_partkey as varchar), concat_ws('|', case when p_type <> 'PROMO' then lower(p_type) end, p_size * 20 * (p_size % 9), case when p_size * 20 * (p_size % 9) < 1000 then 'Small' when p_size * 20 * (p_size % 9) < 10000 then 'Medium' else 'Large' end) from part
    union all select 'dim_sellers', cast(s_suppkey as varchar), concat_ws('|', upper(n_name), md5(cast(s_suppkey as varchar))) from supplier join nation on s_nationkey = n_nationkey
    union all select 'fact_order_items', cast(l_orderkey * 2 as varchar), concat_ws('|', l_linenumber, cast(l_extendedprice as decimal(14,2)) + l_linenumber, order_year, order_month) from lineitem left join fact_orders on order_id = l_orderkey * 2""",
    "fact_orders",
)
def _(t: Tables) -> DataFrame:
    """Six delimited files from the tables, with copies, late versions and items of unknown orders; the job builds and writes five."""
    raw, out, both = scratch(t), scratch(t), F.explode(F.array(F.lit(0), F.lit(1)))
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    given = {
        "orders": _raw_orders(t),
        "customers": people.withColumn("copy", both).select(F.col("c_custkey").alias("customer_id"), F.concat(F.lit("u"), "c_custkey").alias("customer_unique_id"), F.col("c_mktsegment").alias("customer_city"), F.lower("n_name").alias("customer_state")),
        "products": t.part.withColumn("copy", both).select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("product_category_name"), F.col("p_size").alias("product_length_cm"), F.lit(20).alias("product_height_cm"), (F.col("p_size") % 9).alias("product_width_cm")),
        "categories": t.part.where("p_type <> 'PROMO'").select(F.col("p_type").alias("product_category_name"), F.lower("p_type").alias("product_category_name_english")).distinct(),
        "sellers": t.dim_sellers().withColumn("copy", both).select("seller_id", F.lower("seller_state").alias("seller_state")),
        "order_items": t.lineitem.select((F.col("l_orderkey") * 2).alias("order_id"), F.col("l_linenumber").alias("order_item_id"), F.col("l_extendedprice").cast("decimal(14,2)").alias("price"), F.col("l_linenumber").alias("freight_value")),
    }
    with ThreadPoolExecutor(len(given)) as pool:
        list(pool.map(lambda n: given[n].write.option("header", True).csv(f"{raw}/{n}.csv"), given))
    made = star.build_star(t.spark, raw, out, RUN)
    detail = {
        "fact_orders": ("order_id", ["customer_id", "order_status", "delivery_days", "is_delayed", "order_year", "order_month"]), "dim_customers": ("customer_id", ["customer_unique_id", "customer_city", "customer_state", "customer_key"]),
        "dim_products": ("product_id", ["product_category_name_english", F.col("product_volume_cm3").cast("long"), "product_size_category"]), "dim_sellers": ("seller_id", ["seller_state", "seller_key"]),
        "fact_order_items": ("order_id", ["order_item_id", F.col("total_value").cast("decimal(14,2)"), "order_year", "order_month"]),
    }
    parts = [made[n].select(F.lit(n).alias("name"), F.col(key).cast("string").alias("id"), F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in own]).alias("detail")) for n, (key, own) in detail.items()]
    return functools.reduce(DataFrame.unionByName, parts)


query(
    "s6_differences",
    """select coalesce(e, f) as k, case when f is null then 'missing' else 'extra' end as state from
    (select distinct r_regionkey + 100 as e from region union all select distinct n_nationkey from nation where n_nationkey <> 3) x full join (select distinct c_nationkey as f from customer) on e = f where e is null or f is null""",
)(
    lambda t: files.differences(
        t.customer.select(F.col("c_nationkey").alias("k")), t.nation.where("n_nationkey <> 3").select(F.col("n_nationkey").alias("k")).unionByName(t.region.select((F.col("r_regionkey") + 100).alias("k"))), "k"
    )
)
query(
    "q12_allowed_values",
    """with b as (select o_orderpriority as v, count(*) as n from orders where o_orderpriority not in ('1-URGENT', '2-HIGH') group by 1)
    select 'allowed_values' as rule, 'o_orderpriority' as "column", cast(sum(n) as double) as found, (select string_agg(v, ', ' order by v) from (select v from b order by v limit 10)) as detail from b having sum(n) > 0""",
)(lambda t: quality.contract_violations(t.orders, quality.Contract(allowed_values={"o_orderpriority": ("1-URGENT", "2-HIGH")})))
