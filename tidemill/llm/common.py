"""What the corpus operators share: shared scratch tables, row keys, checked
broadcasts and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules, for Spark's regular expressions.
SPACE = r"[ \t\n\x0B\f\r]"

_own_scratch: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where the session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="tidemill-"))
    return _own_scratch[0]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: the lineage is cut,
    and a lost executor costs a reread instead of a recomputation."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(text_col: str = "text", id_col: str = "doc_id"):
    """A key of a document's id and text.  Repeated rows share it, and so share their verdicts.

    It has 64 bits: joins that decide on documents compare their ids as well (see without())."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.length(text_col), F.lit(-1)), F.col(text_col))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where df has such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, gone: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without those whose key and id are in gone(key, id)."""
    key, gone_key, gone_id = fresh(docs, "key", "gone_key", "gone_id")
    gone = checked(gone.select(F.col("key").alias(gone_key), F.col(id_col).alias(gone_id)))
    keyed = docs.withColumn(key, row_key(text_col, id_col))
    return keyed.join(gone, (F.col(key) == F.col(gone_key)) & F.col(id_col).eqNullSafe(F.col(gone_id)), "left_anti").drop(key)


#: Most rows of a key list that is broadcast: 16 MB as longs.
BROADCAST_ROWS = 1_000_000


def checked(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a narrow table if it has at most `rows` rows, counted first; else Spark shuffles."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def share(spark: SparkSession, thing):
    """Broadcast an object of this subpackage as bytes: workers need no copy of the repository.
    Call pickle.loads(shared.value) once a task.  Only for things of a proven size."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a, b); root is the smallest node of its component.

    Alternating large-star and small-star rounds.  A round moves each edge once, and hubs are
    joined against one row a node, so that a skewed join can be split.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    e, before = stage(e.distinct(), "edges"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo")))
        e = stage(small.where("hi <> lo").distinct(), "edges")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
