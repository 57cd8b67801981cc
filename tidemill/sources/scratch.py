"""Tables between steps, in the folder that the whole cluster sees."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_space: contextvars.ContextVar[str | None] = contextvars.ContextVar("space", default=None)


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """A folder for all tables between steps that are written within; it goes at the end, when the results
    have been written elsewhere.  Without one they stay until the shared folder is cleared."""
    path = scratch_path(spark)
    token = _space.set(path)
    try:
        yield path
    finally:
        _space.reset(token)
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; without one, only a local session may have its own."""
    shared = _space.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="tidemill-")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df, written and read again: what is read twice is computed once, and a lost executor changes nothing."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
