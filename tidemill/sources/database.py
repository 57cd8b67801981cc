"""Tables of a SQLite database: a file in a folder that the driver and all executors share.

Tasks write to the file and read from it themselves.  It takes one writer at a time, so writing tasks wait for
one another: each adds its rows in one transaction and notes itself in it, so that a task that runs again
adds nothing twice.  A load is whole: a new table gets its name when all tasks have written, and what
a failed load has appended goes.
"""

from __future__ import annotations

import contextlib
import sqlite3
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .snapshots import file_system

PREFIX = "sqlite:"
#: Seconds that a writer waits for the others.
_WAIT = 6 * 3600
_LOADS = "create table if not exists _loads (load text, part integer, n integer, low integer, high integer, primary key (load, part))"
#: Spark's types by what SQLite declares where its own name would be taken for a number, and those that are kept as text.
_DECLARED = {"string": "text", "decimal": "decimal text"}
_TEXT = ("decimal", "date", "timestamp_ntz")
_PLAIN = {"tinyint": "long", "smallint": "long", "int": "long", "bigint": "long", "boolean": "long", "timestamp": "long", "float": "double", "double": "double", "binary": "binary", "string": "string", **dict.fromkeys(_TEXT, "string")}
_ARROW = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}


def database_url(spark: SparkSession, folder: str) -> str:
    """A database in a folder, which is made; it must be a mounted one."""
    fs, p = file_system(spark, folder)
    fs.mkdirs(p)
    uri = fs.resolvePath(p).toUri()
    if uri.getScheme() != "file":
        raise ValueError(f"{folder} is on {uri.getScheme()}, and a database file needs a mounted folder")
    return f"{PREFIX}{uri.getPath()}/tables.db"


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@contextlib.contextmanager
def _open(path: str) -> Iterator[sqlite3.Connection]:
    db = sqlite3.connect(path, timeout=_WAIT, isolation_level=None)
    try:
        yield db
    finally:
        db.close()  # what isn't committed goes


def _kind(ddl: str) -> str:
    return ddl.partition("(")[0]


def _declared(t: DataType) -> str:
    kind = _kind(t.simpleString())
    if kind not in _PLAIN:
        raise TypeError(f"a database column can't hold {t.simpleString()}")
    return t.simpleString().replace(kind, _DECLARED.get(kind, kind))


def _columns(db: sqlite3.Connection, table: str) -> dict[str, str]:
    """Declared types by column; nothing if there is no such table."""
    return {r[1]: r[2].lower() for r in db.execute(f"pragma table_info({_quoted(table)})")}


def _stored(c: str, t: DataType) -> Column:
    kind, v = _kind(t.simpleString()), F.col(_ticked(c))
    if kind == "timestamp":
        v = F.unix_micros(v)
    elif _PLAIN[kind] == "double":
        v = F.when(F.isnan(v), F.raise_error(F.lit(f"{c}: the database holds no NaN"))).otherwise(v)
    return v.cast(_PLAIN[kind]).alias(c)


def _ticked(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def load(df: DataFrame, path: str, table: str, mode: str, batch: int) -> int:
    """Append, replace or (mode fail) make a table; returns the number of rows.  An empty frame changes nothing."""
    key, types = uuid.uuid4().hex, {f.name: _declared(f.dataType) for f in df.schema}
    with _open(path) as db:
        db.execute(_LOADS)
        there = _columns(db, table)
        if there and mode == "fail":
            raise ValueError(f"table {table} already exists")
        added = bool(there) and mode == "append"
        if added and there != types:
            raise ValueError(f"table {table} has columns {there}, not {types}")
        target = table if added else f"{table}__{key}"
        if not added:
            db.execute(f"create table {_quoted(target)} ({', '.join(f'{_quoted(c)} {t}' for c, t in types.items())})")
        db.execute("insert into _loads values (?, -1, 0, null, null)", (key,))  # the load is open
    own = df.select(*[_stored(f.name, f.dataType) for f in df.schema])
    try:
        own.mapInArrow(_writer(path, target, list(types), key, batch), "n long").write.format("noop").mode("overwrite").save()
        with _open(path) as db:
            db.execute("begin immediate")
            n = db.execute("select sum(n) from _loads where load = ?", (key,)).fetchone()[0]
            if not added and n:
                if mode == "replace":
                    db.execute(f"drop table if exists {_quoted(table)}")
                db.execute(f"alter table {_quoted(target)} rename to {_quoted(table)}")
            elif not added:
                db.execute(f"drop table {_quoted(target)}")
            db.execute("delete from _loads where load = ?", (key,))
            db.execute("commit")
        return n
    except BaseException:
        with _open(path) as db:
            db.execute("begin immediate")
            ranges = db.execute("select low, high from _loads where load = ? and part >= 0", (key,)).fetchall()
            if added:
                db.executemany(f"delete from {_quoted(target)} where rowid between ? and ?", ranges)
            else:
                db.execute(f"drop table if exists {_quoted(target)}")
            db.execute("delete from _loads where load = ?", (key,))
            db.execute("commit")
        raise


def _values(c: pa.Array) -> list:
    """A column as Python's values; by numpy, many times faster, where none is missing."""
    return c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist()


def _writer(path: str, table: str, columns: list[str], key: str, batch: int):
    insert = f"insert into {_quoted(table)} ({', '.join(map(_quoted, columns))}) values ({', '.join('?' * len(columns))})"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, first = TaskContext.get().partitionId(), 0, next(batches, None)
        if first is None:
            return
        with _open(path) as db:
            db.execute("begin immediate")
            last = db.execute(f"select max(rowid) from {_quoted(table)}").fetchone()[0] or 0
            # Nothing is noted, and nothing written, if this part has been written before or the load is over.
            if not db.execute("insert or ignore into _loads select ?, ?, 0, null, null where exists (select * from _loads where load = ? and part = -1)", (key, part, key)).rowcount:
                return
            while first is not None:
                for k in range(0, first.num_rows, batch):
                    db.executemany(insert, zip(*map(_values, first.slice(k, batch).columns)))
                n, first = n + first.num_rows, next(batches, None)
            db.execute("update _loads set n = ?, low = ?, high = ? where load = ? and part = ?", (n, last + 1, last + n, key, part))
            db.execute("commit")
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return write


def read(spark: SparkSession, path: str, table: str, split_by: str | None, parts: int) -> DataFrame:
    """A table, read by `parts` tasks with a range each of a whole-number column, or of the row's number in the table."""
    c = _quoted(split_by) if split_by else "rowid"
    with _open(path) as db:
        columns = _columns(db, table)
        if not columns:
            raise ValueError(f"no table {table}")
        if split_by and split_by not in columns:
            raise ValueError(f"table {table} has no column {split_by}")
        low, high = (db.execute(f"select {f}({c}) from {_quoted(table)}").fetchone()[0] for f in ("min", "max"))
    if low is None:
        low = high = 0
    if not isinstance(low, int) or not isinstance(high, int):
        raise TypeError(f"{split_by} holds other values than whole numbers")
    types = {n: "string" if t == "text" else t.replace("decimal text", "decimal") for n, t in columns.items()}
    plain = {n: _PLAIN[_kind(t)] for n, t in types.items()}
    found = spark.range(0, parts, 1, parts).mapInArrow(_reader(path, table, plain, c, low, high, parts), ", ".join(f"{_ticked(n)} {t}" for n, t in plain.items()))
    return found.select(*[(F.timestamp_micros(F.col(_ticked(n))) if t == "timestamp" else F.col(_ticked(n)).cast(t)).alias(n) for n, t in types.items()])


def _reader(path: str, table: str, plain: dict[str, str], c: str, low: int, high: int, parts: int):
    edge = lambda k: low + (high - low + 1) * k // parts
    select, types = f"select {', '.join(map(_quoted, plain))} from {_quoted(table)} where {c} >= ? and {c} < ?", [_ARROW[t] for t in plain.values()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            with _open(path) as db:
                # Rows without a value go with the first range.
                found = db.execute(select + (f" or {c} is null" if k == 0 else ""), (edge(k), edge(k + 1)))
                while some := found.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*some), types)], names=list(plain))

    return rows
