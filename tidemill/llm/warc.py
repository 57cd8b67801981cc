"""Merkle fixity audit of WARC replicas.

A record's digest, id and length are its fixity.  An archive's records lie in leaf ranges by the hash
of their ids, in the order of hash, id and digest; a leaf's hash covers its records with their offsets
within the range.  FANOUT neighbouring ranges are hashed into a node with the offsets of its children,
these again, up to one root.  The ranges' borders are hash values, so a lost record changes its own leaf
and that leaf's ancestors alone.  Two replicas are compared at the roots; only below nodes that differ
are the children compared, level by level, down to the damaged leaves, whose records are then compared.

Ids are bytes of any kind; a null id is an id of its own.  Equal records (repeated rows) are one record
with a count.  Ids with more than HOT records are dealt by their digests too, so no leaf gathers more
than a few records.  Among damaged records of equal ids the k-th of one replica, by digest, is paired
with the k-th of the other: such a pair is corrupt, what is left over missing or extra.

A null payload is a record of its own kind.  Empty archives agree with each other.  All steps are
DataFrame operations.  Further columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked, read, stage

#: Children of a node (4 bits of the hash), and records of a leaf, as an average.
FANOUT, LEAF = 16, 8
#: Records of an id beyond which its records are dealt by their digests.
HOT = 64


def page_records(pages: DataFrame) -> DataFrame:
    """(record_id, payload): a WARC response record for each page."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    payload = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), text("url"),
        F.lit("\r\nContent-Length: "), F.octet_length(text("html")).cast("string"), F.lit("\r\n\r\n"), text("html"), F.lit("\r\n\r\n"),
    )
    return pages.select(F.col("page_id").alias("record_id"), payload.alias("payload"))


def fixity(records: DataFrame) -> DataFrame:
    """(record_id, digest, length, copies) of the records of an archive: all that an audit needs of it."""
    digest = F.sha2(F.coalesce(F.col("payload").cast("binary"), F.lit("null").cast("binary")), 256)
    length = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")
    return records.select("record_id", digest.alias("digest"), length.alias("length")).groupBy("record_id", "digest", "length").agg(F.count("*").alias("copies"))


def ranged(ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The two archives with each record's hash h and leaf, and the depth of the leaves; the borders are common to both."""
    counts = ours.unionByName(theirs).groupBy("record_id").count()
    n = max(1, ours.count(), theirs.count())
    depth = min(15, max(0, math.ceil(math.log(n / LEAF, FANOUT)))) if n > LEAF else 0
    hot = stage(counts.where(F.col("count") > 2 * HOT).select(F.col("record_id").alias("hot_id")), "hot")  # one id in 2 * HOT records at most

    def dealt(archive: DataFrame) -> DataFrame:
        out = archive.join(checked(hot.withColumn("hot", F.lit(True))), F.col("record_id").eqNullSafe(F.col("hot_id")), "left")
        h = F.xxhash64(F.coalesce(F.col("record_id").cast("string"), F.lit("")), F.col("record_id").isNull(), F.when(F.col("hot"), F.col("digest")).otherwise(""))
        leaf = F.shiftrightunsigned("h", 64 - 4 * depth) if depth else F.lit(0).cast("long")
        return out.withColumn("h", h).withColumn("leaf", leaf).drop("hot", "hot_id")

    return dealt(ours), dealt(theirs), depth


def leaves(archive: DataFrame) -> DataFrame:
    """(node, bytes, hash) of an archive's leaf ranges; a leaf has few records, whatever the archive's size."""
    own = F.struct("h", F.coalesce(F.col("record_id").cast("string"), F.lit("")).alias("id"), F.col("record_id").isNull().alias("none"), "digest", "length", "copies")
    out = archive.groupBy(F.col("leaf").alias("node")).agg(F.array_sort(F.collect_list(own)).alias("r"))
    # Each record with its first offset in the range.
    lines = F.expr("aggregate(r, named_struct('at', 0L, 'x', cast(array() as array<string>)), (a, x) -> named_struct('at', a.at + x.length * x.copies, 'x', array_append(a.x, concat_ws(':', a.at, x.length, x.copies, x.none, x.digest, x.id))))")
    return out.withColumn("a", lines).select("node", F.col("a.at").alias("bytes"), F.sha2(F.array_join("a.x", "\n"), 256).alias("hash"))


def parents(nodes: DataFrame) -> DataFrame:
    """The level above nodes(node, bytes, hash)."""
    up = nodes.groupBy(F.shiftright("node", 4).alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "bytes", "hash"))).alias("c"))  # of FANOUT at most
    lines = F.expr("aggregate(c, named_struct('at', 0L, 'x', cast(array() as array<string>)), (a, x) -> named_struct('at', a.at + x.bytes, 'x', array_append(a.x, concat_ws(':', x.node & 15, a.at, a.at + x.bytes, x.hash))))")
    return up.withColumn("a", lines).select("node", F.col("a.at").alias("bytes"), F.sha2(F.array_join("a.x", "\n"), 256).alias("hash"))


def tree(archive: DataFrame, depth: int) -> list[DataFrame]:
    """The levels of an archive's tree, leaves first; the last has the root (no row if the archive is empty)."""
    levels = [stage(leaves(archive), "nodes")]
    for _ in range(depth):
        levels.append(stage(parents(levels[-1]), "nodes"))
    return levels


def differing(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(node) of the leaves that differ, found from the root down: below nodes that agree nothing is compared."""
    open_ = None
    for a, b in zip(reversed(ours), reversed(theirs)):
        a, b = a.select("node", F.col("hash").alias("ha")), b.select("node", F.col("hash").alias("hb"))
        if open_ is not None:
            below = checked(open_.select(F.col("node").alias("up")))
            a, b = (x.join(below, F.shiftright("node", 4) == F.col("up"), "left_semi") for x in (a, b))
        open_ = stage(a.join(b, "node", "full").where("not (ha <=> hb)").select("node"), "differing")
    return open_


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The damaged records of two archives given by fixity(): (record_id, length, status, digest, replica_digest)."""
    ours, theirs, depth = ranged(ours, theirs)
    bad = checked(differing(tree(ours, depth), tree(theirs, depth)).withColumnRenamed("node", "leaf"))
    sign = lambda x, k: x.join(bad, "leaf", "left_semi").select("record_id", "digest", "length", (F.col("copies") * k).alias("more"))
    left = sign(ours, 1).unionByName(sign(theirs, -1)).groupBy("record_id", "digest", "length").agg(F.sum("more").alias("more")).where("more <> 0")
    each = stage(left.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("more")))), "damaged")
    # Damaged records only: a window over those of an id in one replica.
    each = each.withColumn("k", F.row_number().over(Window.partitionBy("record_id", F.col("more") > 0).orderBy("digest", "length", "i")))
    a = each.where("more > 0").select("record_id", "length", "digest", "k")
    b = each.where("more < 0").select(F.col("record_id").alias("rid"), F.col("length").alias("rlength"), F.col("digest").alias("replica_digest"), F.col("k").alias("rk"))
    joined = a.join(b, F.col("record_id").eqNullSafe(F.col("rid")) & (F.col("k") == F.col("rk")), "full")
    status = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("corrupt")
    return joined.select(F.coalesce("record_id", "rid").alias("record_id"), F.coalesce("length", "rlength").alias("length"), status.alias("status"), "digest", "replica_digest")


_HEADER = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)
_START = re.compile(rb"WARC/1\.[01]\r\n")


def unpacked(data: bytes) -> list[tuple[bytes, bytes]]:
    """(bytes, packed rest) of the members of a gzip file, one after the other.  Where a member is damaged or cut
    off, what it gave so far comes with the packed bytes that could not be read, up to the next member that can."""
    out, at = [], 0
    while at < len(data):
        packed, got = zlib.decompressobj(31), b""
        try:
            for i in range(at, len(data), 1 << 16):
                got += packed.decompress(data[i : i + (1 << 16)])
                if packed.eof:
                    break
        except zlib.error:
            pass
        if packed.eof:
            end = min(i + (1 << 16), len(data)) - len(packed.unused_data)
            out.append((got, b""))
        else:
            end = at + 1
            while 0 <= (end := data.find(b"\x1f\x8b\x08", end)) and not _opens(data, end):
                end += 1
            end = len(data) if end < 0 else end
            out.append((got, data[at:end]))
        at = end
    return out


def _opens(data: bytes, at: int) -> bool:
    """Whether a member that begins a record starts here."""
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 4096], 16)[:5] == b"WARC/"
    except zlib.error:
        return False


def records_of(data: bytes) -> list[tuple[int, str | None, bytes]]:
    """(offset, id, bytes) of the records; bytes that belong to none are reported with no id, and reading goes on
    at the next header.  A record whose length is missing, or leads neither to the empty line behind
    a record nor to a header or the end, ends at the next header."""
    out, at = [], 0
    while at < len(data):
        m = _HEADER.match(data, at)
        if m:
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in m[1].split(b"\r\n"))}
            size = fields.get(b"content-length", b"")
            end = m.end() + int(size) + 4 if size.isdigit() and len(size) < 16 else -1
            if not (0 <= end <= len(data)) or end < len(data) and not _START.match(data, end) and data[end - 4 : end] != b"\r\n\r\n":
                after = _START.search(data, m.end())
                end = after.start() if after else len(data)
            out.append((at, fields.get(b"warc-record-id", b"").decode("utf-8", "replace"), data[at:end]))
        else:
            after = _START.search(data, at + 1)
            end = after.start() if after else len(data)
            out.append((at, None, data[at:end]))
        at = end
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, record_id, payload) of the records of WARC files (.warc or .warc.gz, of at most 2 GB each).

    Offsets count unpacked bytes.  Rows without an id are gaps: bytes of no record, and the packed bytes of
    gzip members that can't be unpacked.  Damage never ends the reading.  A file is one task's."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, plain, rows = 0, b"", []
                for got, rest in unpacked(content) if content[:2] == b"\x1f\x8b" else [(content, b"")]:
                    plain += got
                    if rest:  # what has been read so far, then the gap
                        rows += [(at + o, i, p) for o, i, p in records_of(plain)]
                        at, plain = at + len(plain), b""
                        rows.append((at, None, rest))
                rows += [(at + o, i, p) for o, i, p in records_of(plain)]
                cols = [[name] * len(rows), *([list(c) for c in zip(*rows)] or [[], [], []])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.binary()))], ["path", "offset", "record_id", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, offset long, record_id string, payload binary")


def op8(spark, sf_dir: str) -> DataFrame:
    """Audit of a replica of the pages' records in which every page whose id is divisible by 97 has
    its first tag damaged, and those with remainder 5 of 389 are lost."""
    records = page_records(read(spark, sf_dir, "pages"))
    damaged = F.when(F.col("record_id") % 97 == 0, F.regexp_replace("payload", "<html", "<hTml")).otherwise(F.col("payload"))
    copy = records.select("record_id", damaged.alias("payload")).where("not (record_id % 389 = 5)")
    found = audit(stage(fixity(records), "archive"), stage(fixity(copy), "replica"))
    return found.select(F.col("record_id").alias("page_id"), "length", "status", "digest", "replica_digest")


OP8_SQL = """
with r as (
  select page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as payload
  from pages),
d as (
  select page_id, payload, sha256(payload) as digest,
    case when page_id % 389 = 5 then null when page_id % 97 = 0 then sha256(replace(payload, '<html', '<hTml')) else sha256(payload) end as replica_digest
  from r)
select page_id, cast(strlen(payload) as bigint) as length, case when replica_digest is null then 'missing' else 'corrupt' end as status, digest, replica_digest
from d where digest is distinct from replica_digest
"""
