"""Hard negatives by a secondary sort.

Blocks of anchors meet blocks of rows (a stated query set against all rows).  A block pair passes on,
for each anchor, its first positives, and in a second round, when the windows are known, the first
negatives of each window; nothing else can be among the results.  Scores are packed into keys
(anchor, descending score, kind, id), dealt by anchor and sorted within partitions; an iterator runs
over the sorted rows, opens a window at each positive and emits the negatives behind it.  It holds the
open windows of one anchor and never its rows.

Rows with a null label, a null vector or a component that is null or not finite take no part.  A row
without an id takes part behind all others of its score, and is a null in the result (as is an id of
2^63 - 1).  Rows that repeat id, label and vector are one row; rows that share only an id are rows of
their own, and an anchor's other rows are all but itself.  Only vectors of one length meet; empty ones
score 0.  Labels and ids are integers.  Scores are exact, and beyond 64 bits an error.  An anchor
without positives, or a window without negatives, gives no rows, and so does an empty table.  Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, stage

#: Rows of a block (for 64 components: 1 MB), fewer for longer vectors.
BLOCK = 4096
#: Components of a block at most, and scores that a task holds at once.
WIDE, AT_ONCE = 1 << 20, 1 << 20
NO_ID = 2**63 - 1

KEYS = "anchor_id long, mark long, down long, kind int, id long"


def usable(vec: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vec.isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def rows_of(emb: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, vec, mark) of the rows that take part, each once; mark tells rows of one id apart."""
    kind = "array<float>" if emb.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    vec = F.col(vec_col).cast(kind)
    found = emb.where(usable(vec) & F.col(label_col).isNotNull())
    found = found.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec")).distinct()
    return found.withColumn("mark", F.xxhash64("label", "vec")).withColumn("dim", F.size("vec"))


def blocks(rows: DataFrame, n: int, width: int, name: str, more: tuple[str, ...] = ()) -> DataFrame:
    """rows (of a vector length each) in blocks (dim, name, ids, labels, marks, vecs, more ...)."""
    size = max(64, min(BLOCK, WIDE // max(1, width)))
    parts = max(1, -(-n // size))
    dealt = rows.withColumn(name, F.expr(f"cast(pmod(xxhash64(id, mark, 5), {parts}) as int)")).groupBy("dim", name).agg(F.collect_list(F.struct("id", "label", "mark", "vec", *more)).alias("all"))
    pick = lambda c: F.transform("all", lambda x: x[c]).alias(f"{c}s")
    return dealt.select("dim", name, pick("id"), pick("label"), pick("mark"), F.flatten(F.transform("all", lambda x: x["vec"])).alias("vecs"), *[pick(c) for c in more])


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * x.astype(np.float64))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, in a type in which they times len(b) are exact too."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53 and most * 4 * len(b) < 2**62:
        return (a @ b.T).astype(np.int64)
    exact = lambda m: [[int(v) for v in r] for r in m.tolist()]
    theirs = exact(b)
    return np.array([[sum(map(int.__mul__, r, s)) for s in theirs] for r in exact(a)], dtype=object).reshape(len(a), len(b))


def first(s: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first k of each row under the mask: higher scores first, then lower columns."""
    n = s.shape[1]
    packed = s * n + (n - 1 - np.arange(n))
    low = int(packed.min(initial=0)) - 1
    packed = np.where(mask, packed, low)
    top = -np.partition(-packed, min(k, n) - 1, axis=1)[:, : min(k, n)]
    row, at = np.nonzero(top != low)
    return row, (n - 1 - top[row, at] % n).astype(np.int64)


def keyed(ids, marks, s, row, column, other, kind: int) -> pa.RecordBatch:
    score = s[row, column]
    if s.dtype == object and any(abs(int(x)) >= 2**63 for x in score):
        raise ArithmeticError("a score passes 64 bits")
    out = [ids[row], marks[row], -score.astype(np.int64), np.full(len(row), kind, np.int32), other[column]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], [c.split(" ")[0] for c in KEYS.split(", ")])


def in_pairs(anchors: DataFrame, rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of blocks of one vector length, dealt evenly."""
    pairs = anchors.select("dim", "part").join(rows.select("dim", "block"), "dim")
    named = anchors.select("dim", "part", *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "marks", "vecs", *more)])
    n = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.join(named, ["dim", "part"]).join(rows, ["dim", "block"]).repartition(n, "dim", "part", "block").select("dim", *[f"a_{c}" for c in ("ids", "labels", "marks", "vecs", *more)], "ids", "labels", "marks", "vecs")


def scored(batch: pa.RecordBatch, scale: int, more: int = 0) -> Iterator[tuple]:
    """Slices of the block pairs of a batch: what anchors and rows have, their scores, and the anchors' further lists."""
    for i in range(batch.num_rows):
        dim = batch.column(0)[i].as_py()
        values = [c[i].values for c in batch.columns[1:]]
        ids, labels, marks, vecs = (np.asarray(v) for v in values[:4])
        extra = [v.to_pylist() for v in values[4 : 4 + more]]
        other, kinds, signs, theirs = (np.asarray(v) for v in values[4 + more :])
        order = np.lexsort((signs, other))  # by id, so that lower columns are smaller ids
        other, kinds, signs = other[order], kinds[order], signs[order]
        a, b = whole_numbers(vecs.reshape(len(ids), dim), scale), whole_numbers(theirs.reshape(len(order), dim)[order], scale)
        step = max(1, AT_ONCE // max(1, len(other)))
        for k in range(0, len(ids), step):
            cut = slice(k, k + step)
            same = labels[cut, None] == kinds[None, :]
            itself = (ids[cut, None] == other[None, :]) & (marks[cut, None] == signs[None, :])
            yield ids[cut], marks[cut], other, same, itself, scores(a[cut], b), [x[cut] for x in extra]


def sorted_by_anchor(keys: DataFrame) -> DataFrame:
    return keys.repartition("anchor_id", "mark").sortWithinPartitions("anchor_id", "mark", "down", "kind", "id")


def first_positives(keys: DataFrame, k: int) -> DataFrame:
    """The first k keys of each anchor, by a pass over the sorted rows."""

    def run(batches):
        own, n = None, 0
        for b in batches:
            keep = []
            for i, anchor in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                own, n = anchor, (n + 1 if anchor == own else 1)
                if n <= k:
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    return sorted_by_anchor(keys).mapInArrow(run, KEYS)


def windows(keys: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """Of rows sorted by anchor, those that the windows of the positives before them take."""

    def run(batches):
        own, opened = None, []  # (positive's id, its score, rows taken)
        for b in batches:
            out = []
            for anchor, mark, down, kind, i in zip(*(c.to_pylist() for c in b.columns)):
                if (anchor, mark) != own:
                    own, opened = (anchor, mark), []
                if kind == 0:
                    opened.append([i, -down, 0])
                    continue
                shut = False
                for w in opened:
                    if low * w[1] > -100 * down:
                        w[2], shut = k, True
                    elif w[2] < k and -100 * down <= high * w[1]:
                        w[2] += 1
                        shut = shut or w[2] == k
                        out.append((anchor, w[0], w[2], i, w[1], -down))
                if shut:
                    opened = [w for w in opened if w[2] < k]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return sorted_by_anchor(keys).mapInArrow(run, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def hard_negatives(emb: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a
    condition on `id`) and each of its first `positives` rows of the same label, the first `negatives`
    rows of other labels whose score is `low` to `high` per cent of the positive's.

    Components are floor(scale * x); higher scores come first, then smaller ids.
    """
    rows = stage(rows_of(emb, id_col, vec_col, label_col), "vectors")
    asked = rows.where(anchors & (F.col("id") != NO_ID))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    n_asked = asked.count()
    held = stage(blocks(rows, n, width, "block"), "blocks")

    def best(batches):
        for batch in batches:
            for ids, marks, other, same, itself, s, _ in scored(batch, scale):
                yield keyed(ids, marks, s, *first(s, same & ~itself, positives), other, 0)

    near = stage(first_positives(in_pairs(blocks(asked, n_asked, width, "part"), held).mapInArrow(best, KEYS), positives), "positives")
    # At most `positives` scores an anchor.
    known = near.groupBy(F.col("anchor_id").alias("id"), "mark").agg(F.collect_list(-F.col("down")).alias("window"))
    asked = asked.join(known, ["id", "mark"])

    def behind(batches):
        for batch in batches:
            for ids, marks, other, same, _, s, (mine,) in scored(batch, scale, 1):
                found = []
                for j in range(max(map(len, mine), default=0)):
                    p = np.array([w[j] if j < len(w) else None for w in mine], dtype=object)
                    has = np.array([x is not None for x in p])
                    p = np.where(has, p, 0).astype(s.dtype)[:, None]
                    row, column = first(s, ~same & has[:, None] & (100 * s <= high * p) & (100 * s >= low * p), negatives)
                    found.append(row * len(other) + column)
                at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
                yield keyed(ids, marks, s, at // len(other), at % len(other), other, 1)

    taken = in_pairs(blocks(asked, n_asked, width, "part", ("window",)), held, ("windows",)).mapInArrow(behind, KEYS)
    out = windows(near.unionByName(taken), negatives, low, high)
    return out.withColumns({c: F.when(F.col(c) != NO_ID, F.col(c)) for c in ("positive_id", "negative_id")})


def op11(spark, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    emb = emb.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(emb, F.col("id") % 100 == 0)
