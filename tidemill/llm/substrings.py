"""Repeated substrings: every byte covered by a LENGTH-byte string that also starts elsewhere.

A full suffix array of a corpus would shuffle every position.  Only positions near shared anchors
can repeat, so the suffixes are sorted there alone:

1. Anchors.  In each window of LENGTH - GRAM + 1 starts the GRAM-byte string with the least hash is
   an anchor, so equal LENGTH-byte strings hold equal anchors at equal offsets (about 1 position in
   80 is one).  An anchor's context is all that LENGTH-byte strings around it can hold.
2. Contexts that occur twice or more are repeats as a whole.  Of each distinct context one copy goes
   on, and only if the anchor has other contexts too.  Copies are gathered within a batch first.
3. Suffix order.  Around an anchor, the suffixes that start `l` bytes before it are those with equal
   `l` bytes to the left, in the order of what follows the anchor.  Both orders are sorted once, with
   the lengths that neighbours share; each l then gives the runs of suffixes that agree in LENGTH
   bytes.  In that order the previous and next smaller positions of a suffix give its longest
   previous factor, the next and previous larger ones its longest next factor (lengths are cut at
   LENGTH; those below it count as none).  With keep="first" a start goes if its previous factor
   reaches LENGTH; with keep="none" if either does.

No task gathers an anchor beyond GROUP contexts.  Anchors with more copies are counted first; in the
window they are salted by their contexts, and contexts with more copies by these.  Contexts that are
still too many for a task are parted by the string that a quarter of the values of l shares, then by a
quarter of these, until a group is small; at each step those that agree in all that the values of l can
reach are repeats, and one of them goes on.

Contexts of the first two steps, and the parts of large anchors, are told apart by two 64-bit hashes,
suffixes by their bytes.  A document is named by a 64-bit hash of its id and text.

A null or empty text has no bytes.  Repeated rows are repeats of each other, and ties in the suffix
order are decided by id and position.  Texts shorter than LENGTH have no spans; very long ones are
read in segments.  An empty table gives an empty result.  Further columns are not looked at, so their
names may clash with nothing.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, read, row_key, stage

LENGTH, GRAM = 200, 40
#: Most contexts of an anchor that are gathered in one task: 3 MB.
GROUP = 8_192
#: Contexts of a bin of small groups, as an average.
BIN = 2_048
#: Contexts that are sorted at once, but for a larger group: some 20 MB with all orders.
CHUNK = 4_096
#: Bytes of a text from which anchors are sought at once.
SEGMENT = 1 << 20
#: Parts of the offsets when a large group is split.
PARTS = 4

_rng = np.random.default_rng(2)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(b: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] the hash of b[i:j] times the base to the i."""
    s = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * powers(len(b))[0], out=s[1:])
    return s


def sliding(x: np.ndarray, w: int, op, pad) -> np.ndarray:
    """op over each window of w values, by running values within blocks of w from both sides."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, pad, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - w + 1], ahead[w - 1 : n])


def anchors_within(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes of the grams, hashes of the contexts) of the anchors of at least `length` bytes."""
    n = len(b)
    s, (_, inverse) = prefix_hashes(b), powers(n)
    h = (s[gram:] - s[:-gram]) * inverse[: n - gram + 1] * np.uint64(0xD6E8FEB86659FD93)
    w = length - gram + 1
    least = sliding(h, w, np.minimum, np.uint64(2**64 - 1))
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), w, np.maximum, np.uint64(0)) == h)
    start, end = np.maximum(at - (length - gram), 0), np.minimum(at + length, n)
    ctx = (s[end] - s[start]) * inverse[start] + (at - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + (end - at).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
    return at, h[at], ctx * np.uint64(0x8EBC6AF09C88C6E3)


def anchors(b: np.ndarray, length: int = LENGTH, gram: int = GRAM, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes of the grams, hashes of the contexts) of a text's anchors.

    Segments overlap by all that an anchor and its context depend on.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for i in range(0, len(b) if len(b) >= length else 0, segment):
        low, high = max(0, i - 2 * length), min(len(b), i + segment + 2 * length)
        at, ah, ch = anchors_within(b[low:high], length, gram)
        own = (at + low >= i) & (at + low < i + segment)
        found.append((at[own] + low, ah[own], ch[own]))
    at, ah, ch = (np.concatenate(x) for x in zip(*found))
    return at, ah, ch


def smaller_before(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For suffixes in their order, with the lengths they share with the one before, the length shared
    with the nearest one before that has a smaller position; 0 if there is none."""
    before, low = np.arange(-1, len(position) - 1), shared.copy()
    at = np.flatnonzero((low > 0) & (before >= 0) & (position[before] > position))
    while len(at):  # jump to the candidate of the candidate: all between is larger; nothing shared ends it
        via = before[at]
        low[at], before[at] = np.minimum(low[at], low[via]), before[via]
        at = at[(low[at] > 0) & (before[at] >= 0) & (position[before[at]] > position[at])]
    return np.where(before >= 0, low, 0)


def factors(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix: the most that it shares with one at a smaller
    position, by the previous and next smaller positions in suffix order (shared[0] is 0)."""
    back = np.concatenate([[0], shared[:0:-1]]) if len(shared) else shared
    return np.maximum(smaller_before(position, shared), smaller_before(position[::-1], back)[::-1])


def ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows of bytes, bytes that each shares with the one before it in that order)."""
    width = rows.shape[1]
    by = np.argsort(np.ascontiguousarray(rows).view(f"V{width}").ravel(), kind="stable")
    shared, step = np.zeros(len(by), np.int32), 1024
    for i in range(1, len(by), step):
        differ = rows[by[i : i + step]] != rows[by[i - 1 : min(i + step, len(by)) - 1]]
        shared[i : i + step] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return by, shared


def repeated_starts(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray, left: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, first: bool, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For contexts in the order of their positions, whether the start l bytes before the anchor goes (contexts x l).

    Context i is flat[begin[i] : begin[i] + sizes[i]] with its anchor at left[i]; it meets those of
    its group, at the starts with l from low[i] to high[i].
    """
    n, span = len(sizes), length - gram
    gone = np.zeros((n, span + 1), bool)
    right = sizes - left
    name = np.ascontiguousarray(group.astype(">u4")).view(np.uint8).reshape(n, 4)

    def padded(at: np.ndarray, inside: np.ndarray) -> np.ndarray:
        own = flat[np.clip(at, 0, len(flat) - 1)]
        own[~inside] = 0
        return np.concatenate([name, own], axis=1)

    step = np.arange(length, dtype=np.int32)
    anchor = (begin + left).astype(np.int64)[:, None]
    by_right, right_shared = ordered(padded(anchor + step, step < right[:, None]))
    step = np.arange(span, dtype=np.int32)
    by_left, left_shared = ordered(padded(anchor - 1 - step, step < left[:, None]))
    # No start reaches beyond what a context shares with its neighbours in both orders.
    most = lambda by, shared: np.maximum(shared, np.concatenate([shared[1:], [0]]))[np.argsort(by, kind="stable")] - 4
    low, high = np.maximum(low, length - most(by_right, right_shared)), np.minimum(high, most(by_left, left_shared))
    left_class, right_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(int(max(0, low.min())), int(high.max()) + 1):
        at = np.flatnonzero((low <= l) & (l <= high) & (left >= l) & (right >= length - l))
        if len(at) < 2:
            continue
        left_class[by_left] = np.cumsum(left_shared < l + 4)
        right_class[by_right] = np.cumsum(right_shared < length - l + 4)
        code = left_class[at] * (n + 1) + right_class[at]
        by = np.argsort(code, kind="stable")  # ties stay in the order of positions
        same = code[by][1:] == code[by][:-1]
        twin = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        at = at[by[twin]]
        if not len(at):
            continue
        shared = np.where(np.concatenate([[False], same])[twin], length, 0)
        most = factors(at, shared)
        if not first:
            most = np.maximum(most, factors(-at, shared))
        gone[at[most >= length], l] = True
    return gone


def anchor_rows(source: DataFrame, first: bool, length: int, gram: int) -> DataFrame:
    """(ah, ch, copies of (id if first, key, pos)) from source(id, key, text), gathered within each batch."""

    def run(batches):
        for b in batches:
            parts, held = [], 0
            ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)

            def flush():
                ah, ch, row, pos = (np.concatenate(x) for x in zip(*parts))
                parts.clear()
                by = np.lexsort((pos, keys[row], ids[row], ch, ah))
                ah, ch, row, pos = ah[by], ch[by], row[by], pos[by]
                new = np.concatenate([[True], (ah[1:] != ah[:-1]) | (ch[1:] != ch[:-1])])
                offsets = pa.array(np.concatenate([np.flatnonzero(new), [len(ah)]]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (*([ids[row]] if first else []), keys[row], pos.astype(np.int32))]
                return pa.RecordBatch.from_arrays([pa.array(ah[new].view(np.int64)), pa.array(ch[new].view(np.int64)), *lists], ["ah", "ch", *(["ids"] if first else []), "keys", "poss"])

            for i, t in enumerate(b.column(2).cast(pa.binary())):
                t = t.as_py()
                at, ah, ch = anchors(np.frombuffer(t or b"", np.uint8), length, gram)
                if len(at):
                    parts.append((ah, ch, np.full(len(at), i), at))
                    held += len(at)
                if held > 1 << 20:
                    yield flush()
                    held = 0
            if parts:
                yield flush()

    return source.mapInArrow(run, f"ah long, ch long, {'ids array<bigint>, ' if first else ''}keys array<bigint>, poss array<int>")


def _place(first: bool):
    """The place of a row's first copy."""
    return F.struct(*([F.col("ids")[0].alias("id")] if first else []), F.col("keys")[0].alias("key"), F.col("poss")[0].alias("pos"))


def _met(rows: DataFrame, first: bool, group: int) -> tuple[DataFrame, DataFrame]:
    """(copies to remove as (key, pos), probes (ah, id if first, key, pos, need)) of anchor_rows()."""
    many = stage(rows.groupBy("ah").agg(F.sum(F.size("keys")).alias("n")).where(F.col("n") > group), "many")
    rows = rows.join(checked(many), "ah", "left").withColumn("least", _place(first))  # of all copies, one in `group` at most
    hot = F.col("n").isNotNull()
    whole = rows.groupBy(F.when(hot, F.col("ah")).alias("ah"), F.when(hot, F.col("ch")).alias("ch")).agg(F.sum(F.size("keys")).alias("n"), F.min("least").alias("whole"))
    rows = rows.join(checked(stage(whole.where((F.col("n") > group) & F.col("ah").isNotNull()).drop("n"), "whole")), ["ah", "ch"], "left")
    rows = rows.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("ch"), F.ceil(F.col("n") / group))).otherwise(0))
    rows = rows.withColumn("salt2", F.when(F.col("whole").isNotNull(), F.pmod(F.xxhash64("least.key", "least.pos"), F.ceil(F.col("n") / group))).otherwise(0))
    part = Window.partitionBy("ah", "salt", "salt2")
    by, same = part.orderBy("ch", "least"), lambda c: F.coalesce(c == F.col("ch"), F.lit(False))
    rows = rows.withColumns({"same_before": same(F.lag("ch").over(by)), "same_after": same(F.lead("ch").over(by)), "mixed": hot | (F.min("ch").over(part) != F.max("ch").over(part))})
    rows = rows.withColumn("twice", F.col("whole").isNotNull() | (F.size("keys") > 1) | F.col("same_before") | F.col("same_after"))
    rows = rows.withColumn("probe", F.when(F.col("whole").isNotNull(), F.col("least") == F.col("whole")).otherwise(F.col("mixed") & ~F.col("same_before")))
    rows = stage(rows.where("twice or probe").select("ah", *(["ids"] if first else []), "keys", "poss", "least", "whole", "twice", "probe", "same_before"), "anchors")
    names = {**({"id": "ids"} if first else {}), "key": "keys", "pos": "poss"}
    copies = rows.where("twice").select("same_before", "whole", F.posexplode(F.arrays_zip(*names.values())).alias("i", "c"))
    copies = copies.select("same_before", "whole", "i", F.struct(*[F.col(f"c.{old}").alias(new) for new, old in names.items()]).alias("c"))
    if first:  # all but the least copy
        copies = copies.where(F.when(F.col("whole").isNull(), F.expr("i > 0 or same_before")).otherwise(F.col("c") != F.col("whole")))
    return copies.select("c.key", "c.pos"), rows.where("probe").select("ah", "least.*", (F.lit(first) | ~F.col("twice")).alias("need"))


def _parted(work: DataFrame, first: bool, group: int, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts as (tables of groups of `group` contexts at most, tables of (key, s, e) found on the way)."""
    small, found, place, seen = [], [], F.struct("id", "key", "pos"), False
    while True:
        sizes = work.groupBy("g1", "g2").count()
        large = checked(stage(sizes.where(F.col("count") > group).select("g1", "g2"), "large"))
        small.append(work.join(large, ["g1", "g2"], "left_anti"))
        if large.isEmpty():
            return small, found
        work = work.join(large, ["g1", "g2"], "left_semi").where("low < high")
        if not seen:  # repeated rows fetch the same context again
            work, seen = work.dropDuplicates(["g1", "g2", "key", "pos"]), True
        step = f"cast(ceil((high - low + 1) / {PARTS}) as int)"
        work = work.withColumn("part", F.explode(F.expr(f"transform(sequence(0, {PARTS - 1}), i -> struct(low + i * {step} as low, least(high, low + (i + 1) * {step} - 1) as high))")))
        work = work.withColumns({"low": F.col("part.low"), "high": F.col("part.high")}).where(f"low <= high and lft >= low and octet_length(ctx) - lft >= {length} - high")
        shared = F.expr(f"substring(ctx, lft - low + 1, {length} + low - high)")
        work = work.withColumns({"g1": F.xxhash64("g1", "low", shared), "g2": F.xxhash64(F.lit(1), "g2", "low", shared)}).drop("part")
        # All that starts with l from low to high can reach.
        reach = f"substring(ctx, lft - least(lft, high) + 1, least(lft, high) + least(octet_length(ctx) - lft, {length} - low))"
        work = work.withColumns({"ctx": F.expr(reach), "lft": F.least("lft", "high")}).where(F.octet_length("ctx") >= length)
        work = stage(work.withColumns({"c1": F.xxhash64("g1", "lft", "ctx"), "c2": F.xxhash64(F.lit(2), "g2", "lft", "ctx")}), "parts")
        same = work.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min(place).alias("least")).where("n > 1").drop("n")
        work = stage(work.join(same, ["c1", "c2"], "left"), "parts")
        equal = work.where("least is not null")
        if first:
            equal = equal.where(place != F.col("least"))
        found.append(equal.select("key", (F.col("pos") - F.col("lft")).alias("s"), (F.col("pos") - F.col("lft") + F.octet_length("ctx")).alias("e")))
        work = work.where(F.col("least").isNull() | (place == F.col("least")))
        if not first:
            work = work.withColumn("need", F.col("need") & F.col("least").isNull())
        work = work.drop("c1", "c2", "least")


def spans(docs: DataFrame, keep: str = "none", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, spans) of the documents that lose bytes: spans is an array of (start, end), to be united.

    keep="none" removes all copies, keep="first" keeps the one with the smallest id and position.
    Ids must be integers (nulls sort first).
    """
    first = keep == "first"
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62))) if first else F.lit(0).cast("long")
    source = docs.select(number.alias("id"), row_key(text_col, id_col).alias("key"), F.col(text_col).alias("text"))
    rows = stage(anchor_rows(source.where(F.octet_length("text") >= length), first, length, gram), "rows")
    copies, probes = _met(rows, first, group)
    back, ahead = length - gram, length
    found = copies.select("key", (F.col("pos") - back).alias("s"), (F.col("pos") + ahead).alias("e"))
    fields = ["pos", "ah", "need", *(["id"] if first else [])]
    wanted = probes.groupBy("key").agg(F.collect_list(F.struct(*fields)).alias("probes"))  # a text's own anchors
    texts = source.select("key", "text").join(wanted, "key")

    def cut(batches):
        last = None
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for key, t, own in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2)):
                if key == last:  # a repeated row
                    continue
                last, t = key, t.as_py()
                for p in own.as_py():
                    lo = max(0, p["pos"] - back)
                    for x, v in zip(out, (p["ah"], p.get("id", 0), key, p["pos"], p["need"], p["pos"] - lo, t[lo : p["pos"] + ahead])):
                        x.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, types)], ["ah", "id", "key", "pos", "need", "lft", "ctx"])

    contexts = stage(texts.mapInArrow(cut, "ah long, id long, key long, pos int, need boolean, lft int, ctx binary"), "contexts")
    contexts = contexts.withColumns({"g1": F.col("ah"), "g2": F.lit(0).cast("long"), "low": F.lit(0), "high": F.lit(back)}).drop("ah")
    small, equal = _parted(contexts, first, group, length)
    bins = reduce(DataFrame.unionByName, small)
    found = reduce(DataFrame.unionByName, equal, found)

    def sort_bin(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        names = {c: t.column(c).to_numpy() for c in ("g1", "g2", "id", "key", "pos", "need", "lft", "low", "high")}
        by = np.lexsort((names["pos"], names["key"], names["id"], names["g2"], names["g1"]))
        names = {c: x[by] for c, x in names.items()}
        differ = lambda *cs: np.concatenate([[True], np.any([names[c][1:] != names[c][:-1] for c in cs], axis=0)])
        once = differ("g1", "g2", "key", "pos")
        by, group_ = by[once], (np.cumsum(differ("g1", "g2")) - 1)[once]
        names = {c: x[once] for c, x in names.items()}
        ctx = t.column("ctx").chunk(0)
        ends = np.frombuffer(ctx.buffers()[1], np.int32)[ctx.offset : ctx.offset + len(ctx) + 1].astype(np.int64)
        flat = np.frombuffer(ctx.buffers()[2] or b"\0", np.uint8)
        begin, sizes = ends[:-1][by], np.diff(ends)[by]
        # Whole groups, as many as fit a chunk.
        starts = np.flatnonzero(np.concatenate([[True], group_[1:] != group_[:-1]]))
        cuts = [0]
        for a, z in zip(starts, [*starts[1:], len(by)]):
            if z - cuts[-1] > CHUNK and a > cuts[-1]:
                cuts.append(int(a))
        out: list[list[np.ndarray]] = [[], [], []]
        for a, z in zip(cuts, [*cuts[1:], len(by)]):
            part = slice(a, z)
            # Positions order the suffixes of a group; groups never meet.
            gone = repeated_starts(flat, begin[part], sizes[part], names["lft"][part].astype(np.int64), group_[part], names["low"][part], names["high"][part], first, length, gram)
            gone[~names["need"][part]] = False
            edge = np.zeros((z - a, back + 3), np.int8)
            edge[:, 1:-1] = gone[:, ::-1]
            edge = np.diff(edge, axis=1)
            (row, s), (_, e) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            pos = names["pos"][part][row].astype(np.int64) - back
            for x, v in zip(out, (names["key"][part][row], pos + s, pos + e - 1 + length)):
                x.append(v)
        key, s, e = (np.concatenate(x) for x in out)
        return pa.table({"key": pa.array(key, pa.int64()), "s": pa.array(s.astype(np.int32)), "e": pa.array(e.astype(np.int32))})

    n = bins.count()
    if n:
        bins = bins.withColumn("bin", F.pmod(F.xxhash64("g1", "g2"), F.lit(-(-n // BIN))))
        found = found.unionByName(bins.groupBy("bin").applyInArrow(sort_bin, "key long, s int, e int"))
    # Repeated rows share a key and give the same spans again: each counts once.
    return found.groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def united(pairs: list[dict], n: int) -> list[tuple[int, int]]:
    """Sorted, disjoint, not touching intervals within 0 .. n."""
    out: list[list[int]] = []
    for s, e in sorted((max(0, p["s"]), min(n, p["e"])) for p in pairs or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def kept_bytes(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc id, n_bytes, removed spans, kept) for each row of docs; with digest, kept is the SHA-256 of the bytes."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(row_key(text_col, id_col).alias("key"), F.col(id_col), F.col(text_col).alias("text")).join(found, "key", "left")

    def run(batches):
        for b in batches:
            n, spans_, kept = [], [], []
            for t, pairs in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                t = t or b""
                cuts = united(pairs, len(t))
                at = [0, *(x for c in cuts for x in c), len(t)]
                rest = b"".join(t[i:j] for i, j in zip(at[::2], at[1::2]))
                n.append(len(t))
                spans_.append([{"s": s, "e": e} for s, e in cuts])
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
            span = pa.struct([("s", pa.int64()), ("e", pa.int64())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans_, pa.list_(span)), pa.array(kept, pa.string() if digest else pa.binary())], [id_col, "n_bytes", "removed", "kept"])

    return rows.select(id_col, "text", "spans").mapInArrow(run, f"{id_col} {kind}, n_bytes long, removed array<struct<s: bigint, e: bigint>>, kept {'string' if digest else 'binary'}")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = kept_bytes(docs, spans(docs), digest=True)
    removed = F.expr("aggregate(removed, 0L, (a, x) -> a + x.e - x.s)")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))
