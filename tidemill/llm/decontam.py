"""Benchmark decontamination by a prefix-filtered set join.

The benchmark's windows (ten consecutive words of an item, or a shorter item as a whole) are
the query sets; the documents are searched for windows contained in them in order.  A window's
tokens are its three-word shingles (all its words if it has fewer than three).  A first pass
counts, over all documents, the occurrences of the benchmark's shingles.  Containment asks for
all of a window's tokens, so the necessary prefix under the order by rarity is its rarest
token: a second pass takes the places of such tokens from the documents, with the words around
them, and joins them with the windows on the token alone.  The length bound leaves out texts
shorter than any window, the positional bound places with no room for the window around the
token; what is left is compared word by word.

Neither side is held whole: windows, counts and places are tables that Spark joins.  What a task
knows of the benchmark is a filter of bits (at most 16 MB) over hashes of its tokens, which lets
some other places through and never fewer; the words decide.

A null or empty text has no words: such a document is clean, such an item has no windows.  Items
without an id are one item, named by the empty string.  Items with equal words are found together; of
a window's equally rare shingles the first is its prefix.  Repeated rows get equal results.  Long texts
and items are taken in parts that overlap by a window.  Empty tables give no contamination, or an empty
result.  Further columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, row_key, share, stage, without
from .phrases import Words, bits_of, has, loaded

#: Words of a window.
WINDOW = 10
#: Words of a shingle.
SHINGLE = 3
#: Bytes of text that a task takes at once, and words of a part of a long text.
SLICE, PART = 1 << 20, 100_000
#: Bytes of a table up to which it is broadcast to a join.
BROADCAST_BYTES = 32_000_000

#: ASCII: upper case to lower, digits and lower case as they are, all else to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and other than ASCII characters."""
    return (text or b"").translate(_TABLE).split()


def in_slices(texts, window: int):
    """Slices of texts as (Words, first word of each part, parts' own words, number of each part's text), and
    finally the numbers of words of all texts."""
    parts, size, counts = [], 0, []

    def slice_():
        joined = [b" ".join(w) for _, _, _, w in parts]
        begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in joined])[:-1]])
        words = Words(np.frombuffer(b"\n".join(joined), np.uint8), begins, np.zeros(len(parts), np.uint64), False)
        return words, np.array([x[1] for x in parts]), np.array([x[2] for x in parts]), np.array([x[0] for x in parts])

    for i, t in enumerate(texts):
        w = words_of(t)
        counts.append(len(w))
        for k in range(0, len(w), PART):
            low = max(0, k - window)
            part = w[low : k + PART + window + SHINGLE]
            parts.append((i, low, (k, min(len(w), k + PART)), part))
            size += sum(map(len, part)) + len(part)
            if size >= SLICE:
                yield slice_()
                parts, size = [], 0
    if parts:
        yield slice_()
    yield np.array(counts, np.int64)


def places(words: Words, low: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word's place in the slice, place in its text) of all n-word tokens that parts own."""
    h = words.longer(0, n)
    row = words.row[: len(h)]
    first = np.searchsorted(words.row, np.arange(len(low)))
    at = np.arange(len(h)) - first[row] + low[row]
    good = np.flatnonzero((row == words.row[n - 1 : n - 1 + len(h)]) & (at >= own[row, 0]) & (at < own[row, 1])) if len(h) else np.zeros(0, np.int64)
    return h[good], good, at[good]


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, item) of items(item, text): distinct texts of `window` words, or of all words of a shorter item."""

    def run(batches):
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                w = words_of(text)
                n = min(len(w), window)
                for k in range(0, len(w) - n + 1 if w else 0, 10_000):
                    own = [b" ".join(w[i : i + n]).decode() for i in range(k, min(k + 10_000, len(w) - n + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([item] * len(own), pa.string())], ["window", "item"])

    return items.mapInArrow(run, "window string, item string").distinct()


def tokens_of(windows: DataFrame) -> DataFrame:
    """(window, n, a, h): the hash of the token that starts at each word a of a window of n words."""

    def run(batches):
        for b in batches:
            texts = [t.encode() for t in b.column(0).to_pylist()]
            *x, counts = in_slices(texts, WINDOW)
            for words, low, own, text in x:
                for n in range(1, SHINGLE + 1):
                    h, at, a = places(words, low, own, n)
                    t = text[words.row[at]]
                    fits = np.minimum(counts[t], SHINGLE) == n
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t[fits])), pa.array(counts[t[fits]].astype(np.int32)), pa.array(a[fits].astype(np.int32)), pa.array(h[fits].view(np.int64))], ["window", "n", "a", "h"])

    return windows.select("window").mapInArrow(run, "window string, n int, a int, h long")


def small(df: DataFrame, size) -> DataFrame:
    """A staged table, broadcast if its rows have BROADCAST_BYTES at most by `size`, counted first."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, doc id, n_words, spans of hit words as a list of starts and ends, items) for each row of docs."""
    spark = docs.sparkSession
    source = docs.select(row_key(text_col, id_col).alias("key"), F.col(id_col), F.col(text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    named = stage(windows_of(items, window), "windows")
    tokens = stage(tokens_of(named.select("window").distinct()), "tokens")
    known = share(spark, bits_of(tokens.select("h").distinct()))

    def tally(batches):
        for b in batches:
            for x in in_slices(b.column(0).cast(pa.binary()).to_pylist(), window):
                if isinstance(x, tuple):
                    h = [y[has(loaded(known), y)] for y in (places(*x[:3], n)[0] for n in range(1, SHINGLE + 1))]
                    h, n = np.unique(np.concatenate(h), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "seen"])

    seen = source.select(text_col).mapInArrow(tally, "h long, seen long").groupBy("h").agg(F.sum("seen").alias("seen"))
    ranked = tokens.join(seen, "h", "left")
    prefix = ranked.groupBy("window", "n").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "a", "h")).alias("p"))
    prefix = stage(prefix.select("p.h", "window", "n", "p.a"), "prefix")
    wanted = share(spark, bits_of(prefix.select("h").distinct()))
    shortest = prefix.agg(F.coalesce(F.min("n"), F.lit(0))).first()[0]
    place = pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("lft", pa.int32()), ("ctx", pa.string())])

    def search(batches):
        for b in batches:
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            counts = np.zeros(0, np.int64)
            for x in in_slices(b.column(2).cast(pa.binary()).to_pylist(), window):
                if not isinstance(x, tuple):
                    counts = x
                    continue
                words, low, own, text = x
                size = np.bincount(words.row, minlength=len(low))
                first = np.cumsum(size) - size
                for n in range(1, SHINGLE + 1):
                    h, at, pos = places(words, low, own, n)
                    some = np.flatnonzero(has(loaded(wanted), h))
                    h, at, pos = h[some], at[some], pos[some]
                    row = words.row[at]
                    begin, end = np.maximum(at - window + 1, first[row]), np.minimum(at + n + window - 1, first[row] + size[row])
                    for k in np.flatnonzero(end - begin >= shortest).tolist():  # the length bound
                        ctx = words.buf[words.start[begin[k]] : words.end[end[k] - 1]].tobytes().decode()
                        found[text[row[k]]].append({"h": int(h[k].astype(np.int64)), "pos": int(pos[k]), "lft": int(at[k] - begin[k]), "ctx": ctx})
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts), pa.array(found, pa.list_(place))], ["key", id_col, "n_words", "found"])

    searched = stage(source.mapInArrow(search, f"key long, {id_col} {kind}, n_words long, found array<struct<h: bigint, pos: int, lft: int, ctx: string>>"), "searched")
    each = searched.select("key", F.col(id_col).alias("id"), F.explode("found").alias("f")).select("key", "id", "f.*")
    met = each.join(small(prefix, F.octet_length("window") + 40), "h").where("lft >= a")  # the positional bound
    met = met.where(F.array_join(F.slice(F.split("ctx", " "), F.col("lft") - F.col("a") + 1, F.col("n")), " ") == F.col("window"))
    hits = stage(met.select("key", "id", (F.col("pos") - F.col("a")).alias("s"), (F.col("pos") - F.col("a") + F.col("n")).alias("e"), "window").distinct(), "hits")
    spans = hits.groupBy("key", "id").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    own = hits.select("key", "id", "window").distinct().join(small(named, F.octet_length("window") + F.octet_length("item") + 40), "window")
    own = own.groupBy("key", "id").agg(F.array_sort(F.collect_set("item")).alias("items"))

    def unite(batches):
        for b in batches:
            flat = [[x for pair in united(s) for x in pair] for s in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(flat, pa.list_(pa.int64()))], ["k", "i", "spans"])

    same = [F.col("key") == F.col("k"), F.col("id").eqNullSafe(F.col("i"))]
    merged = own.join(spans.mapInArrow(unite, f"k long, i {kind}, spans array<bigint>"), same).select("k", "i", "spans", "items")
    merged = stage(merged, "contaminated")
    merged = small(merged, F.size("spans") * 8 + F.size("items") * 40 + 40)
    out = searched.join(merged, [F.col("key") == F.col("k"), F.col(id_col).eqNullSafe(F.col("i"))], "left")
    return out.select("key", id_col, "n_words", F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def united(spans: list[dict]) -> list[list[int]]:
    """Sorted, disjoint intervals."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those in which a window of an item occurs."""
    found = contaminated(docs, items, id_col=id_col, text_col=text_col).where("size(items) > 0")
    return without(docs, stage(found.select("key", id_col).distinct(), "contaminated"), text_col, id_col)


def op3(spark, sf_dir: str) -> DataFrame:
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.expr("cast(aggregate(sequence(1, greatest(1, cast(size(spans) / 2 as int))), 0L, (a, i) -> a + coalesce(get(spans, 2 * i - 1) - get(spans, 2 * i - 2), 0L)) as bigint)")
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
