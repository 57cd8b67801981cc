"""Collocations by prefix-free parsing.

Texts are cut into pieces at punctuation and line ends.  Within a piece, each window of `longest` - 1
words whose hash hits a trigger ends a chunk and starts the next, so neighbouring chunks overlap by
that window.  Equal chunks are one row of a dictionary with their frequency in the parse.  Phrases are
counted inside the distinct chunks, weighted by it; one that starts within the overlap belongs to the
chunk that starts there, so each occurrence counts once.

Counting runs in levels, of two, three, and more words: a phrase can be frequent only if the shorter ones
in it are.  What is frequent is kept as a filter of bits (at most 2^27, 16 MB, whatever the
corpus); a filter lets more through on a larger corpus, and never less.  Words are counted by their text.
Phrases are counted by two independent 64-bit hashes, with the first chunk that holds them, where their
text is read once they have turned out to be frequent.

A null text has no words; a null language is `und`.  Repeated rows count as often as they stand there.
Long texts are taken in parts that end with a piece.  An empty table gives an empty result.  Columns
besides the language and the text are not looked at.
"""

from __future__ import annotations

import functools
import pickle
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, read, share, stage
from .simhash import mixed

#: One window in so many is a trigger.
TRIGGER = 16
#: Bytes of text that a task takes at once, and entries that it gathers before it passes them on.
SLICE, GATHER = 1 << 20, 1 << 21
#: Most bits of a filter, as a power of two.
BITS = 27
#: Parts in which a language's phrases are ranked first.
SALTS = 32

_TABLE = bytes(32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACES = re.compile(b" +")
#: Two hashes of bytes: their numbers and odd bases.
_NUMBERS = np.random.default_rng(17).integers(1, 2**63, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for b in (*_BASES, *(pow(x, -1, 1 << 64) for x in _BASES)):
            p = np.full(max(n, SLICE + 1), b, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers


class Words:
    """The words of rows that lie one behind the other in buf and begin at `begins`: their ends, rows, and hashes with the row's seed."""

    def __init__(self, buf: np.ndarray, begins: np.ndarray, seeds: np.ndarray, both: bool):
        gap = (buf == 32) | (buf == 10)
        cut = np.zeros(len(buf) + 1, bool)
        cut[begins] = True
        before = np.concatenate([[True], gap[:-1]]) if len(buf) else gap
        after = np.concatenate([gap[1:], [True]]) if len(buf) else gap
        self.buf = buf
        self.start = np.flatnonzero(~gap & (before | cut[:-1]))
        self.end = np.flatnonzero(~gap & (after | cut[1:])) + 1
        self.row = np.searchsorted(begins, self.start, "right") - 1
        self.hash = [mixed(h ^ seeds[self.row]) for h in map(self._hash, range(1 + both))]

    def _hash(self, which: int) -> np.ndarray:
        n, p = len(self.buf), powers(len(self.buf) + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_NUMBERS[which][self.buf] * p[which][:n], out=total[1:])
        return (total[self.end] - total[self.start]) * p[which + 2][self.start]

    def longer(self, which: int, k: int) -> np.ndarray:
        """Hashes of the k words from each word on (of the first len - k + 1)."""
        h = self.hash[which]
        out = h
        for j in range(1, k):
            out = mixed(out[: len(h) - j] * np.uint64(_BASES[1]) + h[j:])
        return out if k <= len(h) else h[:0]


def seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 5)


def strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The parts of buf as an array of strings."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def tally(words: Words, at: np.ndarray, k: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, summed weight) of each distinct text of k words from the places `at` on, by row seeds."""
    h, other = words.longer(0, k)[at], words.longer(1, k)[at]
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    size = words.end[at + k - 1] - words.start[at]
    if (other != other[first][back]).any() or (size != size[first][back]).any():  # two texts of one hash
        _, first, back = np.unique(np.stack([h, other, size.astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
    total = np.zeros(len(first), np.int64)
    np.add.at(total, back.ravel(), weight)
    return at[first], total


ENTRY = ["lang", "text", "kind", "n"]
#: Kinds of rows: a chunk that another follows, the last chunk of its piece, a word.
INNER, LAST, WORD = 0, 1, 2


def parsed(texts: list[bytes], langs: list[str], overlap: int) -> pa.RecordBatch:
    """Chunks and words of texts that are lower-cased and have a line a piece."""
    lengths = np.array([len(t) + 1 for t in texts])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    w = Words(np.frombuffer(b"\n".join(texts), np.uint8), begins, np.array([seed(x) for x in langs], np.uint64), True)
    names = np.array(langs, object)
    if not len(w.start):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.string(), pa.int32(), pa.int64())], ENTRY)
    piece = np.cumsum(w.buf == 10)[w.start]
    head = np.concatenate([[True], piece[1:] != piece[:-1]])
    heads = np.flatnonzero(head)
    tail = np.repeat(np.concatenate([heads[1:], [len(piece)]]) - 1, np.diff(np.concatenate([heads, [len(piece)]])))  # a piece's last word
    window = w.longer(0, overlap)
    trigger = head.copy()
    at = np.arange(len(window))
    trigger[: len(window)] |= (window % np.uint64(TRIGGER) == 0) & ~head[: len(window)] & (at + overlap <= tail[: len(window)])
    starts = np.flatnonzero(trigger)
    follows = np.concatenate([piece[starts[1:]] == piece[starts[:-1]], [False]])
    ends = np.where(follows, np.concatenate([starts[1:], [0]]) + overlap - 1, tail[starts])
    chunks = strings(w.buf, w.start[starts], w.end[ends])
    first, n = tally(w, np.arange(len(piece)), 1, np.ones(len(piece), np.int64))
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([names[w.row[starts]], names[w.row[first]]]), pa.string()), pa.concat_arrays([chunks, strings(w.buf, w.start[first], w.end[first])]),
        pa.array(np.concatenate([np.where(follows, INNER, LAST), np.full(len(first), WORD)]).astype(np.int32)), pa.array(np.concatenate([np.ones(len(starts), np.int64), n])),
    ], ENTRY)


def dictionary(docs: DataFrame, overlap: int, lang_col: str, text_col: str) -> DataFrame:
    """(lang, text, kind, n): the distinct chunks and words of all texts with their frequencies."""

    def run(batches):
        texts, langs, size = [], [], 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                rest = text.as_py().translate(_TABLE)
                rest = _SPACES.sub(b" ", rest) if b"  " in rest else rest
                while rest:
                    # Parts of a long text end with a piece.
                    end = len(rest) if len(rest) <= SLICE else rest.rfind(b"\n", 0, SLICE)
                    if end <= 0:
                        end = rest.find(b"\n", SLICE)
                    end = len(rest) if end < 0 else end
                    texts.append(rest[:end])
                    langs.append(lang)
                    size, rest = size + end, rest[end + 1 :]
                    if size >= SLICE:
                        yield parsed(texts, langs, overlap)
                        texts, langs, size = [], [], 0
        if texts:
            yield parsed(texts, langs, overlap)

    source = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "lang string, text string, kind int, n long").groupBy("lang", "text", "kind").agg(F.sum("n").alias("n"))


def bits_of(hashes: DataFrame) -> np.ndarray:
    """A filter of the numbers in `h`: two bits each, of 32 a number and at most 2 ** BITS in all."""
    k = min(BITS, max(16, (32 * hashes.count()).bit_length()))
    places = hashes.select(F.explode(F.array(F.shiftrightunsigned("h", 64 - k), F.col("h").bitwiseAND(F.lit((1 << k) - 1)))).alias("p"))
    slots = places.groupBy(F.shiftright("p", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toArrow()  # at most 2 ** (BITS - 6) rows
    out = np.zeros(1 << (k - 6), np.uint64)
    out[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)
    return out


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    k = len(bits).bit_length() - 1 + 6
    p, q = h >> np.uint64(64 - k), h & np.uint64((1 << k) - 1)
    bit = lambda x: bits[x >> np.uint64(6)] >> (x & np.uint64(63))
    return (bit(p) & bit(q) & np.uint64(1)).astype(bool)


class Rows:
    """The words of dictionary rows; `owned` marks the places whose phrases belong to their row."""

    def __init__(self, b: pa.RecordBatch, overlap: int):
        lang, text = b.column(0).dictionary_encode(), b.column(1)
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
        buf = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.names, code = lang.dictionary.to_pylist(), lang.indices.to_numpy()
        self.words = w = Words(buf, offsets[:-1] - offsets[0], np.array([seed(x) for x in self.names], np.uint64)[code], True)
        self.lang, self.n, self.id = code, b.column(3).to_numpy()[w.row], b.column(4).to_numpy()[w.row]
        size = np.bincount(w.row, minlength=len(text))
        place = np.arange(len(w.row)) - (np.cumsum(size) - size)[w.row]
        self.owned = (b.column(2).to_numpy()[w.row] != INNER) | (place < size[w.row] - overlap)
        self.left = size[w.row] - place  # words from here to the row's end

    def places(self, k: int) -> np.ndarray:
        """Where phrases of k words start that this row owns."""
        n = max(0, len(self.left) - k + 1)
        return self.owned[:n] & (self.left[:n] >= k)

    def keys(self, k: int, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """(hash, second hash, weight, chunk) of the phrases of k words at the places of a mask."""
        at = np.flatnonzero(mask)
        return self.words.longer(0, k)[at], self.words.longer(1, k)[at], self.n[at], self.id[at]


KEYED = "h long, h2 long, n long, id long"


def summed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Keys with their summed weights and first chunks."""
    h, h2, n, first = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if (same & (h2[order][1:] != h2[order][:-1])).any():
        order = np.lexsort((h2, h))
    h, h2, n, first = h[order], h2[order], n[order], first[order]
    begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]))
    return pa.RecordBatch.from_arrays([pa.array(h[begin].view(np.int64)), pa.array(h2[begin].view(np.int64)), pa.array(np.add.reduceat(n, begin)), pa.array(np.minimum.reduceat(first, begin))], ["h", "h2", "n", "id"])


def counted(rows: DataFrame, pick, least: int) -> DataFrame:
    """The keys that pick(batch) yields, with weights that come to `least` or more in all, and their first chunks."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held += [x for x in pick(b) if len(x[0])]
                size = sum(len(x[0]) for x in held)
                if size >= GATHER:
                    yield summed(held)
                    held, size = [], 0
        if size:
            yield summed(held)

    return rows.mapInArrow(run, KEYED).groupBy("h", "h2").agg(F.sum("n").alias("n"), F.min("id").alias("id")).where(F.col("n") >= least)


def loaded(shared) -> np.ndarray:
    """A filter, unpacked once for each of a worker's tasks."""
    if not hasattr(shared, "unpacked"):
        shared.unpacked = pickle.loads(shared.value)
    return shared.unpacked


def frequent(docs: DataFrame, least: int, longest: int, lang_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of all phrases of 1 to `longest` words that stand there `least` times, and (lang, n) of all words."""
    overlap, spark = longest - 1, docs.sparkSession
    entries = stage(dictionary(docs, overlap, lang_col, text_col).withColumn("id", F.monotonically_increasing_id()), "chunks")
    words, chunks = entries.where(F.col("kind") == WORD), entries.where(F.col("kind") != WORD)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    common = words.where(F.col("n") >= least)

    def own(b):
        w = Rows(b, overlap)
        return [w.keys(1, w.owned)]

    def level(known, k: int, last: int):
        """Keys of phrases of k to `last` words whose parts of k - 1 words are all known."""

        def pick(b):
            r, out = Rows(b, overlap), []
            good = has(loaded(known), r.words.longer(0, k - 1))
            for n in range(k, last + 1):
                whole = good[: max(0, len(good) - n + k - 1)].copy()
                for j in range(1, n - k + 2):
                    whole &= good[j : j + len(whole)]
                out.append(r.keys(n, r.places(n) & whole))
            return out

        return stage(counted(chunks, pick, least), "frequent")

    shorter, found = stage(counted(common, own, least), "frequent"), []
    for k, last in ((2, 2), (3, 3), (4, longest)):
        if k <= last <= longest:
            shorter = level(share(spark, bits_of(shorter)), k, last)
            found.append(shorter)
    every = functools.reduce(DataFrame.unionByName, found)
    wanted = stage(every.groupBy("id").agg(F.collect_list("h").alias("h"), F.collect_list("h2").alias("h2"), F.collect_list("n").alias("f")), "wanted")  # the phrases of one chunk
    homes = stage(chunks.join(checked(wanted.select("id")), "id", "left_semi"), "homes")

    def texts(batches):
        """The text of each wanted phrase, from its first chunk."""
        for b in batches:
            if not b.num_rows:
                continue
            r, out = Rows(b, overlap), []
            lists = [c.to_pylist() for c in b.columns[5:8]]
            want = {(row, h, h2): f for row, x in enumerate(zip(*lists)) for h, h2, f in zip(*x)}
            some = np.unique(np.array([h for _, h, _ in want], np.int64))
            for k in range(2, longest + 1):
                place = r.places(k)
                h, h2 = (r.words.longer(i, k).view(np.int64) for i in (0, 1))
                for i in np.flatnonzero(place & np.isin(h[: len(place)], some)):
                    f = want.pop((int(r.words.row[i]), int(h[i]), int(h2[i])), None)
                    if f is not None:
                        out.append((r.names[r.lang[r.words.row[i]]], k, r.words.buf[r.words.start[i] : r.words.end[i + k - 1]].tobytes().decode(), f))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)], ["lang", "k", "phrase", "f"])

    phrases = homes.select(*ENTRY, "id").join(wanted, "id").select(*ENTRY, "id", "h", "h2", "f").mapInArrow(texts, "lang string, k int, phrase string, f long")
    return stage(common.select("lang", F.lit(1).alias("k"), F.col("text").alias("phrase"), F.col("n").alias("f")).unionByName(phrases), "phrases"), totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to `longest` words.

    score is the least of floor(1000 a n / (l r)) over the cuts of a phrase in two, of the shortest first
    part among equal ones.  A phrase that stands as often within a longer one is left out.
    """
    found, totals = frequent(docs, least, longest, lang_col, text_col)
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    phrases = found.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    # What is inside a longer phrase as often is inside one of one word more as often.
    inside = found.where("k > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase"), F.col("f").alias("a")).distinct()
    left = phrases.join(inside, ["lang", "phrase", "a"], "left_anti")
    cuts = left.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    count = lambda text, name: found.select("lang", F.col("phrase").alias(text), F.col("f").alias(name))
    cuts = cuts.join(count("head", "l"), ["lang", "head"]).join(count("rest", "r"), ["lang", "rest"]).join(checked(totals), "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("up", F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("n"))).withColumn("down", exact("l") * exact("r")).withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Ranked in parts first: a language's last window holds SALTS * first rows at most.
    best = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))
