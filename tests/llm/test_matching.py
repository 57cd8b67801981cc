"""Contamination, repeated substrings, near copies: against brute force."""

import collections
import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from tidemill.llm import decontam, simhash, substrings
from tidemill.llm.common import connected_components

from .conftest import collected, texts

BENCH = "item_id string, text string, extra int"


def naive_words(t):
    out, cur = [], ""
    for c in (t or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) > 127:
            cur += c
        elif cur:
            out.append(cur)
            cur = ""
    return out


def naive_contamination(text, items):
    w = naive_words(text)
    hit, found = set(), set()
    for k, t in items:
        iw = naive_words(t)
        n = min(10, len(iw))
        for i in range(len(iw) - n + 1 if iw else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == iw[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(k or "")
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize(("slice_", "part", "most"), [(1 << 20, 100_000, 32_000_000), (300, 15, -1)])
def test_contamination(spark, docs, monkeypatch, slice_, part, most):
    """Whole, and in small slices and parts, with joins that shuffle."""
    for name, x in (("SLICE", slice_), ("PART", part), ("BROADCAST_BYTES", most)):
        monkeypatch.setattr(decontam, name, x)
    all_ = texts()
    items = [("i1", " ".join(all_[4].split()[10:40])), ("i2", "One, TWO"), ("i3", None), ("i4", ""), ("i5", "spam ham spam ham spam ham spam ham spam ham spam"), ("i1b", " ".join(all_[4].split()[12:30])), ("ü", "ünï çödé àÉ"), (None, "two one"), (None, "TWO one one")]
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], BENCH)
    got = decontam.contaminated(docs, bench)
    want = sorted(naive_contamination(r["text"], items) for r in docs.collect())
    have = [(r["n_words"], sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2])), r["items"]) for r in got.collect()]
    assert sorted(have) == want
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[2] for w in want)


def test_a_large_benchmark_gives_rows_for_hits_only(spark, docs, tmp_path):
    """Thousands of items over clean documents and some that hold one: nothing is made for a document and an item that don't meet."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(f"i{k}", " ".join(word() for _ in range(30)), 1) for k in range(3000)]
    data = [(i, " ".join(word() for _ in range(80)) + (" " + items[i][1] if i % 50 == 0 else ""), "x") for i in range(400)]
    found = decontam.contaminated(spark.createDataFrame(data, "doc_id long, text string, key string"), spark.createDataFrame(items, BENCH))
    assert {r["doc_id"]: r["items"] for r in found.where("size(items) > 0").collect()} == {i: [f"i{i}"] for i in range(0, 400, 50)} and found.count() == 400


def test_contamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], BENCH)
    assert decontam.keep_clean(docs, none).count() == docs.count()
    assert decontam.contaminated(empty, none).count() == 0


def naive_repeats(rows, first=False, length=200):
    """Removed bytes of each (id, text), by counting all substrings."""
    seen = collections.Counter(x[j : j + length] for _, x in rows for j in range(len(x) - length + 1))
    out, done = [], set()
    for i, x in rows:
        m = np.zeros(len(x), bool)
        for j in range(len(x) - length + 1):
            s = x[j : j + length]
            if seen[s] > 1 and not (first and s not in done):
                m[j : j + length] = True
            done.add(s)
        out.append((i, len(x), int(m.sum()), hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~m])).hexdigest()))
    return out


def naive_runs(rows, length=200):
    """Numbers of maximal removed runs."""
    seen, out = collections.Counter(x[j : j + length] for _, x in rows for j in range(len(x) - length + 1)), []
    for i, x in rows:
        m = np.zeros(len(x) + 1, np.int8)
        for j in range(len(x) - length + 1):
            if seen[x[j : j + length]] > 1:
                m[j : j + length] = 1
        out.append((i, int((np.diff(np.concatenate([[0], m])) == 1).sum())))
    return out


def repeats(docs, **options):
    out = substrings.kept_bytes(docs, substrings.spans(docs, **options), digest=True)
    return [(r["doc_id"], r["n_bytes"], sum(s["e"] - s["s"] for s in r["removed"]), r["kept"]) for r in out.collect()]


def by_text(x):
    return (x[0] is None, x[0] or 0, str(x))


@pytest.mark.parametrize("options", [{}, {"group": 1}, {"group": 3}, {"length": 60, "gram": 20}, {"keep": "first"}, {"keep": "first", "group": 1}, {"keep": "first", "length": 60, "gram": 20, "group": 2}])
def test_repeats(docs, options, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 60)
    monkeypatch.setattr(substrings, "SEGMENT", 700)
    rows = sorted(((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    if options.get("keep") == "first":  # repeated rows share a key, so all or none of them stays
        docs = docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
        rows = [r for r in dict(rows).items() if r[0] is not None]
    want = naive_repeats(rows, options.get("keep") == "first", options.get("length", 200))
    assert sorted(repeats(docs, **options), key=by_text) == sorted(want, key=by_text)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_many_near_copies_of_one_passage(spark, keep):
    rng = np.random.default_rng(12)
    fresh = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    line, data = fresh(150), []
    for i in range(60):
        left, right = fresh(60), fresh(60)
        for k in range(5):
            data.append((5 * i + k, f"{left[:3 * k]}{fresh(1)}{left[3 * k + 1 :]}{line}{right[: 50 - 9 * k]}{fresh(2)}"))
    data += [(1000 + i, data[7][1]) for i in range(40)]
    rows = [(i, t.encode()) for i, t in data]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    assert sorted(repeats(docs, keep=keep, group=6)) == sorted(naive_repeats(rows, keep == "first"))


def test_spans_of_repeated_rows_count_once(spark):
    """A page that stands there thousands of times has the spans of one page, not one for each row and row."""
    rng = np.random.default_rng(3)
    page = bytes(rng.integers(97, 123, 2000).astype(np.uint8)).decode()
    rows = spark.range(3000, numPartitions=8).select(F.when(F.col("id") < 2990, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(page).alias("text"))
    found = substrings.spans(rows).select(F.size("spans")).collect()
    assert len(found) == 11 and max(r[0] for r in found) < 100
    assert {tuple(r)[1:3] for r in substrings.kept_bytes(rows, substrings.spans(rows), digest=True).select("doc_id", "n_bytes", F.expr("aggregate(removed, 0L, (a, x) -> a + x.e - x.s)")).collect()} == {(2000, 2000)}


def test_repeats_of_nothing(empty):
    assert repeats(empty) == []


def test_factors():
    rng = np.random.default_rng(8)
    for text in (b"", b"a", b"aaaaaaaa", b"abababab", bytes(rng.integers(97, 99, 60).astype(np.uint8)), bytes(rng.integers(97, 101, 90).astype(np.uint8))):
        order = sorted(range(len(text)), key=lambda i: text[i:])
        common = lambda i, j: next((k for k in range(len(text)) if text[i + k : i + k + 1] != text[j + k : j + k + 1] or i + k >= len(text)), 0)
        shared = np.array([0, *(common(i, j) for i, j in zip(order, order[1:]))][: len(order)], np.int64)
        got = dict(zip(order, substrings.factors(np.array(order, np.int64), shared).tolist()))
        assert got == {i: max((common(i, j) for j in range(i)), default=0) for i in range(len(text))}


def test_a_large_group_takes_little_memory():
    """An anchor in as many different contexts as one task gathers: within 150 MB."""
    rng = np.random.default_rng(9)
    n, line = substrings.GROUP, bytes(rng.integers(97, 123, 190).astype(np.uint8))
    ctx = b"".join(bytes(rng.integers(97, 123, 85).astype(np.uint8)) + line + bytes(rng.integers(97, 123, 85).astype(np.uint8)) for _ in range(n))
    flat, sizes = np.frombuffer(ctx, np.uint8), np.full(n, 360)
    tracemalloc.start()
    gone = substrings.repeated_starts(flat, np.arange(n) * 360, sizes, np.full(n, 160), np.zeros(n, int), np.zeros(n, int), np.full(n, 160), False)
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
    some = {l: collections.Counter(ctx[k * 360 + 160 - l : k * 360 + 360 - l] for k in range(n)) for l in (0, 75, 80, 86, 160)}
    for l, counts in some.items():
        assert [counts[ctx[k * 360 + 160 - l : k * 360 + 360 - l]] > 1 for k in range(n)] == gone[:, l].tolist()


def test_anchors_in_segments():
    x = np.random.default_rng(10).integers(97, 100, 5000).astype(np.uint8)
    for segment in (1, 333, 4999):
        assert all((p == q).all() for p, q in zip(substrings.anchors(x), substrings.anchors(x, segment=segment)))


def test_anchors_are_shared():
    rng = np.random.default_rng(3)
    x = rng.integers(97, 123, 3000).astype(np.uint8)
    y = np.concatenate([rng.integers(97, 123, 777).astype(np.uint8), x[1000:1200], rng.integers(97, 123, 500).astype(np.uint8)])
    a, b = substrings.anchors(x), substrings.anchors(y)
    inside = {int(h) for p, h in zip(a[0], a[1]) if 1000 <= p <= 1160} & {int(h) for p, h in zip(b[0], b[1]) if 777 <= p <= 937}
    assert inside and len(a[0]) < len(x) / 20


def naive_fingerprint(t, n=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + n]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [naive_fingerprint(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((r["doc_id"] for r, h in zip(rows, group) if h == g and r["doc_id"] is not None), default=None) for g in group}
    want = sorted(((r["doc_id"], f - (1 << 64) * (f >> 63), least[g]) for r, f, g in zip(rows, fps, group)), key=str)
    got = simhash.near_duplicates(docs)
    assert sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in got.collect()), key=str) == want


@pytest.mark.parametrize(("options", "radius"), [({"blocks": 4, "tile": 30}, 2), ({"blocks": 2, "tile": 50}, 3), ({"blocks": 1, "tile": 40}, 7)])
def test_tiles_lose_no_link(spark, options, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 6), dtype=np.uint64)) for b in base for _ in range(3)]
    fps = np.unique(np.concatenate([base, np.array(flips, np.uint64)]))
    df = spark.createDataFrame([(int(x), [int(x)]) for x in fps.view(np.int64)], "fp long, sig array<long>")
    found = connected_components(simhash.tiled_links(df, radius, **options)).collect()
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if np.bitwise_count(fps[i] ^ fps[j]) <= radius:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    groups = collections.defaultdict(set)
    for x, g in zip(fps.view(np.int64).tolist(), label):
        groups[g].add(x)
    own = collections.defaultdict(set)
    for r in found:
        own[r["root"]] |= {r["node"], r["root"]}
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(g) for g in own.values()}


def test_keep_one(docs, empty):
    kept = simhash.keep_one(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and simhash.keep_one(empty).count() == 0
    assert {0, 1, 5} <= set(ids) and not {24, 25, 26} & set(ids) and ids.count(5) == 1
    assert set(range(24)) <= set(ids)


def test_recall_of_near_copies_by_similarity(spark):
    """Fresh texts with copies at known similarities of their five-word shingles: the pipeline's rule finds nine in ten
    and more in every band from 0.8 up, and joins no texts that have little in common."""
    rng = random.Random(77)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    alike = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    vocabulary, docs, bands = [word() for _ in range(3000)], [], collections.defaultdict(list)
    while min((len(bands[x]) for x in (80, 85, 90, 95, 20)), default=0) < 80:
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 500))]
        copy, target = list(base), rng.choice([0.81, 0.84, 0.88, 0.93, 0.97, 0.2])
        while alike(base, copy) > target:
            k = rng.randrange(len(copy))
            how = rng.random()
            copy[k : k + (how > 0.3)] = [word()] if how < 0.9 else []
        x = alike(base, copy)
        band = 20 if x < 0.5 else int(20 * x) * 5
        if band == 20 or x >= 0.8:
            n = len(docs)
            docs += [(n, " ".join(base)), (n + 1, " ".join(copy))]
            bands[band].append(n)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    root = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, **simhash.NEAR).collect()}
    found = {b: sum(root[n] == root[n + 1] for n in own) / len(own) for b, own in bands.items()}
    print({b: (round(x, 3), len(bands[b])) for b, x in sorted(found.items())})
    assert found[20] == 0 and min(found[b] for b in (80, 85, 90, 95)) >= 0.9 and len(set(root.values())) >= len(docs) / 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in got} == {(i, 0) for i in range(1, 31)} | {(k, 100) for k in range(101, 120)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
