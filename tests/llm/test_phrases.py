"""Collocations against brute force: nulls, white space, separators, long texts, ties, repeated rows."""

import collections
import random
import re

import numpy as np
import pytest

import __spark_entry__
from tidemill.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n int"


def naive(rows, least, longest, first):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    some = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = {(lang, w[i:j], a) for (lang, w), a in some.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w)}
    by = collections.defaultdict(list)
    for (lang, w), a in some.items():
        if (lang, w, a) not in inside:
            score, cut = min((1000 * a * n[lang] // (f[lang, w[:c]] * f[lang, w[c:]]), c) for c in range(1, len(w)))
            by[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:cut]], f[lang, w[cut:]]))
    return sorted((lang, k + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, own in by.items() for k, x in enumerate(sorted(own)[:first]))


def texts(seed=2, n=260):
    rng = random.Random(seed)
    words = ["of", "the", "sea", "Deep", "blue", "ä", "ab", "a", "b", "new", "york", "Ümlaut", "x1", "don't", "日本"]
    fixed = ["the deep blue sea of ab", "New York a b a b a b a", "ä ä ä ä ä ä ä ä"]
    out = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(0, 6))]
        out.append((["en", "fr", None, "und", ""][min(4, rng.randint(0, 9))], rng.choice([". ", "\n", "  \t ", ", ", " ; ", "\x0b", "!?"]).join(parts)))
    out += [("en", None), (None, None), ("en", ""), ("fr", " \t\n.,"), ("en", "a b " * 900), ("en", "\t lead and  trail \t. "), ("de", "only once")]
    return out + out[:40]


@pytest.fixture(scope="module")
def rows():
    return texts()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", 1) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(4)


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least,longest,first", [(3, 5, 10_000), (20, 5, 7), (2, 2, 50), (4, 3, 10_000)])
def test_collocations(spark, rows, least, longest, first):
    got = collected(phrases.collocations(frame(spark, rows), least, longest, first))
    assert got == naive(rows, least, longest, first) and got


def test_small_slices_and_filters(spark, rows, monkeypatch):
    """Slices within texts, short gatherings and filters that let nearly all through change nothing."""
    monkeypatch.setattr(phrases, "SLICE", 64)
    monkeypatch.setattr(phrases, "GATHER", 100)
    monkeypatch.setattr(phrases, "BITS", 8)
    monkeypatch.setattr(phrases, "TRIGGER", 2)
    monkeypatch.setattr(phrases, "bits_of", lambda h, f=phrases.bits_of: np.full(4, 2**64 - 1, np.uint64))
    assert collected(phrases.collocations(frame(spark, rows), 3)) == naive(rows, 3, 5, 2000)


def test_equal_hashes_are_told_apart():
    """tally() keeps texts of one hash apart."""
    text = b"aa bb aa cc bb aa"
    w = phrases.Words(np.frombuffer(text, np.uint8), np.array([0]), np.array([1], np.uint64), True)
    w.hash[0] = np.zeros(6, np.uint64)
    first, n = phrases.tally(w, np.arange(6), 1, np.ones(6, np.int64))
    assert sorted((text[w.start[i] : w.end[i]], int(k)) for i, k in zip(first, n)) == [(b"aa", 3), (b"bb", 2), (b"cc", 1)]
    u = lambda *x: np.array(x, np.uint64)
    parts = [(u(5, 5, 5, 1), u(2, 1, 2, 9), np.array([1, 2, 3, 4]), np.array([8, 7, 6, 5])), (u(5), u(1), np.array([10]), np.array([3]))]
    assert [tuple(r.values()) for r in phrases.summed(parts).to_pylist()] == [(1, 9, 4, 5), (5, 1, 12, 3), (5, 2, 4, 6)]


def test_op13(spark, tmp_path):
    rows = texts(7, 900)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["op13_collocations"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string", **dict.fromkeys(["rank", "a", "l", "r", "n", "score"], "bigint")}
    assert collected(got) == naive(rows, 100, 5, 2000) and got.count() > 20


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 3 * 10**12
    found = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big)], "lang string, k int, phrase string, f long")
    monkeypatch.setattr(phrases, "frequent", lambda *a: (found, spark.createDataFrame([("en", 10**15)], "lang string, n long")))
    assert collected(phrases.collocations(None)) == [("en", 1, "a b", big, big, big + 1, 10**15, 1000 * big * 10**15 // (big * (big + 1)))]


def test_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
