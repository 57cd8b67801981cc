"""Operators on vectors against brute force: nulls, ties, repeated rows, hot labels, lengths and clashing columns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemill.llm import negatives, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id long, mark string, rank int"


def vectors(seed=3, n=420, dim=8):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(40)]
    out = []
    for i in range(n):
        v = list(base[i % 40]) if i % 3 else [x + rng.gauss(0, 0.1) for x in base[i % 40]]
        out.append((i, v, 2 if i % 3 == 0 else i % 10))
    out += [(1000, None, 1), (1001, [1.0, None] * 4, 1), (1002, [float("nan")] * dim, 1), (1003, [float("inf")] * dim, 1), (1100, base[0], None), (1200, [0.0] * dim, 3), (1300, [], 3), (1301, [], 4)]
    out += [(100, out[100][1], out[100][2]), (100, [x / 2 for x in base[5]], 4), (200, base[7], 2), (None, base[3], 2), (None, base[3], 5), (-700, [100.0, -1.0] + [0.0] * 6, 2), (1400, [1.0, 2.0, 3.0], 1), (1401, [1.0, 2.0, 2.0], 1), (1402, [1.0, 2.0, 2.5], 2)]
    return out


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame([(*r, 7, "m", 1) for r in vectors()], SCHEMA).repartition(3).write.parquet(f"{out}/embeddings.parquet")
    return out


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def naive_negatives(rows):
    """From the rules: all rows sorted for each anchor."""
    own = set()
    for i, v, label in rows:
        if label is not None and finite(v):
            own.add((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v), tuple(v)))
    out = []
    for a in own:
        if a[0] is None or a[0] % 100:
            continue
        order = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0] is None, b[0] or 0, b) for b in own if b is not a and len(b[2]) == len(a[2])), key=lambda r: r[:3])
        for s, _, _, p in [r for r in order if r[3][1] == a[1]][:5]:
            found = [(n[3][0], -n[0]) for n in order if n[3][1] != a[1] and 80 * -s <= 100 * -n[0] <= 100 * -s][:5]
            out += [(a[0], p[0], k + 1, i, -s, score) for k, (i, score) in enumerate(found)]
    return out


def single(rows):
    """The rows with their components as they are stored."""
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def test_op11(spark, table):
    got = [tuple(r) for r in __spark_entry__.queries()["op11_hard_negatives"](spark, table).collect()]
    assert sorted(got, key=str) == sorted(naive_negatives(single(vectors())), key=str) and len(got) > 30


def test_negatives_in_many_blocks(spark, table, monkeypatch):
    """Small blocks and slices give the same rows."""
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "AT_ONCE", 100)
    got = [tuple(r) for r in __spark_entry__.queries()["op11_hard_negatives"](spark, table).collect()]
    assert sorted(got, key=str) == sorted(naive_negatives(single(vectors())), key=str)


def test_large_scores_are_exact(spark):
    rows = [(0, [2.0**21, 1.0], 1), (1, [2.0**21, 3.0], 1), (2, [2.0**21, 2.0], 2), (3, [2.0**21, 1.0], 2)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long"), F.col("id") == 0)
    top = 2**58 + 3 * 2**16
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 2, top, top - 2**16), (0, 1, 2, 3, top, top - 2**17)]
    with pytest.raises(Exception, match="64 bits"):
        negatives.hard_negatives(spark.createDataFrame([(0, [2.0**30], 1), (1, [2.0**30], 1)], "vec_id long, embedding array<double>, label long"), F.col("id") == 0).collect()


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(none, F.col("id") % 100 == 0).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<float>, label int"), F.col("id") == 0).collect() == []


def naive_near(rows, least=0.95):
    """Vectors by their cosines: links as a matrix, components by spreading the smallest id."""
    live = [k for k, (_, v, _) in enumerate(rows) if finite(v) and any(v)]
    linked = {k: set() for k in range(len(rows))}
    for d in {len(rows[k][1]) for k in live}:
        own = [k for k in live if len(rows[k][1]) == d]
        m = np.array([rows[k][1] for k in own])
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(m @ m.T >= least)):
            if a != b:
                linked[own[a]].add(own[b])
    low = [math.inf if i is None else i for i, _, _ in rows]
    moved = True
    while moved:
        moved = False
        for k, near in linked.items():
            for x in near:
                if low[x] < low[k]:
                    low[k], moved = low[x], True
    return [(i, len(linked[k]), None if low[k] == math.inf else low[k], i is not None and i == low[k]) for k, (i, _, _) in enumerate(rows)]


def near_groups(seed=5, groups=30, dim=12):
    """Balls of near copies, one of them large, chains, exact copies and single vectors."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        c = rng.normal(size=dim)
        out += [c + rng.normal(scale=s, size=dim) for s in (0.05, 0.12, 0.2) for _ in range(60 if g == 0 else 4)]
        out += [c] * (50 if g == 1 else 2)
    a, b = rng.normal(size=dim), rng.normal(size=dim)
    out += [np.cos(t) * a + np.sin(t) * b for t in np.linspace(0, 1.5, 12)]
    return [(int(i), [float(np.float32(x)) for x in out[i]], 1) for i in rng.permutation(len(out))]


def test_op12(spark, table):
    got = [tuple(r)[:4] for r in __spark_entry__.queries()["op12_near_vectors"](spark, table).collect()]
    assert sorted(got, key=str) == sorted(naive_near(single(vectors())), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_near_groups(spark, monkeypatch, small):
    """Whole, and with small clusters that are split into tiles: the links are those of brute force."""
    if small:
        monkeypatch.setattr(neighbours, "SHARD", 120)
    rows = near_groups()
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v, _ in rows], "vec_id long, embedding array<float>, key long, least double").repartition(5)
    found = neighbours.near_vectors(df, overlap=4, beam=32, tile=40 if small else 4096).collect()
    want = {r[0]: r for r in naive_near(rows)}
    links = sum(r["n_links"] for r in found), sum(r[1] for r in want.values())
    assert len(found) == len(rows) and all(r["n_links"] <= want[r["vec_id"]][1] for r in found)
    assert links[0] >= (0.98 if small else 1) * links[1] and found[0]["recall"] >= 0.9
    same = sum(r["component_id"] == want[r["vec_id"]][2] for r in found)
    assert same >= 0.98 * len(rows) and (small or [tuple(r)[:4] for r in found if tuple(r)[:4] != want[r["vec_id"]]] == [])


def test_near_vectors_of_nothing(spark):
    assert neighbours.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    only = spark.createDataFrame([(4, None), (5, [0.0, 0.0]), (6, [1e-30, 1e-30]), (7, [3e38, 3e38])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r)[:4] for r in neighbours.near_vectors(only).collect()) == [(4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False)]


def test_audit_widens_the_search(spark, monkeypatch):
    """An index that finds too little is made anew with more overlap and a wider beam; if that doesn't help, it is an error."""
    seen = []

    def poor(nodes, threshold, overlap, beam, tile, dims):
        seen.append((overlap, beam))
        none = nodes.sparkSession.createDataFrame([], "key long, links long")
        return none, nodes.sparkSession.createDataFrame([], "a long, b long")

    monkeypatch.setattr(neighbours, "links", poor)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<float>")
    with pytest.raises(RuntimeError, match="less than"):
        neighbours.near_vectors(df)
    assert seen == [(4, 24), (8, 48), (16, 96), (32, 192)]
