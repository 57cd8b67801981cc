"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt into tiles by the population counts of their blocks of bits.
Two fingerprints within `radius` bits differ by at most `radius` in the sum of the differences
of these counts, so only tile pairs within that distance are compared, with numpy's
exclusive-or and bit counts.  A tile pair returns a spanning forest of its links, so a group
of n near copies gives O(n) edges; the components are then exact.

Nulls and empty texts have no words, hence fingerprint zero.  Repeated rows and ties share a
fingerprint.  Columns besides the id and the text are not looked at.  An empty table gives an
empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, connected_components, fresh, row_key, stage, without

#: Most fingerprints of a tile, as an average.
TILE = 8192
#: Parts in which the members of a component meet its root.
SALTS = 16


def signature(text: bytes | None, words: int = 3, bits: int = 64) -> np.ndarray:
    """Majority fingerprint of the word shingles of a UTF-8 text, as bits / 64 signed integers.

    The first integer comes from the shingles' XXH64 (seed 42), the others from mixes of it.
    """
    w, wide = (text or b"").lower().split(), bits // 64
    if not w:
        return np.zeros(wide, np.int64)
    joined, n = b" ".join(w), max(1, len(w) - words + 1)
    ends = (np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :] or ends[-1:])), np.uint64, n)
    ones = np.zeros(bits, np.int64)
    for i in range(0, n, 1 << 14):
        part = hashes[i : i + (1 << 14), None]
        if wide > 1:
            part = np.concatenate([part, *(mixed(part + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(1, wide))], axis=1)
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc id, sig, fp) for each row of docs; fp is a 64-bit name of the signature, which it equals at 64 bits."""

    def run(batches):
        for b in batches:
            sigs = [signature(t, words, bits) for t in b.column(2).cast(pa.binary()).to_pylist()]
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * (bits // 64)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sig], ["key", id_col, "sig"])

    source = docs.select(row_key(text_col, id_col).alias("key"), F.col(id_col), F.col(text_col))
    found = source.mapInArrow(run, f"key long, {id_col} {docs.schema[id_col].dataType.simpleString()}, sig array<long>")
    return found.withColumn("fp", F.xxhash64("sig") if bits > 64 else F.col("sig")[0])


def forest(ids_a, a: np.ndarray, ids_b, b: np.ndarray, same: bool, first: int, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between tiles a and b (the same tile if `same`): at most
    `first` bits differ in the first 64 and at most `radius` in all."""
    label = np.arange(len(a)) if same else np.arange(len(a) + len(b))
    shift, edges = 0 if same else len(a), []
    x, y = a.view(np.uint64), b.view(np.uint64)
    x0, y0 = x[:, 0].copy(), y[:, 0].copy()
    step = max(1, (1 << 18) // max(1, len(b)))
    for i in range(0, len(a), step):
        near = np.bitwise_count(x0[i : i + step, None] ^ y0[None, :]) <= first
        if same:
            near[np.arange(near.shape[0]), np.arange(i, i + near.shape[0])] = False
        for r in np.flatnonzero(near.any(axis=1)):
            js = np.flatnonzero(near[r])
            if x.shape[1] > 1:
                js = js[np.bitwise_count(x[i + r][None, :] ^ y[js]).sum(axis=1, dtype=np.int64) <= radius]
            labels, at = np.unique(label[shift + js], return_index=True)
            mine = label[i + r]
            other = labels != mine
            if other.any():
                edges += [(int(ids_a[i + r]), int(ids_b[j])) for j in js[at[other]]]
                label[np.isin(label, labels[other])] = mine
    return edges


def tiled_links(fps: DataFrame, radius: int, first: int | None = None, blocks: int = 4, tile: int = TILE) -> DataFrame:
    """Edges (a, b) of names fp that connect all signatures sig within `radius` bits (and `first` bits in the first 64).

    A tile's class are the population counts of the `blocks` blocks of the first 64 bits, for a
    single block in steps of a third of the radius.  Tile pairs whose counts differ beyond the
    radius are never made.
    """
    first = radius if first is None else first
    width = 64 // blocks
    grain = max(1, first // 3) if blocks == 1 else 1
    far, base = -(-first // grain), width // grain + 1
    word = F.col("sig")[0]
    counts = [F.bit_count(F.shiftrightunsigned(word, width * i).bitwiseAND(F.lit((1 << width) - 1))) if blocks > 1 else F.bit_count(word) for i in range(blocks)]
    coded = fps.select("fp", "sig", sum(F.floor(c / grain) * base**i for i, c in enumerate(counts)).cast("int").alias("cls"))
    # At most base ** blocks rows (83,521 for four blocks): a bound that doesn't depend on the data.
    parts = coded.groupBy("cls").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = coded.join(F.broadcast(parts), "cls").withColumn("sub", F.expr("cast(pmod(xxhash64(fp, 7), parts) as int)"))
    tiles = tiles.groupBy("cls", "sub").agg(F.collect_list(F.struct("fp", "sig")).alias("all"))
    tiles = stage(tiles.select("cls", "sub", F.expr("transform(all, x -> x.fp)").alias("fps"), F.expr("flatten(transform(all, x -> x.sig))").alias("sigs")), "tiles")
    # Of each pair of opposite steps between classes, one.
    steps = [v for v in itertools.product(range(-far, far + 1), repeat=blocks) if sum(map(abs, v)) <= far and v >= (0,) * blocks]
    if len(steps) > 200:
        raise ValueError(f"{blocks} blocks have {len(steps)} neighbouring classes within {far}; take fewer blocks")
    digits = [f"cast(cls / {base**i} as int) % {base}" for i in range(blocks)]
    fits = lambda v: " and ".join(f"{d} + {x} between 0 and {base - 1}" for d, x in zip(digits, v))
    there = F.array_compact(F.array(*[F.expr(f"case when {fits(v)} then cls + {sum(x * base**i for i, x in enumerate(v))} end") for v in steps]))
    a = tiles.select(F.col("cls").alias("ca"), F.col("sub").alias("sa"), F.explode(there).alias("cls"))
    pairs = a.join(tiles.select("cls", "sub"), "cls").where("ca <> cls or sa <= sub")
    pairs = pairs.join(tiles.select(F.col("cls").alias("ca"), F.col("sub").alias("sa"), F.col("fps").alias("fa"), F.col("sigs").alias("ga")), ["ca", "sa"])
    pairs = pairs.join(tiles, ["cls", "sub"])
    n = 2 * int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(n, "ca", "sa", "cls", "sub").select("fa", "ga", "fps", "sigs", F.expr("ca = cls and sa = sub").alias("same"))

    def run(batches):
        for batch in batches:
            found, cols = [], [(c.values.to_numpy(), c.offsets.to_numpy()) for c in batch.columns[:4]]
            for i, same in enumerate(batch.column(4).to_pylist()):
                fa, ga, fb, gb = (v[o[i] : o[i + 1]] for v, o in cols)
                found += forest(fa, ga.reshape(len(fa), -1), fb, gb.reshape(len(fb), -1), same, first, radius)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, bits: int = 64, first: int | None = None, blocks: int = 4, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc id, fp, component_id) for each row: component_id is the smallest id in reach."""
    own = stage(fingerprints(docs, words, bits, id_col, text_col), "fingerprints")
    nodes = stage(own.groupBy("fp").agg(F.min(id_col).alias("least"), F.first("sig").alias("sig")), "nodes")
    roots = connected_components(tiled_links(nodes.select("fp", "sig"), radius, first, blocks, tile))
    members = nodes.join(roots, nodes.fp == roots.node).select("fp", "least", "root")
    smallest = members.groupBy("root").agg(F.min("least").alias("m"))
    tops = nodes.join(roots, nodes.fp == roots.node, "left_anti").select("fp", "least").join(smallest, F.col("fp") == F.col("root"), "left")
    tops = stage(tops.select("fp", F.col("fp").alias("root"), F.least("least", "m").alias("component_id"), F.col("root").isNotNull().alias("group")), "tops")
    # A root may have most of all members: they meet it in SALTS parts.
    salted = tops.where("group").select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    named = members.withColumn("salt", F.expr(f"cast(pmod(xxhash64(fp, 11), {SALTS}) as int)")).join(salted, ["root", "salt"]).select("fp", "root", "component_id")
    return own.join(tops.drop("group").unionByName(named), "fp").select("key", id_col, "fp", "root", "component_id")


#: For documents whose sets of five-word shingles have a similarity of 0.8 or more: two texts at
#: 0.8 differ in about 78 of 512 bits, with a standard deviation of 8; unrelated ones in 256.
#: Larger tiles meet in fewer pairs, so less is shuffled; a pair holds at most some 3 MB.
NEAR = {"words": 5, "bits": 512, "radius": 98, "first": 20, "blocks": 1, "tile": 1 << 14}


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """docs with one document of each group of near copies under `rule` (NEAR if none is given):
    the one with the smallest id, and of those without an id the one with the smallest key."""
    found = stage(near_duplicates(docs, id_col=id_col, text_col=text_col, **(rule or NEAR)), "groups")
    best = found.groupBy("root").agg(F.min_by(F.struct("key", id_col), F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("key"))).alias("best")).select("best.*")
    # A key names one id, so the best rows' keys stand for them.
    gone = stage(found.select("key", id_col).distinct().join(best.select("key"), "key", "left_anti"), "gone")
    repeated = stage(found.groupBy("key", id_col).count().where("count > 1").join(best.select("key"), "key", "left_semi").select("key", id_col), "repeated")
    kept = without(docs, gone, text_col, id_col)
    if repeated.isEmpty():
        return kept
    key, other = fresh(docs, "key", "repeated_key")
    small = checked(repeated.select(F.col("key").alias(other)))
    kept = kept.withColumn(key, row_key(text_col, id_col))
    once = kept.join(small, F.col(key) == F.col(other), "left_semi").dropDuplicates([key])
    return kept.join(small, F.col(key) == F.col(other), "left_anti").unionByName(once).drop(key)


def op10(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
