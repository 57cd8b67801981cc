"""Near copies among embeddings by a robust-pruned flat graph.

Centroids, fitted on a bounded sample, deal each distinct vector to its nearest `overlap` clusters.
Each cluster shard becomes a graph: points come in batches of growing size, walk the graph so far
greedily from the medoid, and keep neighbours under the robust pruning rule (a candidate goes when a
kept neighbour is nearer to it by the factor alpha than the point is).  The adjacency lists of a node
from all its shards are united.  Then each vector walks the united graph greedily from the medoid of
each of its shards with a beam; where the beam meets vectors within range, the search expands all
nodes within a somewhat wider range until no more are found.  Pairs found are verified by their cosine
in double precision; nothing below the threshold is linked.

A walk stays among its shard's nodes, so that links never leave a task as pairs: a task passes on the
number of links of each vector and a spanning forest.  A pair that shares several clusters counts in
the first of them.  A cluster beyond `tile` vectors is split by a hash into tiles with a graph each, and
every vector of the cluster walks each tile's graph: hot clusters are searched whole.

Recall is audited: at most AUDIT vectors are compared with all others by brute force, and while less
than `recall` of their links is found, overlap and beam are doubled, up to three times.

Vectors that are null, zero, or hold null or non-finite components link with nothing, as do vectors of
different lengths.  Equal vectors are one node with a number, so copies give no pairs; all of them link.
Rows with no id count as rows, but name no component.  An empty table gives an empty result.  Other
columns are not looked at.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, read, share, stage
from .negatives import usable

#: Vectors that the centroids are fitted on at most, and centroids at most.
SAMPLE, CENTROIDS = 32_768, 1024
#: Vectors of a cluster on average, and most of a tile.
SHARD, TILE = 2048, 4096
#: Vectors that the audit compares with all others.
AUDIT = 1024
#: Neighbours after pruning, and room for those that come later.
DEGREE, ROOM = 20, 32
#: Points that enter a graph at once, and queries that walk at once.
BATCH = 256


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision.  Scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k directions by spherical k-means."""
    rng = np.random.default_rng(7)
    c = sample[rng.permutation(len(sample))[:k]]
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        long = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(long > 0, total / np.maximum(long, 1e-30), c)
    return c


class Graph:
    """A flat graph over unit vectors: neighbours in rows, -1 where there is none."""

    def __init__(self, vecs: np.ndarray, edges: np.ndarray | None = None):
        self.v = vecs
        self.start = int((vecs @ vecs.mean(axis=0)).argmax())
        self.edges = np.full((len(vecs), ROOM), -1, np.int64) if edges is None else edges

    def walk(self, asked: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query when nothing in it is left to expand: (nodes, similarities)."""
        n = len(asked)
        nodes, sims, done = np.full((n, beam), -1, np.int64), np.full((n, beam), -np.inf, np.float32), np.ones((n, beam), bool)
        nodes[:, 0], sims[:, 0], done[:, 0] = self.start, asked @ self.v[self.start], False
        live = np.arange(n)
        while len(live):
            left = np.where(done[live], -np.inf, sims[live])
            at = left.argmax(axis=1)
            some = left[np.arange(len(live)), at] > -np.inf
            live, at = live[some], at[some]
            if not len(live):
                break
            done[live, at] = True
            own = nodes[live]
            new = self.edges[own[np.arange(len(live)), at]]
            known = (new < 0) | (new[:, :, None] == own[:, None, :]).any(axis=2)
            near = np.matmul(self.v[new], asked[live][:, :, None])[:, :, 0]
            all_sims = np.concatenate([sims[live], np.where(known, -np.inf, near)], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            take = lambda x: np.take_along_axis(x, top, axis=1)
            sims[live] = take(all_sims)
            nodes[live] = take(np.concatenate([own, new], axis=1))
            done[live] = take(np.concatenate([done[live], known], axis=1)) | (sims[live] == -np.inf)
        return np.where(sims > -np.inf, nodes, -1), sims

    def prune(self, points: np.ndarray, some: np.ndarray, alpha: float) -> np.ndarray:
        """Of each point's candidates (-1: none) at most DEGREE, by the robust rule."""
        some = np.where(some == points[:, None], -1, some)
        order = np.sort(some, axis=1)  # a candidate that stands twice counts once
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
        x = self.v[order]
        sims = np.where(order >= 0, np.matmul(x, self.v[points][:, :, None])[:, :, 0], -np.inf)
        between = np.matmul(x, x.transpose(0, 2, 1))
        out, rows = np.full((len(points), ROOM), -1, np.int64), np.arange(len(points))
        for k in range(DEGREE):
            at = sims.argmax(axis=1)
            has = sims[rows, at] > -np.inf
            if not has.any():
                break
            out[has, k] = order[rows, at][has]
            # Squared distances of unit vectors are 2 - 2 cos.
            gone = alpha * alpha * (1 - between[rows, at]) <= 1 - sims
            gone[rows, at] = True
            sims[gone] = -np.inf
        return out

    def insert(self, batch: np.ndarray, beam: int, alpha: float) -> None:
        found, _ = self.walk(self.v[batch], beam)
        k = min(8, len(batch))
        among = batch[np.argpartition(-(self.v[batch] @ self.v[batch].T), k - 1, axis=1)[:, :k]]
        own = self.prune(batch, np.concatenate([found, among], axis=1), alpha)
        self.edges[batch] = own
        # The other direction: neighbours take the new points in, and are pruned where they have no room.
        to, back = own[own >= 0], np.repeat(batch, (own >= 0).sum(axis=1))
        order = np.lexsort((-(self.v[to] * self.v[back]).sum(axis=1), to))
        to, back = to[order], back[order]
        points, begin, n = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(begin, n)
        new = np.full((len(points), ROOM), -1, np.int64)
        fits = place < ROOM
        new[np.repeat(np.arange(len(points)), n)[fits], place[fits]] = back[fits]
        old = self.edges[points]
        both = np.concatenate([old, new], axis=1)
        roomy = ((both >= 0).sum(axis=1) <= ROOM) & ~((new[:, :, None] == old[:, None, :]) & (new[:, :, None] >= 0)).any(axis=(1, 2))
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :ROOM]
        self.edges[points[roomy]] = packed[roomy]
        for i in range(0, int((~roomy).sum()), 1024):
            part = np.flatnonzero(~roomy)[i : i + 1024]
            self.edges[points[part]] = self.prune(points[part], both[part], alpha)

    def build(self, beam: int, alpha: float = 1.2) -> None:
        order = np.random.default_rng(11).permutation(len(self.v))
        order = np.concatenate([[self.start], order[order != self.start]])
        at = 1
        while at < len(order):
            to = min(len(order), 2 * at, at + BATCH)
            self.insert(order[at:to], beam, alpha)
            at = to

    def within(self, asked: np.ndarray, beam: int, least: float, wider: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) with a similarity of `least` or more: walks, then expands what is within `wider`."""
        nodes, sims = self.walk(asked, beam)
        n = len(self.v)
        seen = np.zeros((len(asked), n), bool)
        q, at = np.nonzero(nodes >= 0)
        seen[q, nodes[q, at]] = True
        q, at = np.nonzero(sims >= wider)
        front, hit = (q, nodes[q, at]), sims[q, at] >= least
        found = [(q[hit], nodes[q, at][hit])]
        while len(front[0]):
            parts = []
            for i in range(0, len(front[0]), 1 << 14):
                q, x = front[0][i : i + (1 << 14)], front[1][i : i + (1 << 14)]
                new = self.edges[x]
                code = np.unique((q[:, None] * n + new)[new >= 0])
                q, x = code // n, code % n
                fresh = ~seen[q, x]
                q, x = q[fresh], x[fresh]
                seen[q, x] = True
                s = (self.v[x] * asked[q]).sum(axis=1)
                found.append((q[s >= least], x[s >= least]))
                parts.append((q[s >= wider], x[s >= wider]))
            front = tuple(np.concatenate(c) for c in zip(*parts))
        return tuple(np.concatenate(c) for c in zip(*found))


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places of pairs (sorted by a) that make a spanning forest of n nodes."""
    label, keep = np.arange(n), []
    heads, begin, size = np.unique(a, return_index=True, return_counts=True)
    for x, i, k in zip(heads, begin, size):
        labels, at = np.unique(label[b[i : i + k]], return_index=True)
        other = labels != label[x]
        if other.any():
            keep.append(i + at[other])
            label[np.isin(label, labels[other])] = label[x]
    return np.concatenate(keep) if keep else np.zeros(0, np.int64)


def shards(nodes: DataFrame, overlap: int, dims: dict[int, int]) -> DataFrame:
    """nodes with `shards`, the numbers of their nearest `overlap` centroids (fitted for each vector length)."""
    n = sum(dims.values())
    every = max(1, -(-n // (SAMPLE // 2)))
    sample = nodes.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(every)) == 0).select("vec").limit(SAMPLE).toArrow().column(0).to_pylist()
    fitted = {}
    for d, count in dims.items():
        own = [v for v in sample if len(v) == d]
        k = min(CENTROIDS, -(-count // SHARD), len(own))
        if k > 1:
            fitted[d] = centroids(unit(np.array(own)), k)
    shared = share(nodes.sparkSession, fitted)  # at most CENTROIDS directions a length, of at most SAMPLE vectors

    def run(batches):
        fits = pickle.loads(shared.value)
        for b in batches:
            vecs, out = b.column(1), []
            flat, ends = vecs.flatten().to_numpy(), np.diff(vecs.offsets.to_numpy())
            at = np.concatenate([[0], np.cumsum(ends)])
            out = [[0]] * b.num_rows
            for d in np.unique(ends):
                if int(d) in fits:
                    c, rows = fits[int(d)], np.flatnonzero(ends == d)
                    for i in range(0, len(rows), 4096):
                        part = rows[i : i + 4096]
                        s = unit(flat[at[part][:, None] + np.arange(d)]) @ c.T
                        k = min(overlap, s.shape[1])
                        near = np.sort(np.argpartition(-s, k - 1, axis=1)[:, :k], axis=1)
                        for row, x in zip(part, near.tolist()):
                            out[row] = x
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.int32()))], ["key", "vec", "n", "shards"])

    kind = nodes.schema["vec"].dataType.simpleString()
    return nodes.select("key", "vec", "n").mapInArrow(run, f"key long, vec {kind}, n long, shards array<int>").withColumn("dim", F.size("vec"))


def gathered(members: DataFrame, *lists: str) -> DataFrame:
    """Tiles (dim, shard, tile) with their members' columns as lists, by key."""
    rows = members.groupBy("dim", "shard", "tile").agg(F.sort_array(F.collect_list(F.struct("key", *lists))).alias("all"))
    pick = lambda c: F.transform("all", lambda x: x[c])
    return rows.select("dim", "shard", "tile", pick("key").alias("keys"), *[(F.flatten(pick(c)) if c == "vec" else pick(c)).alias(c) for c in lists])


def links(nodes: DataFrame, threshold: float, overlap: int, beam: int, tile: int, dims: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """(key, links to other nodes' rows) and edges (a, b) that connect all linked nodes."""
    dealt = stage(shards(nodes, overlap, dims), "dealt")
    members = dealt.withColumn("shard", F.explode("shards"))
    # At most CENTROIDS rows a vector length.
    parts = members.groupBy("dim", "shard").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    members = stage(members.join(F.broadcast(parts), ["dim", "shard"]).withColumn("tile", F.expr("cast(pmod(xxhash64(key, 9), parts) as int)")), "members")
    n = 2 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def build(batches):
        for b in batches:
            for i in range(b.num_rows):
                keys, dim = np.asarray(b.column(1)[i].values), b.column(0)[i].as_py()
                g = Graph(unit(np.asarray(b.column(2)[i].values).reshape(len(keys), dim)).astype(np.float32))
                g.build(beam)
                has = g.edges >= 0
                near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has.sum(axis=1))]).astype(np.int32)), pa.array(keys[g.edges[has]]))
                yield pa.RecordBatch.from_arrays([pa.array(keys), near], ["key", "near"])

    tiles = gathered(members, "vec").repartition(n, "dim", "shard", "tile").select("dim", "keys", "vec")
    united = tiles.mapInArrow(build, "key long, near array<long>").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a list for each of a node's `overlap` shards
    full = stage(gathered(members.join(united, "key"), "vec", "n", "shards", "near"), "graph")
    other = full.select("dim", "shard", F.col("tile").alias("from"), F.col("keys").alias("a_keys"), F.col("vec").alias("a_vec"), F.col("n").alias("a_n"), F.col("shards").alias("a_shards"))
    # Most clusters have one tile; the vectors of a larger one walk the graphs of all its tiles.
    pairs = full.join(other, ["dim", "shard"]).repartition(n, "dim", "shard", "tile", "from").select("dim", "shard", "keys", "vec", "n", "shards", "near", "a_keys", "a_vec", "a_n", "a_shards")

    def search(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from searched(*(c[i].as_py() if k < 2 else c[i].values for k, c in enumerate(b.columns)))

    def lists(x, width: int, fill: int) -> np.ndarray:
        size, out = np.diff(x.offsets.to_numpy()), None
        out = np.full((len(size), max(width, int(size.max(initial=0)))), fill, np.int64)
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = x.flatten().to_numpy()
        return out

    def searched(dim, shard, keys, vec, n, own_shards, near, a_keys, a_vec, a_n, a_shards):
        keys, a_keys, n = np.asarray(keys), np.asarray(a_keys), np.asarray(n)
        whole, a_whole = (unit(np.asarray(v).reshape(-1, dim)) for v in (vec, a_vec))
        near = lists(near, 1, -1)
        at = np.minimum(np.searchsorted(keys, near), len(keys) - 1)
        g = Graph(whole.astype(np.float32), np.where((near >= 0) & (keys[at] == near), at, -1))
        x_in, a_in = lists(own_shards, 1, -1), lists(a_shards, 1, -2)
        same = len(keys) == len(a_keys) and bool((keys == a_keys).all())
        asked, wider = a_whole.astype(np.float32), np.cos(1.25 * np.arccos(threshold))
        hits = [g.within(asked[j : j + BATCH], beam, threshold - 1e-4, wider) for j in range(0, len(asked), BATCH)]
        q, x = np.concatenate([h[0] + j * BATCH for j, h in enumerate(hits)]), np.concatenate([h[1] for h in hits])
        if same:  # a link found from one end holds from both
            code = np.unique(np.concatenate([q * len(keys) + x, x * len(keys) + q]))
            q, x = code // len(keys), code % len(keys)
        good = np.zeros(len(q), bool)
        for j in range(0, len(q), 1 << 16):
            a, c = q[j : j + (1 << 16)], x[j : j + (1 << 16)]
            ok = (a_whole[a] * whole[c]).sum(axis=1) >= threshold
            # A pair counts in the first cluster that it shares.
            common = np.where((a_in[a][:, :, None] == x_in[c][:, None, :]).any(axis=2), a_in[a], np.iinfo(np.int64).max).min(axis=1)
            good[j : j + (1 << 16)] = ok & (a_keys[a] != keys[c]) & (common == shard)
        order = np.lexsort((x[good], q[good]))
        q, x = q[good][order], x[good][order]
        count = np.bincount(q, weights=n[x], minlength=len(a_keys)).astype(np.int64)
        some = np.flatnonzero(count)
        shift = 0 if same else len(keys)
        tree = spanning(q + shift, x, len(keys) + (0 if same else len(a_keys)))
        none = pa.nulls
        yield pa.RecordBatch.from_arrays([pa.array(a_keys[some]), none(len(some), pa.int64()), pa.array(count[some])], ["a", "b", "links"])
        yield pa.RecordBatch.from_arrays([pa.array(a_keys[q[tree]]), pa.array(keys[x[tree]]), none(len(tree), pa.int64())], ["a", "b", "links"])

    found = stage(pairs.mapInArrow(search, "a long, b long, links long"), "links")
    return found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links")), found.where("b is not null").select("a", "b")


def true_links(nodes: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """(key, links) of at most AUDIT asked nodes, by brute force over all nodes."""
    got = asked.select("key", "vec").limit(AUDIT).toArrow()
    by: dict[int, list] = {}
    for k, v in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        by.setdefault(len(v), []).append((k, v))
    shared = share(nodes.sparkSession, {d: (np.array([k for k, _ in r]), unit(np.array([v for _, v in r]))) for d, r in by.items()})

    def run(batches):
        mine = pickle.loads(shared.value)
        for b in batches:
            vecs, key, n = b.column(1), b.column(0).to_numpy(), b.column(2).to_numpy()
            flat, ends = vecs.flatten().to_numpy(), np.diff(vecs.offsets.to_numpy())
            at = np.concatenate([[0], np.cumsum(ends)])
            for d, (keys, v) in mine.items():
                total, rows = np.zeros(len(keys), np.int64), np.flatnonzero(ends == d)
                for i in range(0, len(rows), 1024):
                    part = rows[i : i + 1024]
                    hit = (v @ unit(flat[at[part][:, None] + np.arange(d)]).T >= threshold) & (keys[:, None] != key[part][None, :])
                    total += hit @ n[part]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], ["key", "links"])

    return nodes.select("key", "vec", "n").mapInArrow(run, "key long, links long").groupBy("key").agg(F.sum("links").alias("links"))


def near_vectors(emb: DataFrame, threshold: float = 0.95, overlap: int = 4, beam: int = 24, tile: int = TILE, recall: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) for each row: links at a cosine of `threshold` or more,
    the smallest id in reach, and the share of the audited vectors' links that were found."""
    kind = "array<float>" if emb.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    vec = F.col(vec_col).cast(kind)
    rows = emb.select(F.col(id_col).alias("vec_id"), F.when(usable(vec) & F.exists(vec, lambda x: x != 0), vec).alias("vec"))
    rows = stage(rows.withColumn("h", F.xxhash64("vec")), "vectors")
    nodes = rows.where("vec is not null").groupBy("h", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    nodes = stage(nodes.withColumn("key", F.monotonically_increasing_id()), "nodes")
    dims = {r[0]: r[1] for r in nodes.groupBy(F.size("vec")).count().collect()}  # a row a vector length
    n = sum(dims.values())
    every = max(1, -(-2 * n // AUDIT))
    asked = stage(nodes.where(F.pmod(F.xxhash64("key", F.lit(13)), F.lit(every)) == 0).orderBy("key").limit(AUDIT), "audited")
    truth = stage(true_links(nodes, asked, threshold), "truth")
    for _ in range(4):
        counts, edges = links(nodes, threshold, overlap, beam, tile, dims)
        got, want = truth.join(counts.withColumnRenamed("links", "found"), "key", "left").agg(F.sum(F.least("links", F.coalesce("found", F.lit(0)))), F.sum("links")).first()
        share_found = got / want if want else 1.0
        if share_found >= recall:
            break
        overlap, beam = 2 * overlap, 2 * beam
    else:
        raise RuntimeError(f"the index finds {share_found:.2f} of the links, less than {recall}")
    roots = connected_components(edges)
    named = nodes.select("key", "h", "vec", "least", "n").join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    # A root may have most nodes below it: partial minima first, and the join back can be split.
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    own = named.join(least, "root").join(counts, "key", "left").select("h", "vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    alone = F.col("vec").isNull()
    joined = rows.join(own.withColumnRenamed("vec", "v"), (rows.h == own.h) & (F.col("vec") == F.col("v")), "left")
    out = joined.select("vec_id", F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).withColumn("recall", F.lit(float(share_found)))


def op12(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
