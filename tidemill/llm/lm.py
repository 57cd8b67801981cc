"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation.

A token's probability is P(class | two classes before) * P(token | its class, class before).  The
OWN most frequent tokens are classes of their own; all others share classes by their last
characters.  The classes have embeddings; the score of a class is the inner product of its
embedding with the context's prediction (each context class's embedding, weighted by its place),
plus a bias.  Training compares each class with noise classes drawn from the class frequencies;
every task trains on its share of all training texts and the parameters are averaged, ROUNDS
times.  Batched matrix products then give, for all pairs of context classes, log-probabilities
that sum to one.

Within a class a token weighs (count + 1) * exp(w . x), where x is the embedding of the class
before and w the token's own embedding; a further 1 stands for all unseen tokens, and the sum of
a class's weights behind each class before normalises.  The WORDS most frequent tokens of shared
classes have a w, all others zero.  Given x, noise-contrastive estimation parts into one convex
problem a token: its counts behind each class against noise drawn from its class, whose
expectation is known.  Spark groups the counts by blocks of tokens, and a task solves a block.

Token counts cover all training texts.  Their most frequent part, a dictionary of at most
DICTIONARY tokens of at most LONGEST bytes, travels to the tasks; the other tokens of each
document are joined with the counts in a shuffle, so neither memory nor broadcast grows with the
vocabulary.

A null or empty text has one token, its end.  A null id counts as a training document.  Repeated
rows are trained on each and get equal scores.  Without training documents the counts are zero.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, row_key, share, stage

CLASSES, OWN, WIDTH = 256, 160, 24
DICTIONARY, LONGEST = 300_000, 64
#: Tokens with embeddings of their own within their class, and how many of them a task solves at once.
WORDS, BLOCK, NO_WORD = 1 << 15, 1 << 10, (1 << 16) - 1
ROUNDS, NOISE, BATCH, RATE = 2, 24, 4096, 0.1
#: Batches that a chunk trains at least, by further passes over it.
STEPS = 48
#: Tokens of training text from which batches are formed at once.
CHUNK = 2_000_000
#: The token that ends a text; no word is empty.
END = b""
HELD_OUT = (7, 2)


def tokens_of(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def class_of(token: bytes) -> int:
    """The class of a token that has none of its own: by its last two bytes."""
    return OWN + zlib.crc32(token[-2:]) % (CLASSES - OWN)


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n) over the texts of a single column."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])
            counts.clear()
            return out

        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                counts.update(tokens_of(t))
                if len(counts) > 300_000:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Dictionary:
    """The most frequent tokens with their classes and counts, and the totals of all classes."""

    def __init__(self, tokens: list[bytes], counts: list[int], class_n: np.ndarray, class_v: np.ndarray, own: list[bytes]):
        self.at = {t: i for i, t in enumerate(tokens)}
        place = {t: i for i, t in enumerate(own)}
        self.cls = np.fromiter((place.get(t, -1) if t in place else class_of(t) for t in tokens), np.uint8, len(tokens))
        self.log_n = np.log10(np.array(counts, np.float64) + 1)
        self.own, self.place = own, place
        self.class_n, self.class_mass = class_n, class_n + class_v + 1.0
        learned = np.flatnonzero(self.cls >= OWN)[:WORDS]
        self.word = np.full(len(tokens), NO_WORD, np.uint16)
        self.word[learned] = np.arange(len(learned))
        self.word_cls, self.word_n = self.cls[learned].astype(np.int64), np.array(counts, np.float64)[learned]

    def encode(self, text: bytes | None):
        """(classes, known tokens, sum of log10(count + 1): of all known, of those in shared classes; other tokens; words)."""
        tokens = tokens_of(text)
        at = np.fromiter(map(self.at.get, tokens, repeat(-1)), np.int64, len(tokens))
        known = at >= 0
        cls = np.empty(len(tokens), np.uint8)
        cls[known] = self.cls[at[known]]
        where = np.flatnonzero(~known)
        others = [tokens[i] for i in where]
        cls[where] = np.fromiter((self.place[t] if t in self.place else class_of(t) for t in others), np.uint8, len(others))
        logs = self.log_n[at[known]]
        words = np.full(len(tokens), NO_WORD, np.uint16)
        words[known] = self.word[at[known]]
        return cls, int(known.sum()), float(logs.sum()), float(logs[cls[known] >= OWN].sum()), Counter(others), words


def dictionary(counts: DataFrame) -> tuple[Dictionary, int, int, int]:
    """(dictionary, N, V, the least count of a token in the dictionary)."""
    n = F.col("n")
    # Exact below 2,048, then in steps of a 64th of a doubling: a few thousand bins at most.
    bin_ = F.when(n < 2048, n).otherwise(F.floor(2048 + 64 * (F.log2(n) - 11))).cast("long")
    bins = sorted(counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("k"), F.min("n").alias("least")).collect(), key=lambda r: -r["bin"])
    least, total = 1 << 62, 0
    for r in bins:
        total += r["k"]
        if total > DICTIONARY:
            break
        least = r["least"]
    rows = counts.where((n >= least) & (F.octet_length("token") <= LONGEST)).collect()
    rows.sort(key=lambda r: (-r["n"], bytes(r["token"])))
    tokens, ns = [bytes(r["token"]) for r in rows], [r["n"] for r in rows]
    own = [END, *[t for t in tokens if t != END][: OWN - 1]]
    own += [b"\x00 %d" % i for i in range(OWN - len(own))]  # classes without a token

    def classes(batches):
        sums = np.zeros((2, CLASSES), np.int64)
        own_ = frozenset(own)
        for b in batches:
            t, k = b.column(0).to_pylist(), b.column(1).to_numpy()
            cls = np.fromiter((class_of(x) for x in t), np.int64, len(t))
            mine = np.fromiter((x not in own_ for x in t), bool, len(t))
            sums[0] += np.bincount(cls[mine], weights=k[mine], minlength=CLASSES).astype(np.int64)
            sums[1] += np.bincount(cls[mine], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])], ["cls", "n", "v"])

    per = counts.mapInArrow(classes, "cls int, n long, v long").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per:
        class_n[r["cls"]], class_v[r["cls"]] = r["n"], r["v"]
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    return Dictionary(tokens, ns, class_n, class_v, own), whole["n"], whole["v"], least


class LogBilinear:
    """Parameters: embeddings r, context weights c (two places), biases b, which start at the classes' frequencies."""

    def __init__(self, frequency: np.ndarray | None = None, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.r = (rng.standard_normal((CLASSES, WIDTH)) * 0.1).astype(np.float32)
        self.c = np.full((2, WIDTH), 0.5, np.float32)
        self.b = np.zeros(CLASSES, np.float32) if frequency is None else np.log(frequency).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.r.ravel(), self.c.ravel(), self.b])

    def load(self, flat: np.ndarray) -> "LogBilinear":
        k = CLASSES * WIDTH
        self.r, self.c, self.b = flat[:k].reshape(CLASSES, WIDTH).astype(np.float32), flat[k : k + 2 * WIDTH].reshape(2, WIDTH).astype(np.float32), flat[k + 2 * WIDTH :].astype(np.float32)
        return self

    def fit(self, codes: np.ndarray, weights: np.ndarray, noise: np.ndarray, rng: np.random.Generator, grads: list[np.ndarray]) -> None:
        """One pass of noise-contrastive estimation over trigrams (code = before2, before1, class) with weights."""
        log_noise = np.log(NOISE * noise).astype(np.float32)
        order = rng.permutation(len(codes))
        for k in range(0, len(codes), BATCH):
            part = order[k : k + BATCH]
            c2, c1, w = codes[part] >> 16, codes[part] >> 8 & 255, codes[part] & 255
            n = weights[part].astype(np.float32)
            n /= n.sum()
            q = self.c[0] * self.r[c1] + self.c[1] * self.r[c2]
            draws = rng.choice(CLASSES, NOISE, p=noise)
            up = 1 - _sigmoid((q * self.r[w]).sum(axis=1) + self.b[w] - log_noise[w])
            down = -_sigmoid(q @ self.r[draws].T + self.b[draws] - log_noise[draws])
            up, down = up * n, down * n[:, None]
            dq = up[:, None] * self.r[w] + down @ self.r[draws]
            hot = np.zeros((CLASSES, len(part)), np.float32)
            at = np.arange(len(part))
            hot[w, at] = up
            dr, db = hot @ q, hot.sum(axis=1)
            np.add.at(dr, draws, down.T @ q)
            np.add.at(db, draws, down.sum(axis=0))
            for place, ctx in ((0, c1), (1, c2)):
                hot[:] = 0
                hot[ctx, at] = 1
                dr += hot @ (dq * self.c[place])
            dc = np.stack([(dq * self.r[c1]).sum(axis=0), (dq * self.r[c2]).sum(axis=0)])
            for p, d, g in zip((self.r, self.c, self.b), (dr, dc, db), grads):
                g += d * d
                p += RATE * d / np.sqrt(g)

    def table(self) -> np.ndarray:
        """log10 P(class | before2, before1), of shape (CLASSES ** 2, CLASSES): row before2 * CLASSES + before1."""
        out = np.empty((CLASSES * CLASSES, CLASSES), np.float32)
        first = self.r * self.c[0]
        for c2 in range(CLASSES):
            s = (first + self.r[c2] * self.c[1]) @ self.r.T + self.b
            s -= s.max(axis=1, keepdims=True)
            s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
            out[c2 * CLASSES : (c2 + 1) * CLASSES] = s / np.log(10)
        return out


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(block, word, before, n): how often a word stands behind a class, over rows of encoded(classes, words);
    in block -1 word is a class."""

    def run(batches):
        seen, waiting = 0, []

        def flush():
            codes, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            word, before = codes >> 8, codes & 255
            arrays = [np.where(word < WORDS, word % (WORDS // BLOCK), -1), np.where(word < WORDS, word, word - WORDS), before]
            return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in arrays), pa.array(n)], ["block", "word", "before", "n"])

        for b in batches:
            for c, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cls, word = np.frombuffer(c, np.uint8).astype(np.int64), np.frombuffer(w, np.uint16).astype(np.int64)
                before = np.concatenate([np.zeros(1, np.int64), cls[:-1]])
                waiting += [(word << 8 | before)[word != NO_WORD], (WORDS + cls << 8 | before)[cls >= OWN]]
                seen += len(cls)
                if seen >= CHUNK:
                    yield flush()
                    seen = 0
        if waiting:
            yield flush()

    return encoded.select("classes", "words").mapInArrow(run, "block int, word int, before int, n long").groupBy("block", "word", "before").agg(F.sum("n").alias("n"))


def contexts(model: LogBilinear, frequency: np.ndarray) -> np.ndarray:
    """What words see of the class before them: its embedding, of mean 0 and variance 1, and a 1."""
    mean = frequency @ model.r
    spread = np.sqrt(frequency @ (model.r - mean) ** 2 + 1e-6)
    return np.concatenate([(model.r - mean) / spread, np.ones((CLASSES, 1))], axis=1)


def word_embeddings(n: np.ndarray, noise: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The embedding of each row of n, counts behind each class, against expected noise counts, by damped Newton steps.

    A word's weight over its class's noise is exp(w . x) / NOISE.  The penalty stands for a w . x of variance 1."""
    w, both = np.zeros((len(n), x.shape[1])), n + noise
    squares = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    for _ in range(8):
        p = _sigmoid(w @ x.T - np.log(NOISE))
        slope = (n - both * p) @ x - WIDTH * w
        curve = ((both * p * (1 - p)) @ squares).reshape(len(n), x.shape[1], -1) + WIDTH * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
        w += step / np.maximum(1, np.abs(step @ x.T).max(axis=1, keepdims=True) / 1.5)
    return w


def train_words(encoded: DataFrame, words: Dictionary, x: np.ndarray) -> np.ndarray:
    """The embeddings of all words, a row each."""
    spark = encoded.sparkSession
    pairs = stage(pair_counts(encoded), "pairs")
    behind = np.zeros((CLASSES, CLASSES))
    for r in pairs.where("block = -1").collect():  # at most a row for two classes
        behind[r["word"], r["before"]] = r["n"]
    shared = share(spark, (behind, x, words.word_cls, words.word_n / np.maximum(1, words.class_n[words.word_cls])))

    def solve(table):
        behind_, x_, cls, part = pickle.loads(shared.value)
        word, before, n = (table.column(c).to_numpy() for c in ("word", "before", "n"))
        mine, at = np.unique(word, return_inverse=True)
        counts = np.zeros((len(mine), CLASSES))
        counts[at, before] = n
        found = word_embeddings(counts, NOISE * behind_[cls[mine]] * part[mine, None], x_).astype(np.float32)
        return pa.table({"word": pa.array(mine, pa.int32()), "w": pa.array([v.tobytes() for v in found], pa.binary())})

    out = np.zeros((len(words.word_cls), x.shape[1]), np.float32)
    for r in pairs.where("block >= 0").groupBy("block").applyInArrow(solve, "word int, w binary").collect():  # at most WORDS rows
        out[r["word"]] = np.frombuffer(r["w"], np.float32)
    return out


def class_totals(words: Dictionary, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The sum of the weights of each class's tokens behind each class."""
    out = np.repeat(words.class_mass[:, None], CLASSES, axis=1)
    for i in range(0, len(w), 4096):
        cls = words.word_cls[i : i + 4096]
        hot = np.zeros((CLASSES, len(cls)))
        hot[cls, np.arange(len(cls))] = words.word_n[i : i + 4096] + 1
        out += hot @ np.expm1(w[i : i + 4096] @ x.T)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def trigrams(cls: np.ndarray) -> np.ndarray:
    """Codes of a text's trigrams of classes; the text starts after two ends."""
    padded = np.concatenate([np.zeros(2, np.int64), cls])
    return padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]


def train(encoded: DataFrame, noise: np.ndarray) -> LogBilinear:
    """The model of all rows of encoded(classes)."""
    model = LogBilinear(noise)
    for turn in range(ROUNDS):
        start = model.flat()

        def run(batches, start=start, turn=turn):
            own, seen = LogBilinear().load(start), 0
            rng = np.random.default_rng([turn, 7])
            grads = [np.full(x.shape, 1e-4, np.float32) for x in (own.r, own.c, own.b)]
            waiting: list[np.ndarray] = []

            def learn():
                codes, n = np.unique(np.concatenate(waiting), return_counts=True)
                for _ in range(max(1, STEPS * BATCH // len(codes))):
                    own.fit(codes, n, noise, rng, grads)
                waiting.clear()

            for b in batches:
                for x in b.column(0).to_pylist():
                    waiting.append(trigrams(np.frombuffer(x, np.uint8).astype(np.int64)))
                    seen += len(x)
                    if seen % CHUNK < len(x):
                        learn()
            if waiting:
                learn()
            if seen:
                flat = np.concatenate([own.flat().astype(np.float64) * seen, [seen]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "x"])

        rows = encoded.select("classes").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # a row a parameter
        if not rows:
            return model
        flat = np.zeros(len(rows))
        for r in rows:
            flat[r["i"]] = r["x"]
        model.load(flat[:-1] / flat[-1])
    return model


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs."""
    spark = docs.sparkSession
    mod, rest = HELD_OUT
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))
    counts = stage(token_counts(docs.where(~held).select(text_col)), "counts")
    words, n, v, least = dictionary(counts)
    shared = share(spark, words)  # of at most DICTIONARY tokens
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches):
        dictionary_ = pickle.loads(shared.value)
        for b in batches:
            rows = [dictionary_.encode(t) for t in b.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), b.column(2), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows]), pa.array([r[0].tobytes() for r in rows], pa.binary()),
                    pa.array([list(r[4]) for r in rows], pa.list_(pa.binary())), pa.array([list(r[4].values()) for r in rows], pa.list_(pa.int32())),
                    pa.array([r[5].tobytes() for r in rows], pa.binary()),
                ],
                ["key", id_col, "held_out", "n_tokens", "known", "log_all", "log_shared", "classes", "others", "times", "words"],
            )

    source = docs.select(row_key(text_col, id_col).alias("key"), F.col(id_col), held.alias("held_out"), F.col(text_col))
    encoded = stage(source.mapInArrow(encode, f"key long, {id_col} {kind}, held_out boolean, n_tokens long, known long, log_all double, log_shared double, classes binary, others array<binary>, times array<int>, words binary"), "encoded")
    own_n = np.zeros(CLASSES)
    in_own = [10 ** words.log_n[words.at[t]] - 1 if t in words.at else 0.0 for t in words.own]
    own_n[:OWN] = in_own
    frequency = own_n + (words.class_mass - 1) * (np.arange(CLASSES) >= OWN) + 1
    frequency /= frequency.sum()
    model = train(encoded.where("not held_out"), frequency)
    x = contexts(model, frequency)
    w = train_words(encoded.where("not held_out"), words, x)

    # Tokens beyond the dictionary meet their counts in a shuffle; unseen ones add nothing and fall out.
    pairs = encoded.select("key", F.explode(F.arrays_zip("others", "times")).alias("o")).select("key", F.col("o.others").alias("token"), F.col("o.times").alias("times"))
    found = pairs.join(counts.where((F.col("n") < least) | (F.octet_length("token") > LONGEST)), "token")
    found = found.groupBy("key").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_log"))
    rows = encoded.groupBy("key").agg(F.count("*").alias("rows"))  # repeated rows share a key
    # At most WORDS embeddings and some tables of the classes.
    trained = share(spark, (model.flat(), w, (x / np.log(10)).astype(np.float32), np.log10(class_totals(words, w, x)).astype(np.float32)))

    def score(batches):
        flat, own_w, own_x, totals = pickle.loads(trained.value)
        table = LogBilinear().load(flat).table()
        for b in batches:
            out = []
            for c, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes = trigrams(np.frombuffer(c, np.uint8).astype(np.int64))
                cls, before, word = codes & 255, codes >> 8 & 255, np.frombuffer(word, np.uint16)
                total, far = table[codes >> 8, cls].sum(dtype=np.float64), cls >= OWN
                total -= totals[cls[far], before[far]].sum(dtype=np.float64)
                own = np.flatnonzero(word != NO_WORD)
                for i in range(0, len(own), BATCH):
                    at = own[i : i + BATCH]
                    total += np.einsum("ij,ij->", own_w[word[at]], own_x[before[at]])
                out.append(float(total))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(out, pa.float64())], ["key", id_col, "held_out", "n_tokens", "known", "log_all", "log_shared", "class_score"])

    scored = encoded.select("classes", "words", "key", id_col, "held_out", "n_tokens", "known", "log_all", "log_shared")
    scored = scored.mapInArrow(score, f"key long, {id_col} {kind}, held_out boolean, n_tokens long, known long, log_all double, log_shared double, class_score double")
    joined = scored.join(found.join(rows, "key").select("key", (F.col("more") / F.col("rows")).cast("long").alias("more"), (F.col("more_log") / F.col("rows")).alias("more_log")), "key", "left")
    more, more_log = F.coalesce("more", F.lit(0)), F.coalesce("more_log", F.lit(0.0))
    whole = float(np.log10(n + v + 1.0))
    return joined.select(
        id_col, "held_out", "n_tokens", (F.col("known") + more).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("log_all") + more_log - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("class_score") + F.col("log_shared") + more_log).alias("score"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return scores(read(spark, sf_dir, "documents"))
