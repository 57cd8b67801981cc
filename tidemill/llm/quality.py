"""Quality classifier: overlapping heuristic labellers, a weak-label model, a hashed linear scorer.

Each labeller votes good (1), bad (0) or not at all (-1) on a document.  Expectation-maximisation
over the counts of vote patterns (3 ** labellers at most) estimates their accuracies; the
posteriors of TRAIN_DOCS documents, those with the least hashes, train a logistic scorer over
hashed words and shapes, which scores every document.

A null or empty text has no words: all labellers that need words abstain, and its score is that of
the bias and the shapes alone.  Repeated rows get equal scores.  Without documents the result is
empty.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, row_key, stage
from .weak import Reliabilities, logistic

#: Documents that the scorer is fitted on at most.
TRAIN_DOCS = 6_000
BUCKETS = 1 << 16
#: Score from which a document is good.
GOOD = 0.5

#: Frequent function words of the languages looked for (fixed values).
STOP_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in a is that it was for on are as with be by this from or "
        "der die und das den von zu mit ist ein eine im auf für sich nicht auch "
        "de la le les des et en un une du est que qui dans pour pas sur par au "
        "el los las que y en se del por con una su para es al lo como"
    ).split()
)
_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128))
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_SYMBOL = bytes(c for c in range(256) if c not in b"#*$%&|<>{}[]=~^\\@_+!")
LABELLERS = ("length", "letters", "symbols", "case", "stop_words", "word_length", "lines", "variety")


def votes_of(text: bytes) -> list[int]:
    """The labellers' votes."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] + [-1] * (len(LABELLERS) - 1)
    chars = sum(map(len, words))
    letters = len(text.translate(None, _LETTERS)) / chars
    symbols = len(text.translate(None, _NOT_SYMBOL)) / chars
    upper = len(text.translate(None, _NOT_UPPER)) / chars
    low = text.lower().split()
    kinds = set(low)
    stops = sum(w in STOP_WORDS for w in low) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines)
    ended = sum(x.rstrip()[-1:] in b".!?\"'" for x in lines) / len(lines)
    mean = chars / n
    variety = len(kinds) / min(n, (1000 * n) ** 0.5)  # a text's distinct words grow as the root of its length
    pick = lambda good, bad: 1 if good else 0 if bad else -1
    return [
        pick(n >= 80, n < 40),
        pick(letters > 0.93, letters < 0.8),
        pick(symbols < 0.02, symbols > 0.08),
        pick(upper < 0.1, upper > 0.4),
        pick(stops > 0.12, stops < 0.03),
        pick(3.5 < mean < 8, mean < 2.5 or mean > 12),
        pick(ended > 0.6 and again < 0.1, ended < 0.2 or again > 0.3),
        pick(variety > 0.35, variety < 0.15),
    ]


def features_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): words with damped, length-free weights, and the text's shapes."""
    words = text.lower().split()
    n = len(words)
    crc = zlib.crc32
    names, counts = np.unique(np.fromiter((crc(w) for w in words), np.int64, n) % (BUCKETS - 64), return_counts=True)
    x = np.sqrt(counts)
    x = x / max(1.0, np.sqrt((x * x).sum()))
    chars = max(1, sum(map(len, words)))
    shares = (len(text.translate(None, _NOT_SYMBOL)), len(text.translate(None, _NOT_UPPER)), len(text.translate(None, _LETTERS)))
    shape = [min(7, int(8 * s / chars)) + 8 * i for i, s in enumerate(shares)] + [24 + min(15, n.bit_length()), 40 + min(15, int(chars / max(1, n)))]
    return np.concatenate([names, BUCKETS - 64 + np.array(shape)]), np.concatenate([x, np.ones(len(shape))])


def weak_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc id, votes) for each row of docs."""

    def run(batches):
        for b in batches:
            votes = [votes_of(t or b"") for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(votes, pa.list_(pa.int8()))], ["key", id_col, "votes"])

    source = docs.select(row_key(text_col, id_col).alias("key"), F.col(id_col), F.col(text_col))
    return source.mapInArrow(run, f"key long, {id_col} {docs.schema[id_col].dataType.simpleString()}, votes array<tinyint>")


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc id, votes, weak_label, score, good) for each row of docs."""
    spark = docs.sparkSession
    labels = stage(weak_labels(docs, id_col, text_col), "votes")
    patterns = labels.groupBy("votes").count().collect()  # at most 3 ** 8
    v = np.array([r["votes"] for r in patterns], np.int64).reshape(-1, len(LABELLERS))
    model = Reliabilities(v, np.array([r["count"] for r in patterns]), share=(0.05, 0.95))
    posterior = {tuple(p): float(q) for p, q in zip(v.tolist(), model.posterior(v))}

    place = F.xxhash64(F.lit(11), row_key(text_col, id_col))
    least = labels.select("key", "votes", F.xxhash64(F.lit(11), "key").alias("place")).dropDuplicates(["place"]).orderBy("place", "key").limit(TRAIN_DOCS).select("place", "votes").collect()
    if not least:
        weights = np.zeros(BUCKETS + 1)
    else:
        target = {r["place"]: posterior[tuple(r["votes"])] for r in least}
        last = max(target)

        def featured(batches):
            for b in batches:
                rows = [features_of(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["place", "at", "x"])

        sample = docs.select(place.alias("place"), F.col(text_col)).where(F.col("place") <= last).dropDuplicates(["place"])  # TRAIN_DOCS rows at most
        rows = sorted(sample.mapInArrow(featured, "place long, at array<int>, x array<float>").collect(), key=lambda r: r["place"])
        weights = logistic([np.array(r["at"]) for r in rows], np.array([target[r["place"]] for r in rows]), BUCKETS, [np.array(r["x"]) for r in rows])
    shared = spark.sparkContext.broadcast(weights)  # of fixed size

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                at, x = features_of(t or b"")
                out.append(float(1 / (1 + np.exp(-np.clip((shared.value[at] * x).sum() + shared.value[-1], -30, 30)))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["key", id_col, "score"])

    source = docs.select(row_key(text_col, id_col).alias("key"), F.col(id_col), F.col(text_col))
    scores = source.mapInArrow(run, f"key long, {id_col} {docs.schema[id_col].dataType.simpleString()}, score double")
    if posterior:
        table = spark.createDataFrame([(list(p), q) for p, q in posterior.items()], "votes array<tinyint>, weak_label double")
        by_key = labels.join(F.broadcast(table), "votes").select("key", F.array_join(F.transform("votes", lambda x: x.cast("string")), ",").alias("votes"), "weak_label").dropDuplicates(["key"])
    else:
        by_key = labels.select("key", F.lit("").alias("votes"), F.lit(0.5).alias("weak_label"))
    return scores.join(by_key, "key").select(id_col, "votes", "weak_label", "score", (F.col("score") >= GOOD).alias("good"))


def op2(spark, sf_dir: str) -> DataFrame:
    return classified(read(spark, sf_dir, "documents"))
