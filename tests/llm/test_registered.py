"""The registered queries themselves, over small tables, against brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemill.llm.common import row_key

from .test_matching import naive_contamination, naive_fingerprint, naive_repeats, naive_runs
from .test_scoring import naive_base, naive_classifier, naive_counts, naive_kept

ITEMS = [("i1", "One, TWO"), ("i2", None), ("", "spam ham spam ham spam ham spam ham spam ham spam"), (None, "two one"), ("ü", "ünï çödé àÉ")]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def same(spark, folder, name, columns, want):
    got = [tuple(r[c] for c in columns) for r in __spark_entry__.queries()[name](spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_op1(spark, folder, rows):
    def one(i, text):
        base = naive_base(text)
        return (i, *(sum(x.startswith(f"{k}:") for x in base) for k in ("email", "ip", "card", "phone")), sha(base))

    same(spark, folder, "op1_pii", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"], [one(*r) for r in rows])


def test_op2(spark, folder, rows):
    # Only the order of the examples is the operator's own: by a hash of id and text.
    keyed = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.xxhash64(F.lit(11), row_key()).alias("place"))
    naive_classifier.places = {(r["doc_id"], r["text"] or ""): r["place"] for r in keyed.collect()}
    want = naive_classifier(rows)
    got = __spark_entry__.queries()["op2_quality_classifier"](spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["votes"], round(r["weak_label"], 6), round(r["score"], 5)) for r in got) == sorted((str(i), *x) for i, x in want)


def test_op5_verdicts(spark, folder, docs):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    same(spark, folder, "op5_quality_rules", ["doc_id", "kept"], naive_kept(rows))


def test_op3(spark, folder, rows):
    def one(i, text):
        n, hit, items = naive_contamination(text, ITEMS)
        return (i, n, hit, len(items), sha(items), hit > 0)

    same(spark, folder, "op3_decontamination", ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], [one(*r) for r in rows])


def test_op5(spark, folder, rows):
    def one(i, text):
        n, *more, again = naive_counts(text)
        return (i, n, *more, again, n < 50 or 100 * again > 50 * n)

    same(spark, folder, "op5_quality_rules", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], [one(*r) for r in rows])


def test_op7(spark, folder, rows):
    want, runs = naive_repeats([(i, t.encode()) for i, t in rows]), naive_runs([(i, t.encode()) for i, t in rows])
    same(spark, folder, "op7_substrings", ["doc_id", "n_spans"], runs)
    same(spark, folder, "op7_substrings", ["doc_id", "n_bytes", "n_removed", "kept_sha256"], want)


def test_op10(spark, folder, rows):
    prints = {}
    for i, t in rows:
        prints.setdefault(naive_fingerprint(t), []).append(i)
    group = {f: f for f in prints}
    for f in prints:
        for g in prints:
            if (f ^ g).bit_count() <= 2 and group[f] != group[g]:
                a, b = group[f], group[g]
                group = {x: b if y == a else y for x, y in group.items()}
    least = {g: min((i for f, ids in prints.items() if group[f] == g for i in ids if i is not None), default=None) for g in group.values()}
    same(spark, folder, "op10_simhash", ["doc_id", "fingerprint", "component_id"], [(i, f"{f:016x}", least[group[f]]) for f, ids in prints.items() for i in ids])
