"""Personal data, quality, language model: against brute force, and on planted cases."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np

from tidemill.llm import lm, pii, quality, rules
from tidemill.llm.weak import Reliabilities

from .conftest import texts

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def naive_base(t):
    out = []
    for i, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(d) if k % 2 == 0 else (int(d) * 2 if int(d) < 5 else int(d) * 2 - 9) for k, d in enumerate(reversed(digits)))
            good = kind == "email" or kind == "card" and 12 <= len(digits) <= 19 and total % 10 == 0 or kind == "phone" and 9 <= len(digits) <= 15
            good = good or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
            if good:
                out.append((m.start(), i, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


ODD = [
    "a@b.c.d@e.f x@y a.b@@c.d %+@q-.-z @a.b a@b.", "1.2.3.4.5.6.7.8 01.002.255.256 999.1.1.1.1.1.1 1..2.3.4", "4111-1111-1111-1111 4111 1111 1111 1112 0000000000000 12 345678901234567890123 4111  1111", "+1+2 +1((((  +44 20 7946 0958 ext +1-2-3-4-5-6-7-8-9 ++123456789",
    "é@ü.de ana.é@x.yz 日本+81 3 1234 5678", "9" * 5000, "1." * 2000, "a@" * 2000, "+" * 3000 + "1 2", "." * 100 + "@a.b",
]


def test_base_spans():
    for t in [*ODD, *texts()]:
        assert [f"{k}:{s}:{e}" for s, e, k in pii.base_spans(t or "")] == naive_base(t)


def test_pii_query_and_mask(docs, empty):
    found = pii.pii_spans(docs).collect()
    text = collections.defaultdict(list)
    for r in docs.collect():
        text[r["doc_id"]].append(r["text"])
    assert len(found) == docs.count() and pii.pii_spans(empty).count() == 0
    for r in found:
        base = [f"{x['kind']}:{x['start']}:{x['end']}" for x in r["base"]]
        assert base in [naive_base(t) for t in text[r["doc_id"]]]
        assert set(base) <= {f"{x['kind']}:{x['start']}:{x['end']}" for x in r["spans"]}
    masked = pii.masked(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    row = next(r for r in masked.collect() if r["text"] and "<EMAIL>" in r["text"])
    assert "bob.x" not in row["text"] and "555-0953" not in row["text"] and row["n_chars"] == len(row["text"]) and "300.1.1.1" in row["text"]
    clean = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert clean[3] == texts()[3]


def test_long_candidates():
    for own, kind, length in (("a1B2" * 33, "secret", 1), ("0f" * 50_000, "secret", 1), ("12 34" * 6, "number", 0), ("7" * 100_000, "number", 0)):
        found = [(s, e, k, v[pii.LABELERS.index("length")]) for s, e, k, v, _ in pii.candidates(f"key: {own} end", [])]
        assert found == [(5, 5 + len(own), kind, length)]


def test_em_finds_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.4
    right = np.array([0.95, 0.9, 0.85, 0.55])
    votes = np.where(rng.random((5000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((5000, 4)) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = Reliabilities(patterns, counts)
    assert np.abs(model.accuracies() - right).max() < 0.05 and abs(model.prior - 0.4) < 0.05
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.93
    assert Reliabilities(np.zeros((0, 4)), np.zeros(0)).prior == 0.5


def naive_counts(t):
    w = [x for x in re.split(r"[ \t\n\x0b\x0c\r]+", t or "") if x]
    lines, seen, dup = (t or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^ \t\n\x0b\x0c\r]", x):
            dup += x in seen
            seen.add(x)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered)


def test_rule_counts(docs, empty):
    got = sorted(tuple(r[c] for c in rules.STAT_COLUMNS) for r in rules.statistics(docs).collect())
    assert got == sorted(naive_counts(r["text"]) for r in docs.collect())
    assert rules.verdicts(rules.statistics(empty)).count() == 0 and rules.keep_good(empty).columns == empty.columns


def test_rules_reject_outliers_and_keep_the_rest(spark):
    rng = np.random.default_rng(1)
    words = ["er", "onre", "thand", "ting", "ouer", "anti", "rethe"]
    line = lambda n: " ".join(rng.choice(words, n)) + " " + " ".join("".join(rng.choice(list("abcdefg"), rng.integers(2, 9))) for _ in range(n))
    data = [(i, line(int(rng.integers(60, 400))), "en", ["a", None][i % 2]) for i in range(300)]
    data += [(1000 + i, " ".join(x + "###" for x in line(100).split()), "en", "a") for i in range(6)]
    data += [(2000, "few words", "en", "a"), (2001, None, None, None), (2002, "same words here " * 40, "en", "a"), (3000, line(100), "xx", "tiny")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in rules.keep_good(df).collect()}
    assert kept == set(range(300)) | {3000}
    again = {r["doc_id"]: r["distance2"] for r in rules.verdicts(rules.statistics(df.repartition(7))).collect()}
    assert again == {r["doc_id"]: r["distance2"] for r in rules.verdicts(rules.statistics(df)).collect()}


def test_rare_languages_have_the_estimate_of_all(spark):
    """Texts of symbols in a language of forty documents go; plain ones there stay; repeats are counted by words."""
    rng = np.random.default_rng(4)
    line = lambda n: " ".join("".join(rng.choice(list("abcdefg"), rng.integers(2, 9))) for _ in range(n))
    data = [(i, line(int(rng.integers(60, 400))), "en", "a") for i in range(200)]
    data += [(1000 + i, line(100).replace(" ", " ### "), "rare", "a") for i in range(30)] + [(2000 + i, line(120), "rare", None) for i in range(10)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in rules.keep_good(df).collect()} == set(range(200)) | set(range(2000, 2010))
    few = df.where("doc_id >= 1000")  # fewer than an estimate needs: the base rule alone
    assert rules.keep_good(few).count() == 40


def test_many_spans_of_one_text():
    """Overlaps are looked up in order: many phone numbers in one text take seconds, and the spans are those of a plain test."""
    text = "call +1 (640) 555-0953 or id 4111111111111112 token=4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e, " * 3
    base = pii.base_spans(text)
    for s, e, _, votes, _ in pii.candidates(text, base):
        assert (votes[0] == 1) == any(a < e and s < b for a, b, _ in base)
    long, start = "+16405550953 " * 400_000, time.process_time()
    assert len(base := pii.base_spans(long)) == 400_000
    assert len(pii.candidates("+16405550953 " * 20_000, base[:20_000])) == 20_000 and time.process_time() - start < 30


def naive_mcd(x):
    """The estimates of one group, by the same steps in numpy."""
    n, best = len(x), None
    scale = lambda c: np.linalg.cholesky(c)
    floors = np.diag(np.array(rules.FLOORS) ** 2)
    q = np.percentile((x / 8).astype(np.int64), [25, 50, 75], axis=0)
    starts = [(x.mean(0) / 256, np.cov(x.T, bias=True) / 65536 * rules.CONSISTENCY + floors), (q[1] * 8 / 256, np.diag(((q[2] - q[0]) * 8 / 256 / 1.349) ** 2) + floors)]
    for _ in range(rules.STEPS):
        after = []
        for m, c in starts:
            y = np.linalg.solve(scale(c), (x / 256 - m).T)
            bins = np.floor(np.log(1 + (y**2).sum(0)) * 64).astype(int)
            k = next(b for b in np.sort(np.unique(bins)) if (bins <= b).sum() >= math.ceil(n * rules.SUPPORT))
            core = x[bins <= k]
            after.append((core.mean(0) / 256, np.cov(core.T, bias=True) / 65536 * rules.CONSISTENCY + floors))
        fell = max(np.linalg.slogdet(c)[1] - np.linalg.slogdet(d)[1] for (_, c), (_, d) in zip(starts, after))
        starts = after
        if fell <= rules.SETTLED:
            break
    for m, c in starts:
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0] - 1e-12:
            best = (det, m, c)
    return best


def naive_kept(rows):
    """Verdicts of all documents by the rules, with the estimates of naive_mcd()."""
    out, x, groups = [], {}, collections.defaultdict(list)
    for k, (_, text, lang, source) in enumerate(rows):
        n, chars, symbols, dup, again = naive_counts(text)
        if n:
            logs = (math.log(chars / n), math.log(1 + 100 * symbols / chars), math.log(1 + 1000 * dup / n), math.log(1 + 100 * again / n), math.log(n))
            x[k] = np.floor(256 * np.array(logs) + 0.5)
            for g in ((0, lang, source), (1, lang), (2,)):
                groups[g].append(k)
    estimate = {g: naive_mcd(np.array([x[k] for k in own]))[1:] for g, own in groups.items() if len(own) >= rules.MIN_ROWS}
    for k, (i, text, lang, source) in enumerate(rows):
        n, _, _, _, again = naive_counts(text)
        best = next((estimate[g] for g in ((0, lang, source), (1, lang), (2,)) if g in estimate), None)
        d2 = 0.0 if best is None or k not in x else float((np.linalg.solve(np.linalg.cholesky(best[1]), x[k] / 256 - best[0]) ** 2).sum())
        out.append((i, n >= 50 and 100 * again <= 50 * n and d2 <= rules.CUTOFF))
    return out


def naive_votes(text):
    """The labellers' votes, letter by letter."""
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", text)
    if not words:
        return [0] + [-1] * 7
    n, chars = len(words), sum(len(w.encode()) for w in words)
    letters = sum(len(c.encode()) for c in text if c.isascii() and c.isalpha() or ord(c) > 127)
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    lines = [x for x in text.split("\n") if re.search(r"[^ \t\x0b\x0c\r]", x)]
    again = 1 - len(set(lines)) / len(lines)
    ended = sum(re.sub(r"[ \t\x0b\x0c\r]+$", "", x)[-1] in ".!?\"'" for x in lines) / len(lines)
    stops = sum(w.encode() in quality.STOP_WORDS for w in low) / n
    share = lambda cs: sum(c in cs for c in text) / chars
    bounds = [(n >= 80, n < 40), (letters / chars > 0.93, letters / chars < 0.8), (share("#*$%&|<>{}[]=~^\\@_+!") < 0.02, share("#*$%&|<>{}[]=~^\\@_+!") > 0.08)]
    upper, mean, kinds = sum("A" <= c <= "Z" for c in text) / chars, chars / n, len(set(low)) / min(n, math.sqrt(1000 * n))
    bounds += [(upper < 0.1, upper > 0.4), (stops > 0.12, stops < 0.03), (3.5 < mean < 8, mean < 2.5 or mean > 12), (ended > 0.6 and again < 0.1, ended < 0.2 or again > 0.3), (kinds > 0.35, kinds < 0.15)]
    return [1 if good else 0 if bad else -1 for good, bad in bounds]


def naive_classifier(rows):
    """(id, (votes, weak label, score)) of all (id, text): expectation-maximisation document by document, and the scorer step by step."""
    votes = [naive_votes(t) for _, t in rows]
    q = [(sum(x == 1 for x in v) + 1) / (sum(x >= 0 for x in v) + 2) for v in votes]
    for _ in range(200):
        prior = min(0.95, max(0.05, (sum(q) + 1) / (len(q) + 2)))
        mass = [sum(1 - x for x in q), sum(q)]
        p = [[{x: (sum((w, 1 - w)[1 - label] for w, v in zip(q, votes) if v[j] == x) + 0.5) / (mass[label] + 1.5) for x in (-1, 0, 1)} for j in range(8)] for label in (0, 1)]
        new = []
        for v in votes:
            up = prior * math.prod(p[1][j][v[j]] for j in range(8))
            down = (1 - prior) * math.prod(p[0][j][v[j]] for j in range(8))
            new.append(up / (up + down))
        done, q = max(abs(a - b) for a, b in zip(new, q)) < 1e-9, new
        if done:
            break
    # Each distinct document is an example once; their order is the operator's.
    examples = {}
    for (i, t), target in zip(rows, q):
        examples.setdefault((i, t), (quality.features_of(t.encode()), target))
    order = naive_classifier.places
    train = [examples[key] for key in sorted(examples, key=lambda k: order[k])]
    w, g, rng = collections.defaultdict(float), collections.defaultdict(lambda: 1e-6), np.random.default_rng(0)
    for _ in range(8):
        perm = rng.permutation(len(train))
        for k in range(0, len(perm), 64):
            grad, part = collections.defaultdict(float), [train[i] for i in perm[k : k + 64]]
            for (at, x), target in part:
                miss = 1 / (1 + math.exp(-max(-30, min(30, sum(w[a] * np.float32(b) for a, b in zip(at, x)) + w["bias"])))) - target
                for a, b in zip(at, x):
                    grad[a] += miss * np.float32(b) / len(part)
                grad["bias"] += miss / len(part)
            for a, d in grad.items():
                if d:
                    d += 1e-5 * w[a]
                    g[a] += d * d
                    w[a] -= 0.3 * d / math.sqrt(g[a])
    score = lambda f: 1 / (1 + math.exp(-max(-30, min(30, sum(w[a] * b for a, b in zip(*f)) + w["bias"]))))
    return [(i, (",".join(map(str, v)), round(x, 6), round(score(quality.features_of(t.encode())), 5))) for (i, t), v, x in zip(rows, votes, q)]


def test_estimates(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((400, 5)) * [30, 80, 100, 90, 200] + [400, 300, 200, 500, 1500]).astype(int)
    x[:40] += np.array([0, 900, 0, 0, 0])
    df = spark.createDataFrame([("g", *map(int, r)) for r in x], "g string, " + ", ".join(f"x{i} long" for i in range(1, 6)))
    got, (det, m, c) = rules.estimates(df, ["g"]).first(), naive_mcd(x)
    assert abs(got["log_det"] - det) < 1e-6 and max(abs(got[f"m{i + 1}"] - m[i]) for i in range(5)) < 1e-6
    assert max(abs(got[f"c{i + 1}{j + 1}"] - c[i][j]) for i in range(5) for j in range(i + 1)) < 1e-6


def test_quality_classifier(spark, docs, empty):
    out = quality.classified(docs)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").isEmpty() and quality.classified(empty).count() == 0
    rng = np.random.default_rng(4)
    good = [" ".join(f"{w} the of and" for w in ("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60))) + "." for _ in range(150)]
    bad = [" ".join("".join(rng.choice(list("XYZ#$%"), 4)) for _ in range(60)) for _ in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    r = {x["doc_id"]: x["good"] for x in quality.classified(df).collect()}
    assert all(r[i] for i in range(150)) and not any(r[i] for i in range(150, 200))


def test_votes_read_whole_texts():
    stop, variety = quality.LABELLERS.index("stop_words"), quality.LABELLERS.index("variety")
    for k in (2, 4, 10):  # a period that a stride would meet
        text = " ".join((["the"] + ["word"] * 19) * 1000 * k)
        assert quality.votes_of(text.encode())[stop] == -1  # a share of 0.05
        shifted = " ".join((["word"] + ["the"] + ["word"] * 18) * 1000 * k)
        assert quality.votes_of(shifted.encode()) == quality.votes_of(text.encode())
    spam = " ".join(f"w{i % 400}" for i in range(100_000)).encode()
    rich = " ".join(f"w{i % 9000}" for i in range(100_000)).encode()
    assert quality.votes_of(spam)[variety] == 0 and quality.votes_of(rich)[variety] == 1
    assert quality.votes_of(b" ".join(b"w%d" % (i % 400) for i in range(1000)))[variety] == 1


def test_repeated_rows_are_one_of_the_sample(spark, monkeypatch):
    data = [(i, " ".join(f"w{i}x{j} the" for j in range(50))) for i in range(30)]
    seen, fit = [], quality.logistic
    monkeypatch.setattr(quality, "logistic", lambda rows, *rest: (seen.append(len(rows)), fit(rows, *rest))[1])
    monkeypatch.setattr(quality, "TRAIN_DOCS", 20)
    counts = [quality.classified(spark.createDataFrame(data * k, "doc_id long, text string")).count() for k in (1, 9)]
    assert seen == [20, 20] and counts == [30, 270]


def test_lm_base_and_normalisation(docs, empty):
    got = lm.scores(docs).collect()
    all_ = [(r["doc_id"], (r["text"] or "")) for r in docs.collect()]
    tokens = lambda t: [*t.encode().lower().split(), b""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(x for i, t in all_ if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tokens(t)), sum(x in c for x in tokens(t)), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t in all_)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got) and lm.scores(empty).count() == 0
    t = lm.LogBilinear(np.full(lm.CLASSES, 1 / lm.CLASSES)).table()
    assert np.abs((10.0**t).sum(axis=1) - 1).max() < 1e-3


def test_lm_beyond_the_dictionary(docs, monkeypatch):
    whole = {(r["doc_id"], r["n_tokens"]): (r["n_known"], round(r["base_score"], 6)) for r in lm.scores(docs).collect()}
    monkeypatch.setattr(lm, "DICTIONARY", 20)
    assert {(r["doc_id"], r["n_tokens"]): (r["n_known"], round(r["base_score"], 6)) for r in lm.scores(docs).collect()} == whole


def test_lm_beats_counts(spark):
    rng = np.random.default_rng(5)
    chains = [["the", "cat", "sat", "on", "a", "mat"], ["der", "hund", "lief", "in", "den", "wald"]]
    data = [(i, " ".join(rng.choice(chains[i % 2], 1)[0] if rng.random() < 0.1 else chains[i % 2][k % 6] for k in range(120))) for i in range(300)]
    out = lm.scores(spark.createDataFrame(data, "doc_id long, text string")).where("held_out").groupBy().sum("base_score", "score").first()
    assert out[1] > out[0] * 0.8  # both are negative


def test_word_weights_sum_to_the_totals():
    rng = np.random.default_rng(6)
    own, tokens = [b"", b"the"] + [b"\x00 %d" % i for i in range(2, lm.OWN)], [b"w%d" % i for i in range(300)]
    n = np.sort(rng.integers(1, 90, 300))[::-1]
    cls = np.array([lm.class_of(t) for t in tokens])
    class_n, class_v = np.bincount(cls, weights=n, minlength=lm.CLASSES), np.bincount(cls, minlength=lm.CLASSES).astype(float)
    d = lm.Dictionary([*tokens[:200], b"the"], [*n[:200].tolist(), 9], class_n, class_v, own)  # a hundred tokens have no embedding
    x, w = rng.standard_normal((lm.CLASSES, 5)), rng.standard_normal((200, 5))
    weights = (n[:, None] + 1) * np.exp(np.concatenate([w, np.zeros((100, 5))]) @ x.T)
    want = np.stack([weights[cls == k].sum(axis=0) + 1 for k in range(lm.CLASSES)])
    assert np.allclose(lm.class_totals(d, w, x), want)
    assert d.encode(b"w1 the w250")[5].tolist() == [1, lm.NO_WORD, lm.NO_WORD, lm.NO_WORD]


def test_word_embeddings_find_the_ratio():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.standard_normal((lm.CLASSES, lm.WIDTH)), np.ones((lm.CLASSES, 1))], axis=1)
    w = rng.standard_normal((20, lm.WIDTH + 1)) / 6
    ratio, noise = np.exp(w @ x.T), rng.uniform(500, 5000, (20, lm.CLASSES))
    found = lm.word_embeddings(ratio * noise / lm.NOISE, noise, x)
    assert np.abs(found - w).max() < 0.05
    assert np.abs(lm.word_embeddings(np.zeros((1, lm.CLASSES)), np.zeros((1, lm.CLASSES)), x)).max() == 0
    hot = np.zeros((1, lm.CLASSES))
    hot[0, 3] = 1e9  # far from its noise, and finite
    assert np.isfinite(lm.word_embeddings(hot, noise[:1], x)).all()


def test_lm_learns_words_within_classes(spark):
    rng = np.random.default_rng(8)
    own = [f"f{i}" for i in range(lm.OWN + 20)]  # frequent words, each before one half of the others
    data = []
    for i in range(200):
        words = []
        for _ in range(150):
            k = int(rng.integers(len(own)))
            words += [own[k], f"{'ab'[k % 2]}{rng.integers(200)}ends"]
        data.append((i, " ".join(words)))
    out = lm.scores(spark.createDataFrame(data, "doc_id long, text string")).where("held_out").groupBy().sum("base_score", "score", "n_tokens").first()
    assert (out[1] - out[0]) / out[2] > 0.1  # half of all tokens gain up to log10(2)


def test_long_tokens_stay_out_of_the_dictionary(spark):
    long = "y" * 5000
    df = spark.createDataFrame([(i, f"{long} a {long}") for i in range(20)], "doc_id long, text string")
    r = lm.scores(df).where("not held_out").first()
    n = r["train_tokens"]
    want = (2 * math.log10(n / 2 + 1) + 2 * math.log10(n / 4 + 1)) - 4 * math.log10(n + 3 + 1)
    assert r["n_known"] == 4 and abs(r["base_score"] - want) < 1e-9


def test_sha_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
