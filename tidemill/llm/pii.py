"""Personal data by weak supervision.

Base spans follow fixed rules.  Beside them, loose candidates (anything like an address, a
number or a secret) get votes: regex labelers look at the form, gazetteer labelers at words of
the trade nearby, context labelers at the characters around.  Expectation-maximisation over the
counts of vote patterns estimates how far each labeler can be relied on; the posteriors of a
bounded sample of candidates train a final classifier over hashed features, which decides on
every candidate.  Accepted candidates that touch no base span are added as spans of the kinds
`address`, `number` and `secret`; base spans always stay.

Only the texts' own scan runs over the documents; estimation and decision work on the staged
candidates.  A null or empty text has no spans.  Repeated rows get equal spans.  Of equal kinds of
evidence ties go to the candidate that starts first.  Candidates have no longest length, and long
texts are read whole.  An empty table gives an empty result.  Further columns pass through masked(),
whatever their names.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import fresh, read, row_key, stage
from .weak import Reliabilities, logistic

KINDS = ("email", "ip", "card", "phone", "address", "number", "secret")
#: Candidates that the classifier is fitted on at most.
TRAIN_SPANS = 20_000
BUCKETS = 1 << 12
#: Bytes of spans that are broadcast at most.
SPAN_BYTES = 16_000_000
#: Probability from which a candidate counts.
ACCEPT = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A part that starts within a run of digits fails where the whole run has failed.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_NUMBER = re.compile(r"(?<![\w])\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}(?!\w)")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}(?![A-Za-z0-9_-])")
_ADDRESS = re.compile(r"(?<![^\s@<>\"'])[^\s@<>\"']+@[^\s@<>\"']{3,}")
_NEAR_WORDS = {
    "number": re.compile(r"\b(phone|tel|telephone|mobile|cell|call|fax|whatsapp|card|visa|mastercard|amex|ssn|account|iban|passport|id|telefon|handy|konto|karte|téléphone|carte|compte|teléfono|tarjeta|cuenta)\b", re.I),
    "secret": re.compile(r"\b(token|secret|password|passwd|pwd|key|apikey|api_key|auth|bearer|credential)\b", re.I),
    "address": re.compile(r"\b(mail|email|e-mail|contact|write|correo|courriel|contacto|kontakt)\b", re.I),
}
_OTHER_WORDS = re.compile(r"\b(isbn|issn|doi|page|pages|version|commit|sha|md5|checksum|figure|table|vol|year|price|total|usd|eur)\b", re.I)
LABELERS = ("base_rule", "form", "length", "gazetteer", "other_trade", "before", "after")


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the check of card numbers."""
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base spans (start, end, kind) by start, then kind as listed."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, done := m.end(), "email"))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, list[int], list[int]]]:
    """Loose candidates (start, end, kind, votes, features)."""
    found = [(*m.span(), "number") for m in _NUMBER.finditer(text)]
    found += [(*m.span(), "secret") for m in _SECRET.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    if "@" in text:
        found += [(*m.span(), "address") for m in _ADDRESS.finditer(text)]
    out = []
    starts, reach = [a for a, _, _ in base], list(itertools.accumulate((b for _, b, _ in base), max))
    for s, e, kind in sorted(found):
        before_end = bisect.bisect_left(starts, e)  # base spans that start before the candidate ends
        own, before, after = text[s:e], text[max(0, s - 40) : s], text[e : e + 20]
        digits = sum(c.isdigit() for c in own)
        hexes = kind == "secret" and re.fullmatch(r"[0-9a-fA-F]+", own) is not None
        form = {
            "number": 1 if re.fullmatch(r"\+?[0-9]{1,3}[ .-]\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|(?:[0-9]{4}[ -]?){3}[0-9]{4}", own) else 0 if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}.*|0+[0-9]?", own) else -1,
            "secret": 1 if hexes or (digits >= 4 and re.search("[a-z]", own) and re.search("[A-Z]", own)) else 0 if own.count("-") + own.count("_") >= 3 else -1,
            "address": 1 if re.search(r"@[\w-]+\.[A-Za-z]{2,}", own) else 0,
        }[kind]
        length = {"number": 1 if 9 <= digits <= 16 else 0, "secret": 1 if len(own) in (32, 40, 48, 56, 64) or len(own) >= 128 else -1, "address": 1 if len(own) >= 6 else 0}[kind]
        votes = [
            1 if before_end and reach[before_end - 1] > s else -1,
            form,
            length,
            1 if _NEAR_WORDS[kind].search(before) else -1,
            0 if _OTHER_WORDS.search(before[-20:]) else -1,
            1 if re.search(r"[:=]\s*[\"']?$", before) else 0 if before[-1:] in tuple("#$€£/") else -1,
            0 if after[:1] in tuple("%€$/") else 1 if after[:1] in tuple("\"'") else -1,
        ]
        shape = re.sub("0+", "0", re.sub("[0-9]", "0", re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", own))))[:24]
        words = re.findall(r"\w+", before)[-2:] + ["|"] + re.findall(r"\w+", after)[:1]
        names = [f"k={kind}", f"s={kind}{shape}", f"n={kind}{len(own)}", f"d={kind}{digits}", *(f"w={w.lower()}" for w in words), *(f"v{i}={kind}{x}" for i, x in enumerate(votes))]
        out.append((s, e, kind, votes, sorted({zlib.crc32(n.encode()) % BUCKETS for n in names})))
    return out


_SPAN = "start: int, end: int, kind: string"
_CANDIDATE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("votes", pa.list_(pa.int8())), ("features", pa.list_(pa.int32()))])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc id, base spans, candidates) for each row of docs."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])

    def run(batches):
        for b in batches:
            base, cands = [], []
            for t in b.column(2).to_pylist():
                spans = base_spans(t or "")
                base.append([dict(zip(("start", "end", "kind"), x)) for x in spans])
                cands.append([dict(zip(("start", "end", "kind", "votes", "features"), x)) for x in candidates(t or "", spans)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, pa.list_(span)), pa.array(cands, pa.list_(_CANDIDATE))], ["key", id_col, "base", "cands"])

    source = docs.select(row_key(text_col, id_col).alias("key"), F.col(id_col), F.col(text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"key long, {id_col} {kind}, base array<struct<{_SPAN}>>, cands array<struct<{_SPAN}, votes: array<tinyint>, features: array<int>>>")


def fitted(scanned: DataFrame) -> np.ndarray:
    """The final classifier's weights: votes -> reliabilities -> posteriors -> logistic scorer."""
    each = scanned.select("key", F.explode("cands").alias("c")).select("key", "c.*")
    patterns = each.groupBy("votes").count().collect()  # at most 3 ** 7
    if not patterns:
        return np.zeros(BUCKETS + 1)
    model = Reliabilities(np.array([r["votes"] for r in patterns]), np.array([r["count"] for r in patterns]))
    sample = each.orderBy(F.xxhash64("key", "start", "kind"), "key", "start", "kind").limit(TRAIN_SPANS).select("votes", "features").collect()
    targets = model.posterior(np.array([r["votes"] for r in sample]))
    return logistic([np.array(r["features"]) for r in sample], targets, BUCKETS)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc id, base, spans) for each row of docs; spans holds base and added spans in order."""
    scanned = stage(scan(docs, id_col, text_col), "candidates")
    weights = docs.sparkSession.sparkContext.broadcast(fitted(scanned))  # of fixed size

    def run(batches):
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
        for b in batches:
            out = []
            for base, cands in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                # Both lists are in order: of what starts before a candidate's end, the furthest end tells.
                spans, starts, reach, taken = list(base), [x["start"] for x in base], list(itertools.accumulate((x["end"] for x in base), max)), -1
                for c in cands:
                    k = bisect.bisect_left(starts, c["end"])
                    z = weights.value[c["features"]].sum() + weights.value[-1]
                    if 1 / (1 + np.exp(-z)) >= ACCEPT and max(taken, reach[k - 1] if k else -1) <= c["start"]:
                        spans.append({k: c[k] for k in ("start", "end", "kind")})
                        taken = max(taken, c["end"])
                out.append(sorted(spans, key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(span))], ["key", id_col, "base", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return scanned.mapInArrow(run, f"key long, {id_col} {kind}, base array<struct<{_SPAN}>>, spans array<struct<{_SPAN}>>")


def masked_text(text: str, spans: list[dict]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first counts."""
    out, at = [], 0
    for x in spans:
        if x["start"] >= at:
            out += (text[at : x["start"]], f"<{x['kind'].upper()}>")
        at = max(at, x["end"])
    return "".join(out) + text[at:]


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with each span of personal data replaced by its kind, as <EMAIL>; overlapping spans by the first's.

    Nulls stay null.  Spans join by key and id; where few rows have any, their list is broadcast by its counted bytes.
    """
    key, spans, span_key, span_id = fresh(docs, "key", "spans", "span_key", "span_id")
    found = pii_spans(docs, id_col, text_col).where("size(spans) > 0").select(F.col("key").alias(span_key), F.col(id_col).alias(span_id), F.col("spans").alias(spans)).dropDuplicates([span_key])
    found = stage(found, "spans")
    total = found.agg(F.coalesce(F.sum(F.size(spans) * 24 + 40), F.lit(0))).first()[0]
    keyed = docs.withColumn(key, row_key(text_col, id_col))
    out = keyed.join(F.broadcast(found) if total <= SPAN_BYTES else found, (F.col(key) == F.col(span_key)) & F.col(id_col).eqNullSafe(F.col(span_id)), "left").select(*docs.columns, spans)

    def run(batches):
        at = docs_columns.index(text_col)
        for b in batches:
            texts = [t if s is None or t is None else masked_text(t, s) for t, s in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, b.schema.field(at).type)
            columns.append(b.column(b.num_columns - 1).is_valid())
            yield pa.RecordBatch.from_arrays(columns, [*docs_columns, changed])

    docs_columns, changed = list(docs.columns), fresh(docs, "changed")[0]
    schema = StructType([*docs.schema.fields, StructField(changed, BooleanType())])
    out = out.mapInArrow(run, schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(changed), F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    found = pii_spans(read(spark, sf_dir, "documents"))
    joined = lambda c: F.expr(f"array_join(transform({c}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.expr("cast(size(spans) - size(base) as bigint)").alias("n_added"))
