"""Mixing, WARC audit, page text and the pipeline."""

import collections
import gzip

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import html, mixing, warc
from tidemill.llm.common import stage

from .conftest import collected


def naive_targets(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        over = [s for s in names if s not in capped and left * weight[s] / w > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in capped else left * weight[s] / w for s in names}
        capped |= set(over)


def test_targets_and_takes(spark):
    rng = np.random.default_rng(0)
    source = rng.choice(["a", "b", "c", "d", "é", ""], 3000, p=[0.7, 0.1, 0.1, 0.05, 0.03, 0.02])
    data = [(i, " ".join(["w"] * int(rng.integers(0, 60))), s or None) for i, s in enumerate(source)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    each, copies = mixing.mix(df, shards=16)
    rows = each.collect()
    sizes = collections.Counter()
    for _, t, s in data:
        sizes[s] += len(t.split())
    want = naive_targets(sizes)
    by = {i: s for i, _, s in data}
    taken = collections.Counter()
    for r in rows:
        assert abs(r["target"] - want[by[r["doc_id"]]]) < 1e-6 * max(1, want[by[r["doc_id"]]]) and r["source_size"] == sizes[by[r["doc_id"]]] and 0 <= r["times"] <= 3
        taken[by[r["doc_id"]]] += r["size"] * r["times"]
    assert len(rows) == 3000 and all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    again, _ = mixing.mix(df.repartition(5), shards=16)
    assert collected(again, "doc_id", "times") == collected(each, "doc_id", "times")
    shard = collections.Counter(r["shard"] for r in copies.collect())
    assert copies.count() == sum(r["times"] for r in rows) and len(shard) == 16 and max(shard.values()) < 2 * min(shard.values())


def test_split_is_exact():
    rng = np.random.default_rng(1)
    q = np.array([1000, 3, 0, 517])
    parts = mixing.split_quotas(q, 13, rng)
    assert (parts.sum(axis=0) == q).all() and parts.sum(axis=1).max() - parts.sum(axis=1).min() <= 2


def test_op6_draws_the_copies(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "a", "a", "b", None][i % 5]) for i in range(1500)]
    docs = spark.createDataFrame([*data, data[0], data[0]], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out, (each, _) = mixing.op6(spark, str(tmp_path)), mixing.mix(docs)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken", "times", "copies"]
    want = each.withColumn("taken", F.col("size") * F.col("times"))
    rows = out.collect()
    assert collected(out, "doc_id", "size", "taken", "times") == collected(want, "doc_id", "size", "taken", "times")
    assert all([c["copy"] for c in r["copies"]] == list(range(1, r["times"] + 1)) and r["taken"] == r["size"] * len(r["copies"]) for r in rows)
    drawn = {(r["doc_id"], c["copy"], c["shard"], c["order"]) for r in rows for c in r["copies"] if r["doc_id"]}
    mixed = mixing.mixed_documents(docs).where("doc_id <> 0").distinct().collect()
    assert drawn == {(r["doc_id"], r["mix_copy"], r["mix_shard"], r["mix_order"]) for r in mixed} and {s for _, _, s, _ in drawn} == set(range(mixing.SHARDS))


def test_repeated_rows_meet_their_target(spark):
    data = [(1, "a b c d e f g h i j", "a", 0)] * 500 + [(2, "one two three four five six seven eight nine ten", "b", k) for k in range(500)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, mix_shard int").repartition(6)
    rows = mixing.taken_documents(docs).collect()
    taken = collections.Counter()
    for r in rows:
        taken[r["doc_id"]] += r["taken"]
        assert r["taken"] <= 30 and abs(r["target"] - 10_000 * r["doc_id"] / 3) < 1e-6
    assert len(rows) == 1000 and abs(taken[1] - 10_000 / 3) <= 10 and abs(taken[2] - 20_000 / 3) <= 10
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [*docs.columns, "_mix_shard", "mix_copy", "mix_order"]
    assert mixed.groupBy("doc_id").count().collect() and {r["doc_id"]: r["count"] * 10 for r in mixed.groupBy("doc_id").count().collect()} == dict(taken)
    assert mixed.where("doc_id = 2").groupBy("mix_shard").count().agg({"count": "max"}).first()[0] <= 3


def test_shards_in_files_by_order(spark, tmp_path):
    """A shard beyond a file is cut by its order; files by name, rows as they lie, give the shuffled shard."""
    mixed = spark.range(900).select("id", (F.col("id") % 3).cast("int").alias("mix_shard"), F.xxhash64("id").alias("mix_order"))
    mixing.write_shards(mixed, str(tmp_path / "out"), rows=100)
    for k in range(3):
        files = sorted(str(p) for p in (tmp_path / "out" / f"mix_shard={k}").glob("*.parquet"))
        got = [r for f in files for r in pq.read_table(f, partitioning=None)["mix_order"].to_pylist()]
        assert got == sorted(got) and len(got) == 300 and len(files) >= 3
    mixing.write_shards(mixed.where("false"), str(tmp_path / "none"))


def test_mixing_edges(docs, empty):
    each, _ = mixing.mix(docs)
    assert each.count() == docs.count() and mixing.mixed_documents(empty).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == [*docs.columns, "mix_shard", "mix_copy", "mix_order"] and out.count() == each.agg(F.sum("times")).first()[0]


def audited(a, b):
    return warc.audit(stage(warc.fixity(a), "archive"), stage(warc.fixity(b), "replica"))


def test_audit(spark):
    data = [(i, None if i == 7 else f"payload {i}" * (i % 5)) for i in range(700)]
    a = spark.createDataFrame(data, "record_id long, payload string")
    b = a.where("record_id <> 333").withColumn("payload", F.when(F.col("record_id").isin(10, 699), "damaged").otherwise(F.col("payload")))
    assert collected(audited(a, b), "record_id", "status") == [(10, "corrupt"), (333, "missing"), (699, "corrupt")]
    assert collected(audited(b, a).where("status = 'extra'"), "record_id") == [(333,)]
    assert audited(a, a).isEmpty() and audited(a.where("false"), a.where("false")).isEmpty()
    one = a.where("record_id = 1")
    assert collected(audited(one, one.where("false")), "status") == [("missing",)]


def test_audit_of_repeated_ids(spark, monkeypatch):
    data = [(None if i % 3 else 5, f"page {i % 40}" + "x" * (20_000 if i == 7 else 0)) for i in range(400)] + [(6, "same")] * 300 + [(9, None), (9, None), (9, "null")]
    a = spark.createDataFrame(data, "record_id long, payload string")
    kept = [d for i, d in enumerate(data) if i not in (3, 400, 401, 700)] + [(5, "other"), (6, "new")]
    b = spark.createDataFrame(kept, "record_id long, payload string")
    want = [(5, "corrupt", len("page 3")), (6, "corrupt", 4), (6, "missing", 4), (9, "missing", 0)]
    for hot in (64, 1):
        monkeypatch.setattr(warc, "HOT", hot)
        for x in (b, b.repartition(5)):
            assert collected(audited(a, x), "record_id", "status", "length") == want


def test_only_damaged_ranges_are_reached(spark):
    a = spark.range(5000).selectExpr("id as record_id", "concat('payload ', id) as payload")
    b = a.where("record_id % 389 <> 5").withColumn("payload", F.when(F.col("record_id") % 97 == 0, "damaged").otherwise(F.col("payload")))
    ours, theirs, depth = warc.ranged(warc.fixity(a), warc.fixity(b))
    one, two = warc.tree(ours, depth), warc.tree(theirs, depth)
    sizes = [x.count() for x in one]
    assert depth == 3 and sizes[-1] == 1 and sizes[1] == 256 and sizes[0] > 2000
    damaged = {x for x in range(5000) if x % 389 == 5 or x % 97 == 0}
    reached = {r["node"] for r in warc.differing(one, two).collect()}
    assert reached == {r["leaf"] for r in ours.where(F.col("record_id").isin(*damaged)).collect()} and len(reached) <= len(damaged)


def test_read_warc(spark, tmp_path):
    records = [(1, "http://a/1", "<html>x</html>"), (2, None, "é")]
    pages = spark.createDataFrame(records, "page_id long, url string, html string")
    payloads = [r["payload"].encode() for r in warc.page_records(pages).orderBy("record_id").collect()]
    (tmp_path / "x.warc").write_bytes(b"".join(payloads))
    got = warc.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert [bytes(r["payload"]) for r in got] == payloads and [r["offset"] for r in got] == [0, len(payloads[0])] and got[0]["record_id"] == "<urn:page:1>"
    broken = payloads[1].replace(b"Content-Length: 2", b"Content-Length: many")
    found = warc.records_of(b"noise" + payloads[0] + b"\x00\x01" + broken + payloads[0] + payloads[0][:-9])
    assert [x[1] for x in found] == [None, "<urn:page:1>", None, "<urn:page:2>", "<urn:page:1>", "<urn:page:1>"]
    assert found[0] == (0, None, b"noise") and found[3][2] == broken and b"".join(x[2] for x in found) == b"noise" + payloads[0] + b"\x00\x01" + broken + payloads[0] + payloads[0][:-9]
    assert warc.records_of(b"") == [] and warc.records_of(b"plain") == [(0, None, b"plain")]
    # A length that is too large or too small swallows no record behind it.
    for size in (b"900", b"1", b"9" * 30):
        wrong = payloads[1].replace(b"Content-Length: 2", b"Content-Length: " + size)
        assert [x[1:] for x in warc.records_of(wrong + payloads[0])] == [("<urn:page:2>", wrong), ("<urn:page:1>", payloads[0])], size


def test_damaged_gzip(spark, tmp_path):
    """Members are unpacked one by one: what is cut off, damaged or added is a gap, and all else is read."""
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<html>{'text of a page ' * 40}{i}</html>") for i in range(5)], "page_id long, url string, html string")
    payloads = [r["payload"].encode() for r in warc.page_records(pages).orderBy("record_id").collect()]
    packed = [gzip.compress(p) for p in payloads]
    bad = bytearray(packed[1])
    bad[len(bad) // 2] ^= 0xFF
    files = {
        "whole": (b"".join(packed), [0, 1, 2, 3, 4], 0), "one": (gzip.compress(b"".join(payloads)), [0, 1, 2, 3, 4], 0), "cut": (b"".join(packed)[:-25], [0, 1, 2, 3], 1),
        "trailing": (b"".join(packed) + b"trailing bytes", [0, 1, 2, 3, 4], 1), "damaged": (packed[0] + bytes(bad) + b"".join(packed[2:]), [0, 2, 3, 4], 1), "noise": (packed[0] + b"\x1f\x8b\x08noise" + packed[1], [0, 1], 1), "none": (b"\x1f\x8b", [], 1),
    }
    for name, (data, _, _) in files.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    got = collections.defaultdict(list)
    for r in warc.read_warc(spark, str(tmp_path)).orderBy("path", "offset").collect():
        got[r["path"].rpartition("/")[2].split(".")[0]].append((r["record_id"], bytes(r["payload"])))
    for name, (_, ids, gaps) in files.items():
        assert [p for _, p in got[name] if p in payloads] == [payloads[i] for i in ids], name
        assert sum(i is None for i, _ in got[name]) >= gaps, name


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="nav">
<nav><ul><li><a href="/x">Home page of the host</a></li></ul></nav><!-- <article>no</article> --><div class="ad">Buy these very good things now</div>
<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>
 text &lt;tag&gt; &#233;<br>next<p>Second<div class="comments"><p>Reader says</p></div><form><p>Name</p></form><aside>Side</aside><p>Last %d</p></article>
<footer>&copy; host and all others here</footer></body></html>"""


def test_blocks():
    got = html.blocks_of(PAGE % 1)
    assert [t for t, s in got if s == html.MAIN] == ["Title & more", "First bold text <tag> é next", "Second", "Last 1"]
    assert html.blocks_of("<p>a < b <artic") == [("a < b", html.OTHER)] and html.blocks_of("") == [] and html.blocks_of("<script>x") == []
    assert html.blocks_of("plain &am") == [("plain &am", html.OTHER)]
    assert html.blocks_of("<div hidden>x</div><div data-x='hidden'>y</div>") == [("x", html.CHROME), ("y", html.OTHER)]


def test_deep_and_implied_ends():
    read = lambda x: [t for t, s in html.blocks_of(x) if s in (html.MAIN, html.OTHER)]
    rows = "".join(f"<tr><td>menu {i}<td>more" for i in range(300))
    for menu in (f"<table>{rows}</table>", rows, "<dl>" + "<dt>a<dd><b>b" * 300 + "</dl>", "<ul>" + "<li><i>a" * 300 + "</ul>", "<b>" * 900 + "x", "<div>" * 900 + "x"):
        assert read(f"<aside>{menu}</aside><article><p>Story</article><div>rest</div>") == ["Story", "rest"], menu[:20]
        assert html.blocks_of(f"<article>Story{menu}</article>rest")[-1] == ("rest", html.OTHER)
    assert read("<ul><li class=ad>x<ul><li>y</ul>z<li>a</ul><table><tr><td class=ad>x<table><tr><td>y</table>z<td>b<tr class=ad><th>q<tr><th>c</table>") == ["a", "b", "c"]
    assert read("<p class=ad><b>x<p>a<p class=ad>y<div>b</div><dl><dt class=ad>x<dd>c<dd class=ad><div>y</div><dt>d</dl>") == ["a", "b", "c", "d"]
    assert read("<li class=ad>x<section><li>y</section>z</li>a<select><option>n</select>") == ["a"]


def naive_starts(streams, pages, n):
    where = collections.defaultdict(set)
    for t, p in zip(streams, pages):
        for i in range(len(t) - n + 1):
            where[tuple(t[i : i + n])].add(p)
    return [[i for i in range(len(t) - n + 1) if len(where[tuple(t[i : i + n])]) > 1] for t in streams]


def test_suffix_array():
    rng = np.random.default_rng(6)
    streams = [list(rng.choice(["a", "b", "c"], rng.integers(0, 40))) for _ in range(30)]
    pages = np.repeat(np.arange(15), 2)
    for n in (1, 2, 5, 6):
        assert [list(x) for x in html.repeated_starts(streams, pages, n)] == naive_starts(streams, pages, n)


def test_main_text(spark):
    bare = "<body><div>Welcome to our very nice site</div><div>%s</div><div>All rights reserved by us, 2024</div></body>"
    data = [(1, "http://h.example/1", PAGE % 1), (2, "http://h.example/2", PAGE % 2), (3, "http://h.example/3", bare % "Unique story one"), (4, "https://h.example:80/4", bare % "Another story two"), (5, None, None), (6, "x", ""), (3, "http://h.example/3", bare % "Unique story one")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.main_text(pages).collect()}
    assert got[3]["text"] == "Unique story one" and got[4]["text"] == "Another story two" and got[5]["text"] == got[6]["text"] == ""
    assert got[1]["text"].endswith("\n\nLast 1") and html.main_text(pages).count() == 7
    large = {r["page_id"]: r["text"] for r in html.main_text(pages, host_bytes=0).collect()}
    assert large == {i: r["text"] for i, r in got.items()}


def test_names_never_empty_a_page():
    story = "<p>The story of the day</p>"
    for page in (
        f'<div class="site no-sidebar"><article>{story}</article></div>', f'<div class="content-with-sidebar"><article>{story}</article></div>', f'<article class="post comments-open">{story}</article>',
        f'<div class="has-header"><main>{story}</main></div>', f'<article class="post category-social">{story}</article>', f'<article><section class="header">{story}</section></article>',
        f'<div class="sidebar"><article>{story}</article></div>', f'<div class="header">{story}</div>', f'<div class="ad">{story}</div>',
    ):
        assert html.text_of(html.blocks_of(page), None, None) == "The story of the day", page
    for extra in ('<div class="comments-area"><article class="comment">I like it</article></div>', '<div class="ad-slot">Buy now</div>', '<div id="sidebar-left">x</div>', "<nav>y</nav>"):
        assert html.text_of(html.blocks_of(f"{extra}<article>{story}{extra}</article>{extra}"), None, None) == "The story of the day", extra


def test_what_is_around_an_article_never_empties_it():
    story = "<p>The story of the day</p>"
    read = lambda page: html.text_of(html.blocks_of(page), None, None)
    for page in (
        f"<form method=post><nav>menu</nav><article>{story}</article></form>", f"<header>logo<main>{story}</main></header>", f"<aside>side<article>{story}</article>", f"<form><label>Name</label><div id=content>{story}</div><button>Go</button></form>",
        f'<div aria-hidden="false"><article>{story}</article></div>', f'<div data-hidden="no"><article>{story}</article></div>', f"<article class=not-hidden>{story}</article>", f"<article data-x=hidden>{story}</article>",
    ):
        assert read(page) == "The story of the day", page
    for extra in (
        "<aside><article><p>Read also</p></article></aside>", "<form><p>Sign up</p></form>", "<footer><main>x</main></footer>", "<div hidden>x</div>", "<div hidden=until-found>x</div>", "<p class=x hidden>y</p>",
        '<div class="related-posts">More</div>', '<div class="google-ads">Buy</div>', '<div class="cookie-banner">We use</div>', '<div class="share-buttons">Share</div>', '<div class="menu-main">Home</div>', '<div class="topnav">Home</div>',
    ):
        assert read(f"{extra}<article>{story}</article>{extra}") == "The story of the day", extra
    for extra in ('<div class="related-posts">More</div>', '<div class="share-buttons">Share</div>', "<form><p>Sign up</p></form>", "<aside><p>Side</p></aside>"):
        assert read(f"<main>{story}{extra}</main>") == "The story of the day", extra


def test_repetition_decides_within_articles(spark):
    """A notice within the articles of most pages goes; texts that two pages share, and passages of some, stay."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdef"), 6)) for _ in range(3000)]
    fresh = lambda n: " ".join(rng.choice(words, n))
    notice, passage, same = fresh(60), fresh(70), fresh(200)
    story = [[fresh(30), same if i < 2 else fresh(40), f"{fresh(5)} {passage}" if i % 4 == 0 else fresh(20)] for i in range(40)]
    page = lambda s, extra: f"<nav>menu</nav><article>{''.join(f'<p>{x}</p>' for x in s)}<p>{extra}</p></article>"
    data = [(i, "http://one.example/", page(s, notice if i % 3 else "fin")) for i, s in enumerate(story)]
    data += [(100 + i, f"http://two{i}.example/", page(story[i], notice)) for i in range(9)]
    data += data[:3] * 2
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(5)
    want = {i: "\n\n".join([*s, *([] if i % 3 else ["fin"])]) for i, s in enumerate(story)} | {100 + i: "\n\n".join([*story[i], notice]) for i in range(9)}
    for most in (html.HOST_BYTES, 0):
        rows = html.main_text(pages, host_bytes=most).collect()
        assert len(rows) == len(data) and {r["page_id"]: r["text"] for r in rows} == want


def test_main_text_of_a_large_host(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdef"), 6)) for _ in range(3000)]
    notice = " ".join(rng.choice(words, 30))
    phrases = [" ".join(rng.choice(words, 5)) for _ in range(20)]
    copied = " ".join(rng.choice(words, 60))
    fresh = lambda n: " ".join(rng.choice(words, n))
    story = [[f"{fresh(9)} {phrases[i % 20]} {fresh(9)}", f"{fresh(12)} {phrases[(i + 7) % 20]}", copied if i < 4 else fresh(20)] for i in range(120)]
    data = [(i, "http://big.example/", f"<div>Welcome to our very nice site</div>{''.join(f'<div>{x}</div>' for x in s[:2])}<div>{s[2]} {notice}</div><div>Home</div>") for i, s in enumerate(story)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    for most in (html.HOST_BYTES, 0):
        got = {r["page_id"]: r["text"] for r in html.main_text(pages, host_bytes=most).collect()}
        assert got == {i: "\n\n".join(s) for i, s in enumerate(story)}  # the notice's run covers "Home"


def test_pipeline(spark, tmp_path, docs):
    folder = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    item = docs.where("doc_id = 4").first()["text"]
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    columns, at = ["doc_id", "text", "lang", "source", "n_chars"], spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = stage(step(spark, at, folder), name)
        assert out.columns[:5] == columns and (i == 4 or len(out.columns) == 5)
        at = out
    whole = corpus_pipeline.run(spark, folder)
    assert collected(whole, "doc_id", "mix_shard", "mix_copy") == collected(at, "doc_id", "mix_shard", "mix_copy")
    ids = {r["doc_id"] for r in whole.collect()}
    assert not ids & {4, 24, 25, 26, 30, 31, 32, 33} and len(ids) > 10


def test_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.main_text(pages).count() == 0 and warc.fixity(warc.page_records(pages)).count() == 0
    docs = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    each, _ = mixing.mix(docs)
    assert collected(each, "doc_id", "size", "target", "times") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
