"""Main text of web pages, with host suffix arrays.

Pages are cut into blocks by their block-level elements.  A block within an article or main element is
MAIN, one in menus, forms, comments, hidden parts and the like CHROME, one under a class or id that
names an advert, a sidebar and the like a HINT, all others OTHER.  Names count as whole words only,
not on the article itself, and an article within a hinted element is MAIN all the same.  An article within
a form, header, footer or aside counts on pages that have no other, and a form's text on pages that have
no text elsewhere: what is around an article never empties a page.

Token streams of a host's pages are concatenated, and a suffix array, cut at a number of tokens, finds
the long substrings that stand on many distinct pages of the host.  What they cover is boilerplate, and
unique runs stay:

- MAIN blocks lose substrings of MAIN_REPEAT tokens that stand in the MAIN blocks of a share of
  MAIN_SHARE of the host's pages, and of MAIN_LEAST at least.  (Articles that a host carries twice, and
  passages that some of its articles share, are main text.)  Only pages with anchors (the least hash of
  any run of MAIN_REPEAT tokens) that stand on so many pages go on to the suffix arrays: such a
  substring holds such an anchor.
- Of pages without MAIN text, OTHER blocks lose substrings of REPEAT tokens, and whole blocks of BLOCK
  tokens, that stand on a share of SHARE of the host's pages, on two at least.  If nothing is left, the
  HINT blocks are treated so: names alone never empty a page.

A run that reaches into a block by less than its least length takes nothing from it.  Hosts whose
streams have HOST_BYTES at most are sorted in one task each; the suffixes of larger hosts are compared
in a shuffle, by 128-bit hashes.

A null or empty page has no text.  A null url is a host of its own.  Pages with equal id, url and html
(repeated rows) count as one page, by a 64-bit hash, and get equal texts.  Long pages are read whole.
An empty table gives an empty result.  Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, read, stage
from .substrings import sliding

#: Tokens from which a repeated substring is boilerplate, and those of a whole block.
REPEAT, BLOCK = 25, 5
#: Share of a host's pages on which boilerplate stands at least.
SHARE = 0.1
#: The same for what stands in articles, the least number of pages, and the tokens of an anchor.
MAIN_REPEAT, MAIN_SHARE, MAIN_LEAST, GRAM = 50, 0.5, 5, 10
#: Bytes of a host's streams that are gathered in one task at most.
HOST_BYTES = 4_000_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noframes xmp template svg math object".split())
_CHROME = frozenset("nav header footer aside form menu dialog button select fieldset label datalist head".split())
_MAIN = frozenset(("article", "main"))
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open sibling of these names, if it is the nearest element but for inline ones, div, p and address.
_SIBLINGS = {
    **{name: frozenset((name,)) for name in ("li", "option")},
    **{name: frozenset(("dt", "dd")) for name in ("dt", "dd")},
    **{name: frozenset(("td", "th")) for name in ("td", "th")},
    "tr": frozenset(("td", "th", "tr")),
    **{name: frozenset("td th tr tbody thead tfoot caption colgroup".split()) for name in ("tbody", "thead", "tfoot")},
}
_WALLS = (_BLOCKS | {"button", "colgroup"}) - {"address", "div", "p"}
#: Within a table they end all that is open above the nearest of these.
_CONTEXTS = {"tr": ("table", "tbody", "thead", "tfoot"), "td": ("table", "tbody", "thead", "tfoot", "tr"), "th": ("table", "tbody", "thead", "tfoot", "tr"), **{name: ("table",) for name in ("tbody", "thead", "tfoot")}}
#: Start tags that end a paragraph, unless one of the latter opened within it.
_ENDS_P = _BLOCKS - frozenset("body caption frameset head legend option select tbody td tfoot th thead tr".split())
_KEEPS_P = ("caption", "table", "td", "th", "button")
_AROUND = r"(?:(?:site|page|main|top|bottom|left|right|primary|secondary|global|post|entry|article|user|reader|blog|google|js|wp)[-_]*)*(?:%s)(?:[-_]*(?:area|list|box|wrapper|wrap|section|container|bar|widget|block|form|links?|items?|inner|outer|top|bottom|left|right|message|text|slot|unit|main|posts?|buttons?|banner|stories|[0-9]+))*"
#: Names of what readers write; of what never belongs to an article; and of what may be a part of one.
_COMMENT_NAME = re.compile(_AROUND % "comments?|reply|replies|respond|disqus", re.I)
_ALIEN_NAME = re.compile(
    _AROUND % r"ads?|advert\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|widget|footer|copyright|cookies?|consent|gdpr|notice|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommended", re.I,
)
_LAYOUT_NAME = re.compile(_AROUND % "banner|header|masthead|topbar|side|foot|alert|search", re.I)
_CHROME_ROLE = re.compile(r"navigation|banner|contentinfo|search|complementary|dialog|alert|menu", re.I)
_ATTRIBUTES = re.compile(r"""(?:"[^"]*"|'[^']*'|[^>"'])*+>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"(?:^|[\s/])hidden(?=[\s=/]|$)", re.I)
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_SPACES = re.compile(r"[ \t-\r]+")
HINT, MAIN, OTHER, CHROME = 3, 2, 1, 0
#: While a page is read: what is in forms, in other elements that at times wrap a page, and in articles within both.
_FORM, _SOFT, _SUNK = 6, 5, 4
_WRAPS = frozenset(("header", "footer", "aside"))


def blocks_of(page: str) -> list[tuple[str, int]]:
    """(text, MAIN, OTHER, HINT or CHROME) of each block with text, in page order."""
    out: list[tuple[str, int]] = []
    open_: list[tuple[str, int]] = [("", OTHER)]
    # The places in open_ of each name, and those of the walls: the last ones are found in constant time.
    places: dict[str, list[int]] = {}
    walls: list[int] = []
    text: list[str] = []
    # `<` of raw elements' ends is looked up once a name; a search that failed needn't be made again.
    ends: dict[str, int] = {}
    lower = None

    def flush() -> None:
        if text:
            t = _SPACES.sub(" ", references.unescape("".join(text))).strip(" ")
            if t:
                out.append((t, open_[-1][1]))
            text.clear()

    def last(*names: str) -> int:
        return max(x[-1] if (x := places.get(name)) else 0 for name in names)

    def cut(k: int) -> None:
        while len(open_) > k:
            places[open_.pop()[0]].pop()
        while walls and walls[-1] >= k:
            walls.pop()

    i, n = 0, len(page)
    while i < n:
        at = page.find("<", i)
        if at < 0:
            text.append(page[i:])
            break
        if at > i:
            text.append(page[i:at])
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            i = n if end < 0 else end + 3
            continue
        m = _NAME.match(page, at + 1)
        if not m:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at)
                i = n if end < 0 else end + 1
            else:
                text.append("<")
                i = at + 1
            continue
        close = page[at + 1] == "/"
        a = _ATTRIBUTES.match(page, m.end())
        end = a.end() if a else page.find(">", m.end()) + 1
        if end <= 0:  # cut off within a tag
            break
        name, i = m[1].lower(), end
        if name in _RAW:
            if not close and page[end - 2] != "/":
                lower = page.lower() if lower is None else lower
                k = ends.get(name, 0)
                if k >= 0 and k < end:
                    k = ends[name] = lower.find(f"</{name}", end)
                i = n if k < 0 else k
            continue
        if name in _BLOCKS or name in _CHROME and _FORM in (open_[-1][1], open_[max(0, len(open_) - 2)][1]):
            flush()
        elif name == "br":
            text.append(" ")
        if name in _VOID:
            continue
        if close:
            if k := last(name):
                cut(k)
            continue
        if name in _ENDS_P and (k := last("p")) > last(*_KEEPS_P):
            cut(k)
        if name in _CONTEXTS and (k := last("table")):
            cut(max(k, last(*_CONTEXTS[name])) + 1)
        elif name in _SIBLINGS:
            while walls and open_[walls[-1]][0] in _SIBLINGS[name]:
                cut(walls[-1])
        state = open_[-1][1]
        attributes = page[m.end() : end - 1]
        if state != CHROME:
            main_above = state in (MAIN, _SUNK)
            found = {x[0].lower(): x[1] or x[2] or x[3] for x in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
            names = f"{found.get('class', '')} {found.get('id', '')}".split()
            named = lambda pattern: any(map(pattern.fullmatch, names))
            main = name in _MAIN or found.get("role") in _MAIN or found.get("itemprop") == "articleBody"
            if name not in ("html", "body"):
                if (
                    (name in _CHROME and name not in _WRAPS and name != "form")
                    or (name in _WRAPS and name != "header" and main_above)
                    or _CHROME_ROLE.fullmatch(found.get("role", ""))
                    or named(_COMMENT_NAME)
                    or _HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes))
                    or re.search(r"display\s*:\s*none", found.get("style", ""))
                ):
                    state = CHROME
                elif main:
                    state = _SUNK if state in (_FORM, _SOFT, _SUNK) else MAIN
                elif name == "form":
                    state = CHROME if main_above else _FORM if state != _SOFT else state
                elif name in _WRAPS and not main_above:
                    state = _SOFT
                elif named(_ALIEN_NAME):
                    state = CHROME if main_above or state in (_FORM, _SOFT) else HINT
                elif state == OTHER and named(_LAYOUT_NAME):
                    state = HINT
        if page[end - 2] != "/":
            places.setdefault(name, []).append(len(open_))
            if name in _WALLS:
                walls.append(len(open_))
            open_.append((name, state))
    flush()
    # An article isn't lost to what is around it, nor a page to a form that holds all of it.
    states = {s for _, s in out}
    back = {}
    if MAIN not in states:
        back = {_SUNK: MAIN} if _SUNK in states else {_FORM: OTHER} if not states & {OTHER, HINT} else {}
    return [(t, s if s <= HINT else back.get(s, CHROME)) for t, s in out]


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(key, page id, url, host, blocks (text, state)) for each row of pages."""
    block = pa.struct([("text", pa.string()), ("state", pa.int8())])

    def run(batches):
        for b in batches:
            blocks = [[{"text": x, "state": s} for x, s in blocks_of(t or "")] for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(blocks, pa.list_(block))], ["key", id_col, url_col, "host", "blocks"])

    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit("")))
    source = pages.select(key.alias("key"), F.col(id_col), F.col(url_col), host.alias("host"), F.col(html_col))
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return source.mapInArrow(run, f"key long, {id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, host string, blocks array<struct<text: string, state: tinyint>>")


def distinct_pages(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys of repeated rows with their count; hosts with the number of their distinct pages)."""
    repeated = stage(cut.groupBy("key").count().where("count > 1"), "repeated")
    pages = cut.select("key", "host").join(checked(repeated), "key", "left").groupBy("host").agg(F.round(F.sum(1 / F.coalesce("count", F.lit(1)))).cast("long").alias("pages"))
    return repeated, stage(pages, "hosts")


def anchors_of(blocks: list[str], host: str, length: int, gram: int) -> np.ndarray:
    """The distinct anchors of a page's stream: of any `length` tokens the `gram` tokens with the least hash, with the host."""
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for x in blocks for w in x.split(" ")), np.uint64)
    if len(own) < length:
        return np.zeros(0, np.int64)
    n, h, factor = len(own) - gram + 1, np.uint64(digest(host.encode())), 1
    grams = np.zeros(n, np.uint64)
    for j in range(gram):
        grams += own[j : j + n] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 % 2**64
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((sliding(grams, length - gram + 1, np.minimum, np.uint64(2**64 - 1)) ^ h) * np.uint64(0xA0761D6478BD642F)).view(np.int64)


def with_common_anchors(main: DataFrame, hosts: DataFrame, repeated: DataFrame, length: int = MAIN_REPEAT, gram: int = GRAM, share: float = MAIN_SHARE, least: int = MAIN_LEAST) -> DataFrame:
    """The rows of main(key, host, blocks) that hold an anchor which stands on enough of the host's pages."""

    def run(batches):
        for b in batches:
            key, own = b.column(0).to_numpy(), [anchors_of(x, h or "", length, gram) for h, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            n = np.array([len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, n)), b.column(1).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.concatenate(own))], ["key", "host", "anchor"])

    anchors = main.mapInArrow(run, "key long, host string, anchor long")
    weight = 1 / F.coalesce("count", F.lit(1))
    met = anchors.join(checked(repeated), "key", "left").groupBy("anchor").agg(F.sum(weight).alias("on")).where(F.col("on") > least - 0.5)
    met = checked(stage(met, "common"))
    if met.isEmpty():
        return main.where("false")
    hits = anchors.join(met, "anchor").join(checked(hosts, 100_000), "host").where(F.col("on") > F.greatest(F.lit(least), F.ceil(F.col("pages") * share)) - 0.5)
    return main.join(checked(stage(hits.select("key").distinct(), "hits")), "key", "left_semi")


def repeated_starts(tokens: list[list[str]], pages: np.ndarray, length: int = REPEAT, least: int = 2) -> list[np.ndarray]:
    """For each stream of tokens (of page pages[i]) the starts of the substrings of `length` tokens that
    stand on `least` pages: neighbours in the suffix array, cut at `length`, of their concatenation."""
    sizes = np.array([len(t) for t in tokens])
    if not sizes.sum():
        return [np.zeros(0, np.int64) for _ in tokens]
    _, ids = np.unique(np.array([x for t in tokens for x in t], dtype=object), return_inverse=True)
    owner = np.repeat(np.arange(len(tokens)), sizes)
    begin = np.cumsum(sizes) - sizes
    left = sizes[owner] - (np.arange(len(ids)) - begin[owner])  # tokens up to the end of the stream
    rank, done = ids.astype(np.int64), 1
    while done < length:  # suffixes are ranked by `done` tokens; now by `done + step`
        step = min(done, length - done)
        ahead = np.full(len(rank), -1, np.int64)
        inside = np.flatnonzero(left >= done + step)
        ahead[inside] = rank[inside + step]
        _, rank = np.unique(rank * (len(ids) + 2) + ahead + 1, return_inverse=True)
        done += step
    whole = np.flatnonzero(left >= length)
    order = whole[np.lexsort((pages[owner[whole]], rank[whole]))]
    if not len(order):
        return [np.zeros(0, np.int64) for _ in tokens]
    page = pages[owner[order]]
    new = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    other = new | np.concatenate([[True], page[1:] != page[:-1]])
    group = np.cumsum(new) - 1
    many = np.bincount(group, weights=other) >= least
    hit = np.sort(order[many[group]])
    cut = np.searchsorted(hit, begin)
    return [hit[i:j] - b for i, j, b in zip(cut, [*cut[1:], len(hit)], begin)]


def repeated_blocks(blocks: list[list[str]], pages: np.ndarray, least: int = 2) -> list[list[int]]:
    """For each page's list of blocks the places of those of BLOCK tokens or more that stand on `least` pages."""
    where: dict[str, set[int]] = {}
    for own, page in zip(blocks, pages.tolist()):
        for x in own:
            if x.count(" ") >= BLOCK - 1:
                where.setdefault(x, set()).add(page)
    return [[i for i, x in enumerate(own) if len(where.get(x, ())) >= least] for own in blocks]


def hashed_grams(blocks: list[str], length: int = REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """(starts, two hashes each) of the substrings of `length` tokens of a page's stream, and (-1 - i) of its blocks i."""
    cut = [x.split(" ") for x in blocks]
    kinds, at = np.unique(np.array([x for t in cut for x in t] or [""], dtype=object), return_inverse=True)
    own = np.array([np.frombuffer(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest(), np.uint64) for x in kinds])[at]
    n = max(0, len(at) - length + 1) if blocks else 0
    grams, factor = np.zeros((n, 2), np.uint64), np.ones(2, np.uint64)
    for j in range(length):
        grams += own[j : j + n] * factor
        factor = factor * np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
    long = [i for i, t in enumerate(cut) if len(t) >= BLOCK]
    whole = [np.frombuffer(hashlib.blake2b(blocks[i].encode("utf-8", "surrogatepass"), digest_size=16, person=b"block").digest(), np.uint64) for i in long]
    return np.concatenate([np.arange(n), -1 - np.array(long, np.int64)]), np.concatenate([grams, np.array(whole, np.uint64).reshape(-1, 2)]).view(np.int64)


def boilerplate(streams: DataFrame, length: int = REPEAT, whole: bool = True, most: int = HOST_BYTES) -> DataFrame:
    """(key, starts) of streams(key, host, blocks, least): starts are the places of substrings of `length` tokens that
    stand on `least` pages of the host, and, with whole, -1 - i for such a whole block i."""
    streams = streams.dropDuplicates(["key"])
    size = F.sum(F.expr("aggregate(blocks, 0L, (a, x) -> a + octet_length(x) + 1)"))
    # Few hosts are large; their list is broadcast if its counted size allows it.
    large = checked(stage(streams.groupBy("host").agg(size.alias("bytes")).where(F.col("bytes") > most).select("host"), "hosts"), 100_000)

    def sort_host(t: pa.Table) -> pa.Table:
        keys, blocks, least = t.column("key").to_numpy(), t.column("blocks").to_pylist(), t.column("least")[0].as_py()
        runs = repeated_starts([" ".join(x).split(" ") for x in blocks], keys, length, least)
        starts = [[*r.tolist(), *(-1 - i for i in w)] for r, w in zip(runs, repeated_blocks(blocks, keys, least) if whole else [()] * len(keys))]
        some = [i for i, r in enumerate(starts) if r]
        return pa.table({"key": pa.array(keys[some], pa.int64()), "starts": pa.array([starts[i] for i in some], pa.list_(pa.int32()))})

    def explode(batches):
        for b in batches:
            for k in range(b.num_rows):
                starts, both = hashed_grams(b.column(2)[k].as_py(), length)
                if not whole:
                    starts, both = starts[starts >= 0], both[starts >= 0]
                same = [b.column(i).take(pa.array(np.full(len(starts), k))) for i in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(starts.astype(np.int32)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["key", "host", "least", "start", "a", "b"])

    by_host = streams.join(large, "host", "left_anti").groupBy("host").applyInArrow(sort_host, "key long, starts array<int>")
    grams = streams.join(large, "host", "left_semi").select("key", "host", "blocks", "least").mapInArrow(explode, "key long, host string, least long, start int, a long, b long")
    # A page's repeats are counted once; the count meets in partial sums.
    met = grams.select("host", "a", "b", "least", "key").distinct().groupBy("host", "a", "b", "least").count().where("count >= least").select("host", "a", "b")
    by_shuffle = grams.join(met, ["host", "a", "b"], "left_semi").groupBy("key").agg(F.collect_list("start").alias("starts"))
    return by_host.unionByName(by_shuffle)


def unique_runs(blocks: list[tuple[str, int]], starts: list[int] | None, state: int, length: int = REPEAT) -> str:
    """The blocks of a state, without repeated runs and whole blocks."""
    if not starts:
        return "\n\n".join(t for t, s in blocks if s == state)
    cut = [t.split(" ") for t, _ in blocks]
    hit = np.zeros(sum(map(len, cut)), np.int8)
    whole = {-1 - k for k in starts if k < 0}
    for k in starts:
        if k >= 0:
            hit[k : k + length] = 1
    out, at = [], 0
    for i, ((_, s), t) in enumerate(zip(blocks, cut)):
        own = hit[at : at + len(t)]
        at += len(t)
        if s == state and i not in whole and not own.all():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
            for a, z in zip(edges[::2], edges[1::2]):
                if z - a < length:  # the edge of a run in the next block
                    own[a:z] = 0
            out.append(" ".join(x for x, h in zip(t, own) if not h))
    return "\n\n".join(out)


def text_of(blocks: list[tuple[str, int]], in_main: list[int] | None, in_rest: list[int] | None) -> str:
    """The main text of a page from the places of what is repeated in its MAIN and in its other blocks."""
    main = [b for b in blocks if b[1] == MAIN]
    if main:
        return unique_runs(main, in_main, MAIN, MAIN_REPEAT) or "\n\n".join(t for t, _ in main)
    return unique_runs(blocks, in_rest, OTHER) or unique_runs(blocks, in_rest, HINT)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", host_bytes: int = HOST_BYTES) -> DataFrame:
    """(page id, url, text) for each row of pages.

    Texts stay where they were parsed; only places of repeats move, broadcast where their counted bytes allow it.
    """
    cut = stage(parsed(pages, id_col, url_col, html_col), "pages")
    repeated, hosts = distinct_pages(cut)
    least = lambda share, k: F.greatest(F.lit(k), F.ceil(F.col("pages") * share)).cast("long").alias("least")
    streams = lambda df, which, share, k: df.select("key", "host", F.expr(f"transform(filter(blocks, x -> {which}), x -> x.text)").alias("blocks")).where("size(blocks) > 0").join(checked(hosts, 100_000), "host").select("key", "host", "blocks", least(share, k))

    is_main = f"x.state = {MAIN}"
    in_main = with_common_anchors(cut.select("key", "host", F.expr(f"transform(filter(blocks, x -> {is_main}), x -> x.text)").alias("blocks")).where("size(blocks) > 0"), hosts, repeated)
    in_main = cut.join(checked(stage(in_main.select("key").distinct(), "hits")), "key", "left_semi")
    in_main = boilerplate(streams(in_main, is_main, MAIN_SHARE, MAIN_LEAST), MAIN_REPEAT, False, host_bytes)
    # On pages with MAIN text, what else stands there is context for the host's other pages only.
    bare = cut.where(f"not exists(blocks, x -> {is_main}) and size(blocks) > 0").select("key").distinct()
    in_rest = boilerplate(streams(cut, f"not {is_main}", SHARE, 2), REPEAT, True, host_bytes).join(bare, "key", "left_semi")
    found = in_main.select("key", F.lit(True).alias("main"), "starts").unionByName(in_rest.select("key", F.lit(False).alias("main"), "starts"))
    found = stage(found, "repeats")
    total = found.agg(F.coalesce(F.sum(F.size("starts") * 4 + 32), F.lit(0))).first()[0]
    joined = cut.join(F.broadcast(found) if total <= 16_000_000 else found, "key", "left").select(id_col, url_col, "blocks", "main", "starts")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches):
        for b in batches:
            text, own = [], b.column(2).flatten()
            each = zip(pc.struct_field(own, "text").to_pylist(), pc.struct_field(own, "state").to_pylist())
            for n, main, starts in zip(pc.list_value_length(b.column(2)).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                text.append(text_of(list(islice(each, n or 0)), starts if main else None, None if main else starts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], [id_col, url_col, "text"])

    return joined.mapInArrow(run, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string")


def op9(spark, sf_dir: str) -> DataFrame:
    out = main_text(read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
