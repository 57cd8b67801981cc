"""Mixing sources to target weights with exact block quotas and a splitting tree.

Every source's documents are permuted by a hash and cut into BLOCKS blocks by its leading bits.
A source's target, in words, asks for a number of whole passes over its blocks and, of one more
pass, for the first blocks of the permutation; the block in which the target falls is cut again
into SUB sub-blocks, and the sub-block in which it falls into documents.  FILLS more documents, each the nearest in size to
what is then missing, close the gap.

The block quotas are dealt to the output shards by a splitting tree: the shards are halved again
and again, and each half draws its share of each source's blocks from the multivariate
hypergeometric distribution.  A shard then owns a range of each source's permuted blocks,
disjoint from all other shards', and shuffles it locally.

All groupings are by (source, block), so a source with a third of all rows is spread over
BLOCKS groups.  Draws depend on hashes and a seed only: reruns agree.

Repeated rows (equal id and text) are one row with a number of rows: they share a place in the
permutation, and where the target falls among them, some of them are taken once more than the others.

A null or empty text has no words; it takes part with size 0.  A null source is a source of its
own, the last.  Sources without words get the target 0.  Ties are decided by the hash and the key.  An
empty table gives an empty result.  Further columns pass through, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, checked, fresh, read, row_key, stage

#: Blocks of a source, and sub-blocks of a block.
BLOCKS, SUB = 1024, 4096
#: Documents, nearest in size to what a source still lacks, that are added one after the other.
FILLS = 2
#: Output shards.
SHARDS = 64
#: A document is taken at most so many times, and a source at most so many times its size.
MOST = 3
SEED = 20


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(key, doc id, src, size, place, block, sub, rows) for each id, text and source of docs."""
    size = F.size(F.array_remove(F.split(F.coalesce(text_col, F.lit("")), f"{SPACE}+"), "")).cast("long")
    src = F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1"))  # a null comes last
    out = docs.select(row_key(text_col, id_col).alias("key"), F.col(id_col), src.alias("src"), size.alias("size"))
    out = out.withColumn("place", F.xxhash64(F.lit(SEED), "key"))
    block = F.shiftrightunsigned("place", 64 - 10).cast("int")
    sub = F.shiftrightunsigned("place", 64 - 22).bitwiseAND(F.lit(SUB - 1)).cast("int")
    return out.withColumns({"block": block, "sub": sub}).groupBy("key", id_col, "src", "size", "place", "block", "sub").agg(F.count("*").alias("rows"))


def targets(sources: DataFrame, cycle: int = 3, most: int = MOST) -> DataFrame:
    """sources(src, source_size) with weight and target.

    Weights 1, 2, .. cycle repeat over the sources by code point; targets share the total by
    weight and stop at `most` times the source's size.  With sources in the order of
    size / weight, the capped ones come first: one is capped if, after all before it are, its
    share by weight of what is left passes its cap.
    """
    by_name, by_cap = Window.orderBy("src"), Window.orderBy(F.col("cap") / F.col("weight"), "src")  # one row a source
    t = sources.withColumn("weight", (F.row_number().over(by_name) - 1) % cycle + 1).withColumn("cap", (F.col("source_size") * most).cast("long"))
    total, before = Window.partitionBy(), by_cap.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("left_words", F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    t = t.withColumn("left_weight", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("share", F.col("left_words") / F.col("left_weight"))  # words a weight, if all before are capped
    t = t.withColumn("capped", F.col("weight") * F.col("share") > F.col("cap"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "src", F.col("share").alias("share")))).over(total)["share"]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return t.select("src", "source_size", "weight", target.cast("double").alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Each shard's share of each source's blocks (shards x sources), by a splitting tree."""
    if shards == 1:
        return quotas[None, :]
    half = shards // 2
    total = int(quotas.sum())
    take = total * half // shards
    drawn = rng.multivariate_hypergeometric(quotas, take, method="marginals") if total else quotas
    return np.concatenate([split_quotas(drawn, half, rng), split_quotas(quotas - drawn, shards - half, rng)])


def plan(sizes: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """What to take: (quotas by source, with shard bounds; sizes with the number of times that its rows are taken in all)."""
    words = F.sum(F.col("size") * F.col("rows")).alias("words")
    blocks = stage(sizes.groupBy("src", "block").agg(words), "blocks")
    src = stage(targets(blocks.groupBy("src").agg(F.sum("words").alias("source_size"))), "sources")
    whole = F.least(F.floor(F.expr("case when source_size > 0 then target / source_size else 0 end") + 1e-9), F.lit(MOST)).cast("int")
    src = src.withColumn("passes", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    # At most BLOCKS rows a source; then SUB rows of the block on the edge; then a sub-block's documents.
    ahead = lambda part, order: Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cum = lambda df, part, order, words: df.withColumn("before", F.coalesce(F.sum(words).over(ahead(part, order)), F.lit(0)))
    b = cum(blocks.join(checked(src.select("src", "passes", "rest"), 100_000), "src"), ["src"], ["block"], "words")
    state = F.when(F.col("rest") <= 0, 0).when(F.col("before") + F.col("words") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0).otherwise(2)
    b = b.withColumn("state", state)
    edge = stage(b.where("state = 2").select("src", "block", (F.col("rest") - F.col("before")).alias("rest")), "edge")
    inside = sizes.join(checked(edge, 100_000), ["src", "block"])
    s = cum(inside.groupBy("src", "block", "sub", "rest").agg(words), ["src", "block"], ["sub"], "words").withColumn("state", state)
    last = stage(s.where("state = 2").select("src", "block", "sub", (F.col("rest") - F.col("before")).alias("rest")), "edge")
    d = sizes.join(checked(last, 100_000), ["src", "block", "sub"]).groupBy("src", "block", "sub", "rest", "place", "key", "size").agg(words, F.sum("rows").alias("rows"))
    d = cum(d, ["src", "block", "sub"], ["place", "key"], "words")
    inside = F.least(F.col("rows"), F.floor((F.col("rest") - F.col("before")) / F.col("size"))).cast("long")  # rows of the document before the target
    docs_in = stage(d.where("size > 0").select("src", "key", inside.alias("d_in")).where("d_in > 0"), "edge")
    subs_in = stage(s.where("state = 1").select("src", "block", "sub"), "edge")
    marked = sizes.join(checked(b.select("src", "block", "passes", F.col("state").alias("b_state")), 500_000), ["src", "block"])
    marked = marked.join(checked(subs_in.withColumn("s_in", F.lit(1)), 500_000), ["src", "block", "sub"], "left")
    marked = marked.join(checked(docs_in), ["src", "key"], "left")
    extra = F.when(F.col("b_state") == 1, F.col("rows")).when(F.col("b_state") == 0, 0).otherwise(F.greatest(F.coalesce("s_in", F.lit(0)) * F.col("rows"), F.coalesce("d_in", F.lit(0))))
    most = F.col("rows") * MOST
    marked = marked.withColumn("times", F.least(most, F.col("passes") * F.col("rows") + extra).cast("long")).select(*sizes.columns, "passes", "times")
    # Of the documents left over, the one whose size comes nearest to what is still missing joins too, FILLS times.
    marked = stage(marked, "marked")
    for _ in range(FILLS):
        got = marked.groupBy("src").agg(F.sum(F.col("size") * F.col("times")).alias("got"))
        gap = src.join(got, "src").select("src", (F.col("target") - F.col("got")).alias("gap"))
        spare = marked.where((F.col("times") < (F.col("passes") + 1) * F.col("rows")) & (F.col("times") < most)).join(checked(gap, 50_000), "src")
        spare = spare.where(F.abs(F.col("size") - F.col("gap")) < F.abs("gap"))
        fill = spare.groupBy("src").agg(F.min_by("key", F.struct(F.abs(F.col("size") - F.col("gap")), "place", "key")).alias("key"))
        marked = marked.join(checked(stage(fill.select("src", "key", F.lit(1).alias("fill")), "fill"), 50_000), ["src", "key"], "left")
        marked = marked.withColumn("times", F.col("times") + F.coalesce("fill", F.lit(0))).drop("fill")
    marked = marked.drop("passes")
    # Quotas: whole passes over all blocks and the blocks of the last pass, that on the edge included.
    more = b.groupBy("src").agg(F.count(F.when(F.col("state") > 0, 1)).cast("long").alias("more"))
    quotas = src.join(more, "src").withColumn("quota", F.col("passes") * BLOCKS + F.col("more"))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("src")
        rng = np.random.default_rng([SEED, zlib.crc32(pdf["src"].iloc[0].encode())])
        shares = split_quotas(pdf["quota"].to_numpy(np.int64), shards, rng)
        return pdf.assign(bounds=list(np.cumsum(shares, axis=0).T.astype(np.int64)))[["src", "bounds"]]

    # Sources in lots of some hundreds, each lot split evenly: one row a source, whatever its size.
    lot = F.pmod(F.xxhash64("src"), F.lit(max(1, src.count() // 500)))
    bounds = quotas.select("src", "quota", lot.alias("lot")).groupBy("lot").applyInPandas(split, "src string, bounds array<bigint>")
    rank = b.where("state > 0").withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("block")) - 1).select("src", "block", "rank")
    return quotas.drop("more").join(bounds, "src"), marked.join(checked(stage(rank, "ranks"), 500_000), ["src", "block"], "left")


def mix(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(a row for each row of docs with its number `row` among its like, times, source sizes and targets;
    one row a document and copy with its shard and order)."""
    sizes = stage(sized(docs, id_col, text_col, source_col), "sizes")
    src, marked = plan(sizes, shards)
    src = stage(src, "quotas")
    each = marked.join(checked(src, 50_000), "src").withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    times = F.expr("times div rows") + (F.col("row") <= F.col("times") % F.col("rows")).cast("long")
    each = stage(each.withColumns({"uneven": F.col("times") % F.col("rows") > 0, "times": times.cast("int")}), "taken")
    copies = each.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    unit = F.when(F.col("copy") <= F.col("passes"), (F.col("copy") - 1) * BLOCKS + F.col("block")).otherwise(F.col("passes") * BLOCKS + F.coalesce("rank", F.lit(0)))
    # The number of bounds that a block's place in its source's quota has reached.
    # A source's units are permuted (the factor is a prime above all quotas), so that no shard owns a single pass.
    copies = copies.withColumn("unit", unit).withColumn("unit", F.expr("pmod(unit * 1000003L, quota)")).withColumn("shard", F.least(F.lit(shards - 1), F.expr("size(filter(bounds, x -> x <= unit))")))
    copies = copies.withColumn("order", F.xxhash64(F.lit(SEED + 1), "shard", "key", "copy", "row"))
    return each, copies.select("key", id_col, "src", "size", "row", "uneven", "copy", "shard", "order")


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows with a number from 1 among those with equal `by`; equal rows are numbered in 1,024 lots, not in one task."""
    (lot, ahead) = fresh(rows, "lot", "ahead")
    rows = stage(rows.withColumn(lot, F.pmod(F.monotonically_increasing_id(), F.lit(1024))), "lots")
    counts = rows.groupBy(*by, lot).count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*by).orderBy(lot).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stage(counts.select(*by, lot, before.alias(ahead)), "lots")
    own = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by, lot).orderBy(lot)).cast("long"))
    return own.join(counts, [*by, lot]).withColumn(name, F.col(name) + F.col(ahead)).drop(lot, ahead)


def mixed_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, a row for each time that one is taken, with shard, copy and order within the shard
    (mix_shard, mix_copy, mix_order, with underscores in front where docs has such columns)."""
    _, copies = mix(docs, shards, id_col, text_col, source_col)
    key, src, row, places, p = fresh(docs, "key", "src", "row", "places", "p")
    names = fresh(docs, "mix_shard", "mix_copy", "mix_order")
    keyed = docs.withColumns({key: row_key(text_col, id_col), src: F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1"))})
    place = F.collect_list(F.struct("shard", "copy", "order")).alias(places)
    named = copies.withColumnRenamed("key", key).withColumnRenamed("src", src).withColumnRenamed("row", row)
    # Rows that are all taken alike share the list of their first; only where some are taken once more are they told apart.
    even = named.where(~F.col("uneven") & (F.col(row) == 1)).groupBy(key, src).agg(place)
    uneven = named.where("uneven").groupBy(key, src, row).agg(place)
    which = stage(uneven.select(key, src).distinct(), "uneven")
    out = keyed.join(even, [key, src])
    if not which.isEmpty():
        out = out.unionByName(numbered(keyed.join(checked(which), [key, src], "left_semi"), [key, src], row).join(uneven, [key, src, row]).drop(row))
    out = out.withColumn(p, F.explode(places))
    return out.select(*docs.columns, *[F.col(f"{p}.{c}").alias(n) for c, n in zip(("shard", "copy", "order"), names)])


def taken_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each document with what its drawn copies add up to, and their shards and orders; none for those not taken."""
    each, copies = mix(docs, shards, id_col, text_col, source_col)
    at = ["key", "src", "row"]
    places = copies.groupBy(*at).agg(F.sum("size").alias("taken"), F.count("*").cast("int").alias("times"), F.array_sort(F.collect_list(F.struct("copy", "shard", "order"))).alias("copies"))
    out = each.drop("times").join(places, at, "left")
    taken, times = F.coalesce("taken", F.lit(0).cast("long")), F.coalesce("times", F.lit(0))
    nothing = F.array().cast(places.schema["copies"].dataType)
    return out.select(id_col, "size", "source_size", "target", taken.alias("taken"), times.alias("times"), F.coalesce("copies", nothing).alias("copies"))


#: Rows of a file of a shard, about.
FILE_ROWS = 500_000


def write_shards(mixed: DataFrame, path: str, rows: int | None = None) -> None:
    """Write a mix as one folder a shard, shuffled within it.  Shards of any size are cut into files of about
    `rows` (FILE_ROWS) rows by ranges of their order: the files of a shard, by name, are its order."""
    mixed = stage(mixed, "mixed")  # borders are sampled from what is written
    files = max(1, -(-mixed.count() // (rows or FILE_ROWS)))
    parts = mixed.repartitionByRange(files, "mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")
    parts.write.partitionBy("mix_shard").parquet(path)


def op6(spark, sf_dir: str) -> DataFrame:
    return taken_documents(read(spark, sf_dir, "documents"))
