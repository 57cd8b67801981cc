"""Global order without a single task: places, ranks, tiles, running sums, lags and exact percentiles.

Rows are dealt to range partitions by their group and order and written once, so that all that reads
them sees the same borders.  Within a partition a window counts; what lies before it in its group is
carried in from one row a partition, and so is what equal keys on both sides of a border share.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..sources.scratch import staged


def _carried(long: DataFrame, by: Sequence[str], keys: Sequence[str], value: str | None) -> tuple[DataFrame, DataFrame]:
    """(what lies before each partition of a group that has several, what keys on borders share).

    Both have a row or few a partition: a group lies in one partition, or in adjoining ones."""
    key = F.struct(*keys)
    one = long.groupBy(*by, "__p").agg(
        F.max("__i").alias("n"), F.min_by(key, "__i").alias("k0"), F.max_by(key, "__i").alias("k1"), F.max("__rank").alias("rank1"), F.max("__dense").alias("dense"),
        *([F.sum(value).alias("total"), F.min_by("__upto", "__i").alias("upto0")] if value else []),
    )
    whole = Window.partitionBy(*by)
    one = one.withColumn("__parts", F.count(F.lit(1)).over(whole)).where("__parts > 1")
    earlier = whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    shared = (F.col("k0") == F.lag("k1").over(whole.orderBy("__p"))).cast("int")  # its first key goes on from the partition before
    one = one.withColumn("__shared", F.coalesce(shared, F.lit(0)))
    one = one.withColumns({"__before": before("n"), "__all": F.sum("n").over(whole), "__dense_before": before("dense") - F.sum("__shared").over(whole.orderBy("__p"))})
    if value:
        one = one.withColumns({"__sum": before("total"), "__total": F.sum("total").over(whole)})
    heads = one.select(*by, F.col("k0").alias("k"), F.lit(None).cast("long").alias("rank"), *([(F.col("__sum") + F.col("upto0")).alias("upto"), F.col("__p").alias("at")] if value else []))
    tails = one.select(*by, F.col("k1").alias("k"), (F.col("__before") + F.col("rank1")).alias("rank"), *([F.lit(None).cast("double").alias("upto"), F.lit(None).cast("int").alias("at")] if value else []))
    both = heads.unionByName(tails).groupBy(*by, "k").agg(F.min("rank").alias("__k_rank"), *([F.max_by("upto", "at").alias("__k_upto")] if value else []))
    return one.select(*by, "__p", "__before", "__all", "__dense_before", *(["__sum", "__total"] if value else [])), both


def ordered(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), then: Sequence[str | Column] = (), value: str | None = None) -> DataFrame:
    """df with each row's place in the order of its group, over tasks of a bounded size:

    place (from 1), size (rows of the group), rank and dense_rank by `order` (place orders equal rows by
    `then`), and for a value running (its sum over all rows up to and with the equal ones) and total.
    Ascending, nulls first; an order with null, equal or repeated keys is fine.  Columns come back as
    __place, __size, __rank, __dense, __running and __total.
    """
    names = [f"__o{i}" for i in range(len(order))]
    more = [f"__t{i}" for i in range(len(then))]
    keyed = df.withColumns({n: col(c) for n, c in zip([*names, *more], [*order, *then])})
    if value:
        keyed = keyed.withColumn("__value", F.coalesce(F.col(value), F.lit(0)))
    long = staged(keyed.repartitionByRange(*by, *names, *more).withColumn("__p", F.spark_partition_id()))
    part = Window.partitionBy(*by, "__p")
    seen = part.orderBy(*names, *more)
    ranks = part.orderBy(*names)
    long = long.withColumns({"__i": F.row_number().over(seen).cast("long"), "__rank": F.rank().over(ranks).cast("long"), "__dense": F.dense_rank().over(ranks).cast("long")})
    if value:
        long = long.withColumn("__upto", F.sum("__value").over(ranks.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    one, shared = _carried(long, by, names, "__value" if value else None)
    same = lambda a, b, cs: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cs]
    joined = long.alias("x").join(F.broadcast(one).alias("y"), [*same("x", "y", by), F.col("x.__p") == F.col("y.__p")], "left")
    joined = joined.join(F.broadcast(shared).alias("z"), [*same("x", "z", by), F.struct(*[F.col(f"x.{n}") for n in names]) == F.col("z.k")], "left")
    zero = lambda c: F.coalesce(F.col(f"y.{c}"), F.lit(0))
    out = {
        "__place": zero("__before") + F.col("x.__i"), "__size": F.coalesce(F.col("y.__all"), F.count(F.lit(1)).over(Window.partitionBy(*[F.col(f"x.{c}") for c in by], F.col("x.__p")))),
        "__rank": F.coalesce(F.col("z.__k_rank"), zero("__before") + F.col("x.__rank")), "__dense": zero("__dense_before") + F.col("x.__dense"),
    }
    if value:
        out["__running"] = F.coalesce(F.col("z.__k_upto"), zero("__sum") + F.col("x.__upto"))
        out["__total"] = F.coalesce(F.col("y.__total"), F.sum("x.__value").over(Window.partitionBy(*[F.col(f"x.{c}") for c in by], F.col("x.__p"))))
    return joined.select(*[F.col(f"x.{c}") for c in df.columns], *[v.alias(n) for n, v in out.items()])


def tile(n: int, place: str = "__place", size: str = "__size") -> Column:
    """NTILE(n) from a place and a size: the first size mod n tiles hold one row more."""
    few, more, at = F.floor(F.col(size) / n), F.col(size) % n, F.col(place) - 1
    big = more * (few + 1)
    return (F.when(at < big, F.floor(at / (few + 1))).otherwise(more + F.floor((at - big) / F.greatest(few, F.lit(1)))) + 1).cast("int")


def percent_rank(rank: str = "__rank", size: str = "__size") -> Column:
    return F.when(F.col(size) > 1, (F.col(rank) - 1) / (F.col(size) - 1)).otherwise(0.0)


def lagged(placed: DataFrame, c: str, n: int, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The value of a column n rows before each row of ordered(): a join by place."""
    keys = [*by, "__place"]
    back = placed.select(*[F.col(k).alias(f"__b_{k}") for k in by], (F.col("__place") + n).alias("__b___place"), F.col(c).alias(name))
    return placed.join(back, [F.col(k).eqNullSafe(F.col(f"__b_{k}")) for k in keys], "left").drop(*[f"__b_{k}" for k in keys])


def percentiles(df: DataFrame, value: str, at: Mapping[str, float], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """A row a group with exact percentiles (interpolated, nulls aside) under the given names.

    Values are counted first, so that a group holds each distinct one once; of the ordered values only the
    two next to each wanted place meet.  A group without values has none.  A weight says how many rows a row
    stands for.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    some = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(n.alias("__n"))
    placed = ordered(some, ["__v"], by, value="__n")
    # Values fill the places running - n to running - 1; a percentile lies between two places.
    low = {name: F.floor((F.col("__total") - 1) * q) for name, q in at.items()}
    part = {name: (F.col("__total") - 1) * q - low[name] for name, q in at.items()}
    first = F.col("__running") - F.col("__n")
    hit = lambda p: (first <= p) & (p < F.col("__running"))
    near = F.lit(False)
    for n in at:
        near = near | hit(low[n]) | hit(low[n] + 1)
    pick = lambda n, p: F.max(F.when(hit(p), F.col("__v")))
    out = placed.where(near).groupBy(*by).agg(*[c for n in at for c in (pick(n, low[n]).alias(f"__l_{n}"), pick(n, low[n] + 1).alias(f"__h_{n}"), F.max(part[n]).alias(f"__w_{n}"))])
    between = lambda n: F.col(f"__l_{n}") + (F.coalesce(F.col(f"__h_{n}"), F.col(f"__l_{n}")) - F.col(f"__l_{n}")) * F.col(f"__w_{n}")
    return out.select(*by, *[between(n).alias(n) for n in at])
