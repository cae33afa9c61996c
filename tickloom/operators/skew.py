"""Ways to keep one hot key, or one global order, from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

SALTS = 16


def with_facts(rows: DataFrame, facts: DataFrame, key: str, salts: int = SALTS, how: str = "inner") -> DataFrame:
    """Join one-row-per-key facts onto many rows per key, the key's rows spread over ``salts``.

    The facts side is repeated once per salt, so the cost of the spread is ``salts`` copies of
    one row per key.
    """
    spread = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    copies = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [key, "__salt"], how).drop("__salt")


def running_total(df: DataFrame, value: Column, order: Sequence[str], bucket: Column, out: str) -> DataFrame:
    """Global running sum of ``value`` before each row in ``order``, without one global sort.

    ``bucket`` must follow ``order``; rows are summed inside their bucket and bucket offsets come
    from a table with one row per bucket.
    """
    rows = df.withColumns({"__b": bucket, "__v": value})
    inner = W.partitionBy("__b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("__b").agg(F.sum("__v").alias("__t"))
    offsets = totals.select(
        "__b", F.coalesce(F.sum("__t").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__off")
    )
    inside = rows.withColumn("__in", F.coalesce(F.sum("__v").over(inner), F.lit(0)))
    return inside.join(offsets, "__b").withColumn(out, F.col("__off") + F.col("__in")).drop("__b", "__v", "__in", "__off")


#: Cut points drawn from a bracket in a round, and distinct values of a bracket that one task may order.
CUTS, ORDERED = 32, 50_000


def _refined(rows: DataFrame, ranks: DataFrame, ordered: int) -> DataFrame:
    """(k, seg, v, c, before): distinct values of brackets that hold a wanted rank, and the rows below each bracket.

    ``rows`` are (k, v, c), distinct values with their counts; ``ranks`` (k, ranks). While a
    bracket has more than ``ordered`` distinct values, cut points are drawn from its own values by
    hash, values are counted between them, and the brackets of wanted ranks are kept. However
    values crowd, cuts fall between them, so every round leaves about one in ``CUTS``.
    """
    rows = rows.withColumns({"seg": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    while True:
        widest = rows.groupBy("k", "seg").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if widest <= ordered:
            return rows
        h = F.xxhash64("v", F.lit(widest))
        at = F.struct("k", "seg").alias("at")
        drawn = rows.groupBy(at, F.pmod(h, F.lit(CUTS)).alias("draw")).agg(F.min_by("v", h).alias("v"))
        cuts = drawn.groupBy("at").agg(F.array_sort(F.collect_list("v")).alias("cuts"))
        place = F.size(F.filter("cuts", lambda x: x <= F.col("v")))
        parted = with_facts(rows.withColumn("at", at), cuts, "at").withColumn("part", place).drop("cuts", "at")
        counted = parted.groupBy("k", "seg", "part").agg(F.sum("c").alias("n"), F.first("before").alias("base"))
        below = F.coalesce(F.sum("n").over(W.partitionBy("k", "seg").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        starts = counted.withColumn("start", F.col("base") + below).join(ranks, "k")
        kept = starts.where(F.exists("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n"))))
        here = F.struct("k", "seg", "part").alias("at")
        inside = with_facts(parted.withColumn("at", here), kept.select(here, "start"), "at")
        rows = cut_lineage(inside.select("k", "v", "c", (F.col("seg") * (CUTS + 1) + F.col("part")).alias("seg"), F.col("start").alias("before")))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float], ordered: int = ORDERED) -> DataFrame:
    """Exact linear percentiles per key, with no task or buffer holding a whole key.

    Equal values are counted map-side first, so a value shared by a third of the rows is one row.
    The brackets that hold the wanted ranks are refined until a task can order one, for any number
    of keys (none: one row) and however close values lie. Null values are left out, and keys
    that have no others; a null key is a key like any other.
    """
    keys = list(keys)
    k = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    v = F.col(value).cast("double")
    vals = cut_lineage(df.where(v.isNotNull()).groupBy(k.alias("k"), v.alias("v")).agg(F.count(F.lit(1)).alias("c")))
    sizes = vals.groupBy("k").agg(F.sum("c").alias("n"))
    places = {name: F.lit(float(q)) * (F.col("n") - 1) for name, q in qs.items()}
    wanted = [f(h).cast("long") for h in places.values() for f in (F.floor, F.ceil)]
    ranks = cut_lineage(sizes.select("k", "n", F.array_distinct(F.array(*wanted)).alias("ranks")))
    inner = W.partitionBy("k", "seg").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    r = _refined(vals, ranks.select("k", "ranks"), ordered).withColumn("hi", F.col("before") + F.sum("c").over(inner)).join(ranks, "k")

    def at(rank: Column) -> Column:
        here = (F.col("hi") - F.col("c") <= rank) & (rank < F.col("hi"))
        return F.max(F.when(here, F.col("v")))

    aggs = []
    for name, h in places.items():
        lo, hi = at(F.floor(h)), at(F.ceil(h))
        aggs.append((lo + F.max(h - F.floor(h)) * (hi - lo)).alias(name))
    out = r.groupBy("k").agg(*aggs)
    return out.select("k.*", *qs) if keys else out.select(*qs)
