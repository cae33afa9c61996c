"""Cross-sections by day: ranks, picks, spreads, universes.

A day's cross-section holds one row per listed symbol, so day windows are bounded by the
listing count; panels arrive here already reduced to symbol-days. Ties break on symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.windows import by_symbol, col


def ranked(panel: DataFrame, rank_by: Column | str, min_symbols: int = 1) -> DataFrame:
    """Add ``lo`` (ascending rank), ``hi`` (descending rank) and ``breadth`` per day."""
    x = col(rank_by)
    day = W.partitionBy("day")
    out = panel.withColumn("lo", F.row_number().over(day.orderBy(x.asc(), "symbol")))
    out = out.withColumn("breadth", F.count(F.lit(1)).over(day))
    return out.withColumn("hi", F.col("breadth") - F.col("lo") + 1).where(
        F.col("breadth") >= min_symbols
    )


def ranking_spread(
    panel: DataFrame,
    rank_by: str,
    outcome: str,
    k: int = 2,
    min_symbols: int = 10,
    gate: Column | None = None,
    drop_nulls: tuple[str, ...] | None = None,
) -> DataFrame:
    """(day, v): mean outcome of the top ``k`` minus the bottom ``k`` names by ``rank_by``.

    Rows missing the rank or the outcome leave before the breadth count, then the gate
    applies, and days with fewer than ``min_symbols`` names are left out.
    """
    need = [rank_by, outcome] if drop_nulls is None else list(drop_nulls)
    rows = panel.dropna(subset=need) if need else panel
    if gate is not None:
        rows = rows.where(gate)
    r = ranked(rows.select("day", "symbol", F.col(rank_by).alias("x"), F.col(outcome).alias("y")), "x", min_symbols)
    return (
        r.where((F.col("lo") <= k) | (F.col("hi") <= k))
        .groupBy("day")
        .agg(
            (
                F.sum(F.when(F.col("hi") <= k, F.col("y"))) / k
                - F.sum(F.when(F.col("lo") <= k, F.col("y"))) / k
            ).alias("v")
        )
    )


def ranking_spreads(panel: DataFrame, specs: dict[str, dict], outcome: str = "fwd7") -> DataFrame:
    """(cell, day, v) for several rankings of one panel.

    The rankings are unpivoted to (cell, day, symbol, x, y) after the features are in place,
    so all of them share a single shuffle on (cell, day).
    """
    rows = []
    for name, spec in specs.items():
        gate = spec.get("gate")
        keep = F.col(outcome).isNotNull() & F.col(spec["by"]).isNotNull()
        if gate is not None:
            keep = keep & F.coalesce(gate, F.lit(False))
        rows.append(
            F.when(
                keep,
                F.struct(
                    F.lit(name).alias("cell"),
                    F.lit(spec.get("min_symbols", 10)).alias("need"),
                    F.col(spec["by"]).cast("double").alias("x"),
                ),
            )
        )
    packed = F.filter(F.array(*rows), lambda s: s.isNotNull())
    long = panel.select("day", "symbol", F.col(outcome).alias("y"), F.inline(packed))
    group = W.partitionBy("cell", "day")
    k = 2
    r = long.withColumn("lo", F.row_number().over(group.orderBy("x", "symbol"))).withColumn(
        "breadth", F.count(F.lit(1)).over(group)
    )
    r = r.withColumn("hi", F.col("breadth") - F.col("lo") + 1).where("breadth >= need")
    return (
        r.where(f"lo <= {k} or hi <= {k}")
        .groupBy("cell", "day")
        .agg(
            (F.sum(F.when(F.col("hi") <= k, F.col("y"))) / k - F.sum(F.when(F.col("lo") <= k, F.col("y"))) / k).alias("v")
        )
    )


def top_k(panel: DataFrame, rank_by: Column | str, k: int, min_symbols: int = 1) -> DataFrame:
    return ranked(panel, rank_by, min_symbols).where(F.col("hi") <= k)


def universes(
    bars: DataFrame, size: int, volume_window: int, min_history: int, every: int, start: str, end: str
) -> DataFrame:
    """Point-in-time universes: (effective, symbol, turnover, rank).

    On each reselection date, symbols with at least ``min_history`` bars so far are ranked by
    the mean quote volume of their last ``volume_window`` bars, positive only, ties by symbol
    descending. Each bar's trailing figures are window columns valid until the symbol's next
    bar, so the dates a bar answers for follow from date arithmetic: one explode over at most
    the gap to the next bar, no range join.
    """
    trail = by_symbol().rowsBetween(-(volume_window - 1), 0)
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    state = bars.select(
        "symbol",
        "day",
        F.avg("quote_volume").over(trail).alias("turnover"),
        F.row_number().over(by_symbol()).alias("bars"),
        F.lead("day").over(by_symbol()).alias("next_day"),
    ).where((F.col("bars") >= min_history) & (F.col("turnover") > 0))
    lo = F.greatest(F.ceil(F.datediff("day", first) / every), F.lit(0)).cast("int")
    until = F.least(F.coalesce(F.date_sub("next_day", 1), last), last)
    hi = F.floor(F.datediff(until, first) / every).cast("int")
    picks = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    at = state.select("symbol", "turnover", F.explode(picks).alias("k")).select(
        F.date_add(first, F.col("k") * every).alias("effective"), "symbol", "turnover"
    )
    w = W.partitionBy("effective").orderBy(F.col("turnover").desc(), F.col("symbol").desc())
    return at.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)


def universe_turnover(universe: DataFrame) -> DataFrame:
    """(effective, size, added): names entering at each reselection after the first."""
    sets = universe.groupBy("effective").agg(F.sort_array(F.collect_list("symbol")).alias("names"))
    prev = F.lag("names").over(W.orderBy("effective"))  # one row per reselection date
    return sets.select(
        "effective", F.size("names").alias("size"), F.size(F.array_except("names", prev)).alias("added"), prev.alias("__prev")
    ).where("__prev is not null").drop("__prev")


def mask_members(panel: DataFrame, universe: DataFrame, every: int, start: str, end: str) -> DataFrame:
    """Keep panel rows whose symbol is in the universe in force that day.

    Reselection dates sit on a grid that stops at ``end``, so the date in force is arithmetic
    and the lookup is a plain equi semi join; days before the first selection keep nothing. A
    date that selected nothing leaves the previous universe in force.
    """
    first = F.lit(start).cast("date")
    last = F.floor(F.datediff(F.lit(end).cast("date"), first) / every)
    slot = F.least(F.floor(F.datediff("day", first) / every), last).cast("int")
    chosen = universe.select("effective").distinct()
    spans = chosen.select(
        "effective",
        F.floor(F.datediff("effective", first) / every).cast("int").alias("k"),
        F.lead("effective").over(W.orderBy("effective")).alias("next"),
    )
    upto = F.coalesce(F.floor(F.datediff("next", first) / every).cast("int") - 1, last.cast("int"))
    slots = spans.select("effective", F.explode(F.sequence("k", F.greatest(upto, F.col("k")))).alias("slot"))
    members = universe.select("effective", "symbol").join(slots, "effective").select("slot", "symbol")
    keyed = panel.where(F.col("day") >= first).withColumn("slot", slot)
    return keyed.join(members, ["slot", "symbol"], "left_semi").drop("slot")
