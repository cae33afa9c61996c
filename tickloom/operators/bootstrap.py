"""Moving-block resampling of day-level series as joins and aggregates.

A study reduces its panel to one row per (cell, day) first. From there:

* ``block_sums`` turns each possible block start into the sums of its ``block`` days
  (a forward row frame), so one draw costs one lookup per block, not ``block`` rows;
* ``starts`` makes the (cell, draw, block start) table, hashed from (seed, draw, block)
  so it needs no state and can be produced on any executor;
* the two meet in an equi-join. The day table is settled first, so the size of the block sums
  is known: they are broadcast below a limit and merge-joined above it. Draws are partitioned
  by (cell, draw) before they are expanded, so with a broadcast they are summed in place.

No draw ever reaches the driver. The resampled length is ``(n // block + 1) * block`` and
interval ends are order statistics at ``int(.025 m)`` and ``int(.975 m)``.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.session import settled, sided

DRAWS = 5000
BLOCK = 30


def block_sums(days: DataFrame, sums: Sequence[str], block: int) -> DataFrame:
    """Per cell and start position: sums over the next ``block`` days (whole blocks only)."""
    w = W.partitionBy("cell").orderBy("day")
    ahead = w.rowsBetween(0, block - 1)
    return (
        days.select(
            "cell",
            (F.row_number().over(w) - 1).alias("start"),
            F.count(F.lit(1)).over(ahead).alias("__len"),
            *(F.sum(c).over(ahead).alias(c) for c in sums),
        )
        .where(F.col("__len") == block)
        .drop("__len")
    )


def hashed_start(seed: int, draw, blk, n_starts):
    """Uniform start from the first 32 bits of md5(seed|draw|block)."""
    key = F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), blk.cast("string"))
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % n_starts).cast("int")


def starts(days: DataFrame, block: int, n_boot: int, seed: int, draws: str = "hash") -> DataFrame:
    """(cell, draw, start) for every draw and block of every cell with at least one block."""
    cells = days.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= block)
    if draws == "mt":
        return _twister_starts(cells, block, n_boot, seed)
    tasks = int(days.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        cells.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
        .repartition(tasks, "cell", "draw")
        .withColumn("blk", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / block).cast("int"))))
        .select(
            "cell",
            "draw",
            hashed_start(seed, F.col("draw"), F.col("blk"), F.col("n") - block + 1).alias("start"),
        )
    )


def _twister_starts(cells: DataFrame, block: int, n_boot: int, seed: int) -> DataFrame:
    """Starts from the Mersenne Twister in call order, for parity with published intervals."""

    def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, n in zip(batch["cell"], batch["n"], strict=True):
                rng, per_draw = random.Random(seed), int(n) // block + 1
                for lo in range(0, n_boot, 500):
                    picks = [
                        (cell, d, rng.randint(0, int(n) - block))
                        for d in range(lo, min(lo + 500, n_boot))
                        for _ in range(per_draw)
                    ]
                    yield pd.DataFrame(picks, columns=["cell", "draw", "start"])

    return cells.select("cell", "n").mapInPandas(generate, "cell string, draw int, start int")


def resample(
    days: DataFrame, rows: int, sums: Sequence[str], block: int, n_boot: int, seed: int, draws: str = "hash"
) -> DataFrame:
    """(cell, draw, summed columns, blocks): one row per draw. ``rows`` is the size of ``days``."""
    picked = starts(days, block, n_boot, seed, draws).join(
        sided(block_sums(days, sums, block), rows), ["cell", "start"]
    )
    return picked.groupBy("cell", "draw").agg(
        F.count(F.lit(1)).alias("blocks"), *(F.sum(c).alias(c) for c in sums)
    )


def _interval(draws: DataFrame, stat, n_boot: int) -> DataFrame:
    """Order-statistic bounds and the two-sided p-value per cell (``n_boot`` values at most)."""
    kept = draws.withColumn("d", stat).where(F.col("d").isNotNull())
    packed = kept.groupBy("cell").agg(
        F.array_sort(F.collect_list("d")).alias("s"),
        F.count(F.lit(1)).alias("m"),
        F.count_if(F.col("d") <= 0).alias("below"),
    )

    def at(q: float):
        return F.element_at("s", F.floor(F.lit(q) * F.col("m")).cast("int") + 1)

    tail = F.least(F.col("below"), F.col("m") - F.col("below")) / F.col("m")
    return packed.select(
        "cell",
        at(0.025).alias("low"),
        at(0.975).alias("high"),
        F.greatest(2.0 * tail, F.lit(1.0 / n_boot)).alias("p_value"),
    )


def two_group_ci(
    days: DataFrame, block: int = BLOCK, n_boot: int = DRAWS, seed: int = 7, draws: str = "hash"
) -> DataFrame:
    """mean(a) - mean(b) over ``(cell, day, a_sum, a_n, b_sum, b_n)``, observation weighted."""
    sums = ["a_sum", "a_n", "b_sum", "b_n"]
    days, rows = settled(days)
    point = days.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_days"), *(F.sum(c).alias(c) for c in sums)
    )
    point = point.select(
        "cell",
        "n_days",
        F.col("a_n").alias("n_a"),
        F.col("b_n").alias("n_b"),
        (
            F.col("a_sum") / F.greatest("a_n", F.lit(1)) - F.col("b_sum") / F.greatest("b_n", F.lit(1))
        ).alias("point"),
    )
    drawn = resample(days, rows, sums, block, n_boot, seed, draws)
    diff = F.when(
        (F.col("a_n") > 0) & (F.col("b_n") > 0),
        F.try_divide("a_sum", "a_n") - F.try_divide("b_sum", "b_n"),
    )
    return point.join(_interval(drawn, diff, n_boot), "cell", "left")


def event_mean_ci(
    days: DataFrame, block: int = BLOCK, n_boot: int = DRAWS, seed: int = 7, draws: str = "hash"
) -> DataFrame:
    """Mean of pooled events over ``(cell, day, v_sum, v_n)``: busy days weigh more."""
    days, rows = settled(days)
    point = days.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.sum("v_n").alias("n"),
        (F.sum("v_sum") / F.greatest(F.sum("v_n"), F.lit(1))).alias("point"),
    )
    drawn = resample(days, rows, ["v_sum", "v_n"], block, n_boot, seed, draws)
    mean = F.when(F.col("v_n") > 0, F.try_divide("v_sum", "v_n"))
    return point.join(_interval(drawn, mean, n_boot), "cell", "left")


def daily_mean_ci(
    days: DataFrame, block: int = BLOCK, n_boot: int = DRAWS, seed: int = 7, draws: str = "hash"
) -> DataFrame:
    """Unweighted mean of one value per day over ``(cell, day, v)``."""
    days, rows = settled(days)
    point = days.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("point"))
    drawn = resample(days, rows, ["v"], block, n_boot, seed, draws)
    return point.join(_interval(drawn, F.col("v") / (F.col("blocks") * block), n_boot), "cell", "left")


def flag_split_ci(
    obs: DataFrame, block: int = 60, n_boot: int = DRAWS, seed: int = 7, draws: str = "hash"
) -> DataFrame:
    """mean(v | flag) - mean(v | not flag) over ``(cell, day, v, flag)``, re-split per draw.

    Summing flagged and unflagged values per block gives the same estimate as re-partitioning
    the raw observations, so it is the two-group form on one-row days.
    """
    flag = F.col("flag")
    split = obs.select(
        "cell",
        "day",
        F.when(flag, F.col("v")).otherwise(0.0).alias("a_sum"),
        flag.cast("int").alias("a_n"),
        F.when(flag, 0.0).otherwise(F.col("v")).alias("b_sum"),
        (~flag).cast("int").alias("b_n"),
    )
    return two_group_ci(split, block, n_boot, seed, draws)
