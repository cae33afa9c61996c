"""Cointegrated pairs: formation by aggregates over all pairs, then a book of equal shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Asymptotic critical values of the residual test (constant, two variables).
CRITICAL = {0.01: -3.90, 0.05: -3.34, 0.10: -3.04}
MIN_OBS = 60


def log_pairs(prices: DataFrame, group: list[str]) -> DataFrame:
    """(group, sa, sb, day, la, lb): log closes of unordered pairs that share a day.

    Pairs meet through an equi-join on group and day. Their number is quadratic in the symbols
    by definition of the question, but each pair-day row exists once and is reduced map-side.
    """
    a = prices.select(*group, "day", F.col("symbol").alias("sa"), F.log("close").alias("la"))
    b = prices.select(*group, "day", F.col("symbol").alias("sb"), F.log("close").alias("lb"))
    return a.join(b, [*group, "day"]).where("sa < sb")


def engle_granger(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Hedge ratio, intercept, ADF(1) t-statistic and spread deviation per pair and group.

    Everything is sums: the regression from one aggregate, then the spread's lags from a
    window and the 3x3 normal equations from a second aggregate, solved in closed form. Null
    statistics mean "cannot say": too short or degenerate.
    """
    keys = [*group, "sa", "sb"]
    fit = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.regr_slope("la", "lb").alias("hedge"),
        F.regr_intercept("la", "lb").alias("intercept"),
    ).where((F.col("n_obs") >= MIN_OBS) & F.col("hedge").isNotNull())
    w = W.partitionBy(*keys).orderBy("day")
    s = pairs.join(fit, keys).withColumn("s", F.col("la") - F.col("hedge") * F.col("lb") - F.col("intercept"))
    s = s.withColumns({"s1": F.lag("s", 1).over(w), "s2": F.lag("s", 2).over(w)})
    full = F.col("s2").isNotNull()
    y, x1, x2 = (F.when(full, e) for e in (F.col("s") - F.col("s1"), F.col("s1"), F.col("s1") - F.col("s2")))
    agg = s.groupBy(*keys).agg(
        F.first("n_obs").alias("n_obs"), F.first("hedge").alias("hedge"), F.first("intercept").alias("intercept"),
        F.avg("s").alias("spread_mean"), F.stddev_samp("s").alias("spread_std"),
        F.count(y).cast("double").alias("m"), F.sum(y).alias("y"), F.sum(x1).alias("x1"), F.sum(x2).alias("x2"),
        F.sum(y * y).alias("yy"), F.sum(x1 * x1).alias("x11"), F.sum(x2 * x2).alias("x22"),
        F.sum(x1 * x2).alias("x12"), F.sum(x1 * y).alias("x1y"), F.sum(x2 * y).alias("x2y"),
    )
    return agg.withColumn("adf", _adf_t()).select(*keys, "n_obs", "hedge", "intercept", "adf", "spread_mean", "spread_std").where(
        F.col("spread_std") > 0
    )


def _adf_t() -> Column:
    """t-statistic of the lagged level, from centred second moments (constant partialled out)."""
    m = F.col("m")

    def centred(ab: str, a: str, b: str) -> Column:
        return F.col(ab) - F.col(a) * F.col(b) / m

    s11, s22, s12 = centred("x11", "x1", "x1"), centred("x22", "x2", "x2"), centred("x12", "x1", "x2")
    s1y, s2y, syy = centred("x1y", "x1", "y"), centred("x2y", "x2", "y"), centred("yy", "y", "y")
    det = s11 * s22 - s12 * s12
    b1 = F.try_divide(s1y * s22 - s2y * s12, det)
    b2 = F.try_divide(s2y * s11 - s1y * s12, det)
    sigma2 = (syy - b1 * s1y - b2 * s2y) / (m - 3)
    se = F.sqrt(F.when((sigma2 > 0) & (det > 0), sigma2 * s22 / det))
    return F.when(m >= 30, F.try_divide(b1, se))


def formed(stats: DataFrame, group: list[str], alpha: float = 0.05) -> DataFrame:
    """Admitted pairs, strongest evidence first (``priority`` 1 = most negative statistic)."""
    w = W.partitionBy(*group).orderBy("adf", "sa", "sb")
    return stats.where(F.col("adf") < CRITICAL[alpha]).withColumn("priority", F.row_number().over(w))


def complete_windows(prices: DataFrame, formation: int, trading: int) -> DataFrame:
    """Close rows placed in formation windows of the union timeline, gap-free symbols only.

    Adds ``regime`` (0, 1, ...): formation rows are timeline positions
    [regime * trading, regime * trading + formation).
    """
    from tickloom.operators.bars import with_ordinal

    placed = with_ordinal(prices.select("symbol", "day", "close")).withColumn("t", F.col("ord") - 1)
    lo = F.greatest(F.ceil((F.col("t") - formation + 1) / trading), F.lit(0)).cast("int")
    hi = F.floor(F.col("t") / trading).cast("int")
    rows = placed.select("symbol", "day", "close", "t", F.explode(F.sequence(lo, hi)).alias("regime"))
    n = F.count(F.lit(1)).over(W.partitionBy("regime", "symbol"))
    return rows.withColumn("__n", n).where(F.col("__n") == formation).drop("__n")


def pair_days(prices: DataFrame, admitted: DataFrame, formation: int, trading: int) -> DataFrame:
    """(regime, t, day, pair columns, z, ra, rb): each admitted pair over its trading days.

    ``ra``/``rb`` are null where either name lacks a bar that day or the timeline day before.
    """
    from tickloom.operators.bars import union_lag, with_ordinal

    placed = with_ordinal(prices.select("symbol", "day", "close")).withColumn("t", F.col("ord") - 1)
    placed = placed.withColumn("r", F.try_divide(F.col("close"), union_lag(placed, "close")) - 1)
    regime = F.floor((F.col("t") - formation) / trading).cast("int")
    live = placed.where(F.col("t") >= formation).withColumn("regime", regime)
    a = live.select("regime", "t", "day", F.col("symbol").alias("sa"), F.log("close").alias("la"), F.col("r").alias("ra"))
    b = live.select("regime", "t", F.col("symbol").alias("sb"), F.log("close").alias("lb"), F.col("r").alias("rb"))
    both = admitted.join(a, ["regime", "sa"]).join(b, ["regime", "t", "sb"])
    z = (F.col("la") - F.col("hedge") * F.col("lb") - F.col("intercept") - F.col("spread_mean")) / F.col("spread_std")
    return both.withColumn("z", z).select("regime", "t", "day", "sa", "sb", "priority", "z", "ra", "rb")


def pairs_book(days: DataFrame, grid: list[tuple[float, float]], z_stop: float = 4.0, cost_rate: float = 1.1e-3) -> DataFrame:
    """(book, day, ret, n_open) of pairs traded for their reversion, one book for every (z_in, z_out).

    A pair is entered against its spread at ``z_in`` and left at ``z_out`` or ``z_stop``: the
    newest of those marks within the regime is its position. It is held over the next day, pays
    both legs when it changes, and every admitted pair has the same share of the book. States
    are windows by pair, so pairs spread over the cluster; days are one aggregate.
    """
    books = F.inline(F.array(*(F.struct(F.lit(f"{i}/{o}").alias("book"), F.lit(i).alias("z_in"), F.lit(o).alias("z_out")) for i, o in grid)))
    far = F.abs("z")
    mark = F.when((far <= F.col("z_out")) | (far >= z_stop), 0).when(far >= F.col("z_in"), -F.signum("z"))
    w = W.partitionBy("book", "regime", "sa", "sb").orderBy("t")
    rows = days.select("*", books).withColumn("__pos", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0.0)))
    held, before = (F.coalesce(F.lag("__pos", n).over(w), F.lit(0.0)) for n in (1, 2))
    rows = rows.withColumns({"__held": held, "__turn": F.abs(held - before)})
    gain = F.col("__held") * F.coalesce(F.col("ra") - F.col("rb"), F.lit(0.0)) - 2 * cost_rate * F.col("__turn")
    return rows.groupBy("book", "day").agg((F.avg(gain) / 2).alias("ret"), F.count_if(F.col("__pos") != 0).alias("n_open"))
