"""Performance of equity and return tables, per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.normal import max_sharpe_factor, probabilistic_sharpe


def screen(df: DataFrame, target: str, cost: float = 0.0, key: str = "symbol", order: str = "day") -> Column:
    """Vectorised pre-screen: yesterday's position earns today's return, changes cost."""
    w = W.partitionBy(key).orderBy(order)
    held = F.coalesce(F.lag(target).over(w), F.lit(0.0))
    before = F.coalesce(F.lag(target, 2).over(w), F.lit(0.0))
    return held * F.col("ret") - cost * F.abs(held - before)


def performance(equity: DataFrame, keys: list[str], order: str = "day", per_year: float = 365.0) -> DataFrame:
    """Total return, CAGR, annualised Sharpe, maximum drawdown and time in market."""
    w = W.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    rows = equity.withColumns(
        {
            "__r": F.try_divide("equity", F.lag("equity").over(w)) - 1,
            "__dd": F.try_divide("equity", F.max("equity").over(run)) - 1,
        }
    )
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.min_by("equity", order).alias("__first"),
        F.max_by("equity", order).alias("__last"),
        F.avg("__r").alias("__mean"),
        F.stddev_samp("__r").alias("__sd"),
        F.min("__dd").alias("max_drawdown"),
        F.avg((F.abs("exposure") > 1e-9).cast("double")).alias("time_in_market"),
    )
    growth = F.try_divide("__last", "__first")
    years = (F.col("n_bars") - 1) / per_year
    return g.select(
        *keys,
        "n_bars",
        (growth - 1).alias("total_return"),
        F.when((years > 0) & (growth > 0), F.pow(growth, 1 / F.when(years > 0, years)) - 1).otherwise(-1.0).alias("cagr"),
        F.when(F.col("__sd") > 0, F.col("__mean") / F.col("__sd") * F.sqrt(F.lit(per_year))).otherwise(0.0).alias("sharpe"),
        "max_drawdown",
        "time_in_market",
    )


def return_moments(returns: DataFrame, keys: list[str], value: str = "ret") -> DataFrame:
    """n, mean, deviation, per-period Sharpe, population skew, kurtosis with 3 for the normal."""
    g = returns.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.skewness(value).alias("skew"),
        (F.kurtosis(value) + 3).alias("kurt"),
        F.var_samp(value).alias("var"),
    )
    return g.withColumn("sharpe", F.try_divide("mean", "sd"))


def deflated(moments: DataFrame, n_trials: int, variance: Column | str = "var") -> DataFrame:
    """Add ``psr`` (against zero) and ``dsr`` (against the best of ``n_trials`` unskilled trials).

    Called again with another count it re-deflates the same moments.
    """
    v = F.col(variance) if isinstance(variance, str) else variance
    hurdle = F.sqrt(v) * max_sharpe_factor(n_trials)
    s, n, k, z = F.col("sharpe"), F.col("n"), F.col("skew"), F.col("kurt")
    return moments.withColumns(
        {
            "hurdle": hurdle,
            "psr": probabilistic_sharpe(s, n, k, z, F.lit(0.0)),
            "dsr": probabilistic_sharpe(s, n, k, z, hurdle),
        }
    )


#: Units of a position that count as flat, against sums that do not cancel to the last bit.
FLAT = 1e-9


def round_trips(fills: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entry_at, exit_at, pnl): completed trips from flat to flat, or to the other side.

    Under average cost, gains realised between two flat positions add up to the cash that flowed:
    every fill pays ``-qty * price - fee``. So a trip is a run of fills between two zeros of the
    running position and its result is one sum; a fill that turns the position over pays for the
    part that closes, with the whole fee, and opens the next trip with the rest at its own price.
    Windows and one aggregate by key and trip. A position still open at the end is not reported.
    """
    fills = fills.where("qty != 0")
    w = W.partitionBy(*keys).orderBy("at", "qty", "price", "fee")
    total = F.sum("qty").over(w.rowsBetween(W.unboundedPreceding, 0))
    pos = F.when(F.abs(total) > FLAT, total).otherwise(0.0)
    rows = fills.withColumn("__pos", pos).withColumn("__was", F.coalesce(F.lag("__pos").over(w), F.lit(0.0)))
    turned = F.col("__was") * F.col("__pos") < 0
    closes = (F.col("__was") != 0) & (F.col("__pos") == 0) | turned
    # The number of trips closed before a fill names the trip it belongs to.
    rows = rows.withColumn("__closed", F.sum(closes.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("__trip", F.col("__closed") - closes.cast("int"))
    part = F.when(turned, -F.col("__was")).otherwise(F.col("qty"))
    own = F.struct(F.col("__trip").alias("trip"), (-part * F.col("price") - F.col("fee")).alias("cash"), closes.alias("done"))
    rest = F.struct((F.col("__trip") + 1).alias("trip"), (-F.col("__pos") * F.col("price")).alias("cash"), F.lit(False).alias("done"))
    parted = rows.select(*keys, "at", F.inline(F.when(turned, F.array(own, rest)).otherwise(F.array(own))))
    trips = parted.groupBy(*keys, "trip").agg(F.min("at").alias("entry_at"), F.max("at").alias("exit_at"), F.sum("cash").alias("pnl"), F.max("done").alias("done"))
    return trips.where("done").select(*keys, "entry_at", "exit_at", "pnl")


def trip_summary(trips: DataFrame, keys: list[str]) -> DataFrame:
    """Trips, win rate and profit factor per key (null without losses)."""
    gain, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.sum(F.when(F.col("pnl") <= 0, F.col("pnl")))
    return trips.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trips"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.when(loss < 0, F.coalesce(gain, F.lit(0.0)) / F.abs(loss)).alias("profit_factor"),
    )
