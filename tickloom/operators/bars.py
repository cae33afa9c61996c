"""Bars: resampling, chained indices, daily collapses, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.windows import by_symbol

# The closed set of bar intervals and their length in milliseconds.
INTERVAL_MS = {
    "1m": 60_000,
    "5m": 300_000,
    "15m": 900_000,
    "1h": 3_600_000,
    "4h": 14_400_000,
    "6h": 21_600_000,
    "12h": 43_200_000,
    "1d": 86_400_000,
}


def floor_to(ts: Column | str, interval: str) -> Column:
    """Floor a time to the epoch-aligned grid of ``interval``."""
    step = INTERVAL_MS[interval]
    ms = F.unix_millis(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))
    return F.timestamp_millis(ms - F.pmod(ms, F.lit(step)))


def resample(bars: DataFrame, source: str, target: str, keep_partial: bool = False) -> DataFrame:
    """Coarser bars on the epoch grid; buckets that are not complete are dropped.

    ``target`` must be a whole multiple of ``source``. The aggregate combines map-side, and
    first/last come from ``min_by``/``max_by`` on the stamp, so no sort is needed.
    """
    a, b = INTERVAL_MS[source], INTERVAL_MS[target]
    if b <= a or b % a:
        raise ValueError(f"{target} is not a coarser multiple of {source}")
    out = (
        bars.groupBy("symbol", floor_to("ts", target).alias("bucket"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumnRenamed("bucket", "ts")
    )
    return (out if keep_partial else out.where(F.col("n") == b // a)).drop("n")


def calendar(bars: DataFrame) -> DataFrame:
    """(day, ord, days): union timeline of all symbols with positions and length; one row per day."""
    distinct = bars.select("day").distinct()
    return distinct.withColumns(
        {"ord": F.row_number().over(W.orderBy("day")), "days": F.count(F.lit(1)).over(W.partitionBy())}
    )


def with_ordinal(bars: DataFrame) -> DataFrame:
    """Add ``ord``: the position of the day on the union timeline of all symbols."""
    return bars.join(calendar(bars).drop("days"), "day")


def union_lag(df: DataFrame, value: str, n: int = 1) -> Column:
    """Value ``n`` union-timeline rows back, null when the symbol has no bar exactly there.

    Scans the last ``n`` own rows, since a symbol has at most one bar per timeline row.
    """
    w = by_symbol("ord").rangeBetween(-n, -n)
    return F.first(value).over(w)


def chained_index(bars: DataFrame, base: float = 100.0) -> DataFrame:
    """(day, n, ret, level): equal-weight index over the symbols that have a return that day.

    A return needs a bar on the previous row of the union timeline, so a missing bar leaves
    both neighbouring returns out instead of bridging the hole. No grid is materialised.
    """
    placed = with_ordinal(bars.select("symbol", "day", "close"))
    ret = F.try_divide(F.col("close"), union_lag(placed, "close")) - 1
    daily = (
        placed.select("day", ret.alias("ret")).groupBy("day").agg(F.avg("ret").alias("ret"), F.count("ret").alias("n"))
    )
    run = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)  # one row per day
    return daily.withColumn("level", base * F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(run)))


def dominance(bars: DataFrame, index: DataFrame, symbol: str) -> DataFrame:
    """(day, dominance): the symbol's close over the index level."""
    one = bars.where(F.col("symbol") == symbol).select("day", "close")
    return one.join(index.select("day", "level"), "day").select(
        "day", F.try_divide("close", "level").alias("dominance")
    )


def basket_return(panel: DataFrame, reference: str) -> DataFrame:
    """(day, basket): mean return of every symbol but the reference."""
    return panel.where(F.col("symbol") != reference).groupBy("day").agg(F.avg("ret").alias("basket"))


def end_of_day(stream: DataFrame, value: str, ts: str = "ts") -> DataFrame:
    """(symbol, day, value, ret): last value of each day and its change on the day before."""
    daily = stream.groupBy("symbol", F.to_date(ts).alias("day")).agg(F.max_by(value, ts).alias(value))
    return daily.withColumn("ret", F.try_divide(F.col(value), F.lag(value).over(by_symbol())) - 1)


def wide(long: DataFrame, value: str, symbols: list[str]) -> DataFrame:
    """One row per day, one column per listed symbol."""
    return long.groupBy("day").pivot("symbol", symbols).agg(F.first(value))


def funding_by_day(funding: DataFrame) -> DataFrame:
    return funding.groupBy("symbol", "day").agg(F.sum("rate").alias("funding"), F.count(F.lit(1)).alias("stamps"))


def calendar_flags(df: DataFrame, day: str = "day") -> DataFrame:
    """Add turn-of-month (first two, last two days) and weekend flags."""
    d = F.col(day)
    dom = F.dayofmonth(d)
    return df.withColumns(
        {
            "turn_of_month": (dom <= 2) | (dom >= F.dayofmonth(F.last_day(d)) - 1),
            "weekend": F.weekday(d) >= 5,
        }
    )


def intraday(bars: DataFrame) -> DataFrame:
    """Add the date, hour, minute and eight-hour session of an intraday stamp."""
    return bars.withColumns(
        {
            "day": F.to_date("ts"),
            "hh": F.hour("ts"),
            "mm": F.minute("ts"),
            "session": F.floor(F.hour("ts") / 8).cast("int"),
        }
    )
