"""Row-frame helpers with the null rules panels rely on.

A trailing statistic is null until its frame holds ``n`` non-null values, frames never
cross symbols, and a frame ending at 0 or -1 cannot see the future.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_symbol(order: str = "day") -> WindowSpec:
    return W.partitionBy("symbol").orderBy(order)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full(
    agg: Callable[[Column], Column], x: Column | str, n: int, w: WindowSpec | None = None, end: int = 0
) -> Column:
    """``agg`` of the ``n`` rows ending ``-end`` rows back, null unless all ``n`` are non-null."""
    x, w = col(x), w or by_symbol()
    frame = w.rowsBetween(end - n + 1, end)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def forward(agg: Callable[[Column], Column], x: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    """``agg`` of the next ``n`` rows (labels only), null unless all ``n`` are non-null."""
    x, w = col(x), w or by_symbol()
    frame = w.rowsBetween(1, n)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def trailing_percentile(
    x: Column | str, window: int, w: WindowSpec | None = None, skip_nulls: bool = False
) -> Column:
    """Share of the trailing ``window + 1`` rows at or below the current value.

    Null for the first ``window`` rows. With ``skip_nulls`` nulls leave the denominator and
    a null current value stays null; otherwise the denominator is always ``window + 1``.
    """
    x, w = col(x), w or by_symbol()
    frame = w.rowsBetween(-window, 0)
    values = F.collect_list(x).over(frame)
    hits = F.size(F.filter(values, lambda v: v <= x))
    size = F.size(values) if skip_nulls else F.lit(window + 1)
    return F.when((F.row_number().over(w) > window) & x.isNotNull(), hits / size)


def median_of(values: Column) -> Column:
    """Median of an array of non-null doubles (mean of the middle two when even)."""
    s = F.array_sort(values)
    n = F.size(values)
    lo = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
    hi = F.element_at(s, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (lo + hi) / 2)


def robust_z(
    df: DataFrame, value: str, window: int, w: WindowSpec | None = None, out: str = "z"
) -> DataFrame:
    """Add ``out``: distance from the trailing median in units of 1.4826 x trailing MAD.

    The median covers the ``window`` rows before the current one. A row's deviation is that of
    the previous value from this median, and the MAD is the median of the last ``window``
    deviations, so nothing of the current value enters its own baseline. Spark has no windowed
    median, so each frame is collected (bounded by ``window``) and its middle taken.
    """
    w = w or by_symbol()
    med, dev, mad = f"__{out}_m", f"__{out}_d", f"__{out}_mad"

    def rolling_median(x: str, frame: WindowSpec) -> Column:
        return F.when(F.count(x).over(frame) == window, median_of(F.collect_list(x).over(frame)))

    return (
        df.withColumn(med, rolling_median(value, w.rowsBetween(-window, -1)))
        .withColumn(dev, F.abs(F.lag(value).over(w) - F.col(med)))
        .withColumn(mad, rolling_median(dev, w.rowsBetween(-(window - 1), 0)))
        .withColumn(out, F.try_divide(F.col(value) - F.col(med), F.col(mad) * 1.4826))
        .drop(med, dev, mad)
    )


def islands(df: DataFrame, starts_new: Column, w: WindowSpec, out: str) -> DataFrame:
    """Number contiguous runs: ``out`` counts how often ``starts_new`` has been true so far."""
    flag = F.coalesce(starts_new.cast("int"), F.lit(0))
    return df.withColumn("__new", flag).withColumn(
        out, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))
    ).drop("__new")
