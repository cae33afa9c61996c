"""Samples for learned models: causal channels, barrier labels, fixed-length windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.features import lag, lead
from tickloom.functions.windows import by_symbol, full

CHANNELS = ("ret_scaled", "range_scaled", "body", "close_loc", "gap_scaled", "volume_z")
EPS = 1e-12  # fixed value: keeps the scalings finite


def channels(bars: DataFrame, vol_span: int = 20, volume_span: int = 60) -> DataFrame:
    """Add six channels scaled by statistics of strictly earlier bars, null until defined."""
    df = bars.withColumns({"__lr": F.log(F.try_divide(F.col("close"), lag("close"))), "__lv": F.log(F.col("volume") + 1)})
    df = df.withColumns(
        {
            "sigma": full(F.stddev_samp, "__lr", vol_span, end=-1),
            "__vm": full(F.avg, "__lv", volume_span, end=-1),
            "__vs": full(F.stddev_samp, "__lv", volume_span, end=-1),
            "__pc": lag("close"),
            "__rn": F.row_number().over(by_symbol()),
        }
    )
    s, span = F.col("sigma") + EPS, F.col("high") - F.col("low")
    return df.withColumns(
        {
            "ret_scaled": F.col("__lr") / s,
            "range_scaled": span / (F.col("__pc") + EPS) / s,
            "body": (F.col("close") - F.col("open")) / (span + EPS),
            "close_loc": 2 * (F.col("close") - F.col("low")) / (span + EPS) - 1,
            "gap_scaled": F.log(F.try_divide("open", "__pc")) / s,
            "volume_z": F.when(F.col("__rn") > volume_span + 1, (F.col("__lv") - F.col("__vm")) / (F.col("__vs") + EPS)),
        }
    ).drop("__lr", "__lv", "__vm", "__vs", "__pc", "__rn")


def labelled(df: DataFrame, horizon: int = 5, k: float = 1.0) -> DataFrame:
    """Add ``label``: 1/-1 for the upper/lower barrier touched first in the next ``horizon`` bars.

    Both touched in one bar, none touched, no width or too few bars ahead: 0. The first touch
    is the first non-null of ``horizon`` shifted comparisons, which stays in generated code.
    """
    up, down = F.col("close") * F.exp(k * F.col("sigma")), F.col("close") * F.exp(-k * F.col("sigma"))
    df = df.withColumns({"__up": up, "__dn": down})
    touches = []
    for i in range(1, horizon + 1):
        hi, lo = lead("high", i) >= F.col("__up"), lead("low", i) <= F.col("__dn")
        touches.append(F.when(hi & lo, 0).when(hi, 1).when(lo, -1))
    usable = F.col("sigma").isNotNull() & lead("close", horizon).isNotNull()
    return df.withColumn("label", F.when(usable, F.coalesce(*touches, F.lit(0))).otherwise(0)).drop("__up", "__dn")


def windows(df: DataFrame, window: int = 30, horizon: int = 5) -> DataFrame:
    """Keep origins with a full finite block of ``window`` rows and ``horizon`` bars ahead.

    Adds ``block``: the rows of channels as an array of structs, oldest first.
    """
    frame = by_symbol().rowsBetween(-(window - 1), 0)
    finite = F.lit(True)
    for c in CHANNELS:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c)
    row = F.when(finite, F.struct(*CHANNELS))
    return df.withColumns(
        {"block": F.collect_list(row).over(frame), "__ahead": lead("close", horizon)}
    ).where((F.size("block") == window) & F.col("__ahead").isNotNull()).drop("__ahead")
