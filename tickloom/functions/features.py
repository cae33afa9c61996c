"""Per-symbol panel features as (name, Column) pairs, applied in stages.

A stage is one projection; a later stage may read columns an earlier one made. Features
lag by row within a symbol; nothing here looks past the current row except the
``forward_*`` outcome columns, which are labels.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tickloom.functions.windows import by_symbol, col, full


class Feature(NamedTuple):
    name: str
    expr: Column


def lag(x: Column | str, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(col(x), n).over(w or by_symbol())


def lead(x: Column | str, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lead(col(x), n).over(w or by_symbol())


def ret(price: str = "close", name: str = "ret", w: WindowSpec | None = None) -> Feature:
    return Feature(name, F.try_divide(F.col(price), lag(price, 1, w)) - 1)


def momentum(window: int, skip: int = 0, w: WindowSpec | None = None) -> Feature:
    """Return over ``window`` bars, optionally leaving out the latest ``skip``."""
    now = lag("close", skip, w) if skip else F.col("close")
    name = f"r{window}skip{skip}" if skip else f"r{window}"
    return Feature(name, F.try_divide(now, lag("close", window, w)) - 1)


def forward_return(h: int, price: str = "close", name: str | None = None, w: WindowSpec | None = None) -> Feature:
    return Feature(name or f"fwd{h}", F.try_divide(lead(price, h, w), F.col(price)) - 1)


def relative_forward_ratio(h: int, a: str, b: str, name: str, w: WindowSpec | None = None) -> Feature:
    """What holding ``a`` funded by ``b`` earns: (1 + r_a) / (1 + r_b) - 1."""
    up = F.try_divide(lead(a, h, w), F.col(a))
    down = F.try_divide(lead(b, h, w), F.col(b))
    return Feature(name, F.try_divide(up, down) - 1)


def relative_forward_difference(h: int, a: str, b: str, name: str, w: WindowSpec | None = None) -> Feature:
    """Difference of the two forward returns; not the ratio form."""
    up = F.try_divide(lead(a, h, w), F.col(a))
    down = F.try_divide(lead(b, h, w), F.col(b))
    return Feature(name, (up - 1) - (down - 1))


def vol_before(window: int, name: str, w: WindowSpec | None = None) -> Feature:
    """Sample deviation of the ``window`` returns before the current bar."""
    return Feature(name, full(F.stddev_samp, "ret", window, w, end=-1))


def vol_through(window: int, name: str, w: WindowSpec | None = None) -> Feature:
    """Sample deviation of the ``window`` returns up to and including the current bar."""
    return Feature(name, full(F.stddev_samp, "ret", window, w))


def rolling_mean(x: str, window: int, name: str, w: WindowSpec | None = None) -> Feature:
    return Feature(name, full(F.avg, x, window, w))


def rolling_max(x: str, window: int, name: str, w: WindowSpec | None = None) -> Feature:
    return Feature(name, full(F.max, x, window, w))


def true_range(w: WindowSpec | None = None) -> Feature:
    """Largest of the bar's range and its two gaps to the previous close (first bar: range)."""
    prev = lag("close", 1, w)
    return Feature(
        "tr",
        F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
        ),
    )


def illiquidity(window: int, name: str, w: WindowSpec | None = None) -> Feature:
    return Feature(name, full(F.avg, F.try_divide(F.abs("ret"), F.col("close") * F.col("volume")), window, w))


def volume_shock(window: int, name: str, w: WindowSpec | None = None) -> Feature:
    return Feature(name, F.try_divide(F.col("volume"), full(F.avg, "volume", window, w)))


def up_share(window: int, name: str, w: WindowSpec | None = None) -> Feature:
    return Feature(name, full(F.avg, (F.col("ret") > 0).cast("double"), window, w))


def ratio(a: str, b: str, name: str) -> Feature:
    return Feature(name, F.try_divide(F.col(a), F.col(b)))


def panel(
    bars: DataFrame,
    stages: Sequence[Sequence[Feature]],
    base: Sequence[str] = ("symbol", "day", "close"),
    drop_nulls: Sequence[str] | None = None,
    hook=None,
) -> DataFrame:
    """Long panel, one row per symbol-day: base columns, staged features, one null drop.

    ``"ret"`` in ``base`` is expanded to the one-bar return. ``hook`` (DataFrame to
    DataFrame) runs after the stages for work that needs a join. All stages share the
    symbol partitioning, so the bars are shuffled and sorted once.
    """
    unknown = [c for c in base if c != "ret" and c not in bars.columns]
    if unknown:
        raise ValueError(f"missing base columns: {unknown}")
    out = bars.select(*(ret().expr.alias("ret") if c == "ret" else F.col(c) for c in base))
    for stage in stages:
        out = out.withColumns({f.name: f.expr for f in stage})
    if hook is not None:
        out = hook(out)
    return out.dropna(subset=list(drop_nulls)) if drop_nulls else out


def with_market_beta(df: DataFrame, market: str, window: int = 90) -> DataFrame:
    """Join the market symbol's return by day, then trailing beta and residual momentum.

    Beta is the trailing covariance over the trailing variance, both from means of products.
    The market side holds one row per day; its size decides the join strategy.
    """
    mkt = df.where(F.col("symbol") == market).select("day", F.col("ret").alias("mkt_ret"))
    both = df.join(mkt, "day", "left")
    x, y = F.col("mkt_ret"), F.col("ret")
    beta = both.withColumns(
        {
            "cov": full(F.avg, x * y, window) - full(F.avg, y, window) * full(F.avg, x, window),
            "mvar": full(F.avg, x * x, window) - F.pow(full(F.avg, x, window), 2),
        }
    ).withColumn("beta", F.try_divide("cov", "mvar"))
    return beta.withColumn(
        f"resmom{window}", full(F.sum, F.col("ret") - F.col("beta") * F.col("mkt_ret"), window)
    ).drop("cov", "mvar")
