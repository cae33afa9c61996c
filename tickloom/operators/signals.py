"""Trading signals as columns: each function adds target exposures decided at a bar's close.

State such as breakout hysteresis or a stop latch is the last of two kinds of event, which is
exact because the two cannot happen on one coherent bar; no signal loops over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tickloom.functions import features as X
from tickloom.functions.windows import by_symbol, full
from tickloom.operators.asof import carry_forward
from tickloom.session import shared

# Stop windows and multiple, blend horizons, exposure step, days per year.
HIGH_WINDOW, ATR_WINDOW, ATR_MULT = 30, 14, 2.0
BLEND = (30, 90, 180)
STEP = 20.0
YEAR = 365


def _bars(w: WindowSpec | None = None) -> Column:
    return F.row_number().over(w or by_symbol())


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def ret() -> Column:
    return X.ret().expr


def sma_cross(fast: int, slow: int) -> Column:
    return _flag(full(F.avg, "close", fast) > full(F.avg, "close", slow))


def ts_momentum(lookback: int) -> Column:
    return _flag(F.col("close") > X.lag("close", lookback))


def vol_scale(target: float, window: int) -> Column:
    """min(1, target / annualised trailing deviation); 1 when the deviation is zero."""
    realized = full(F.stddev_samp, "ret", window) * F.sqrt(F.lit(float(YEAR)))
    return F.when(realized <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(F.lit(target), realized)))


def stepped(x: Column) -> Column:
    """Round to 0.05 steps, halves to even."""
    return F.bround(x * STEP) / STEP


def vol_filtered(lookback: int, short: int = 30, long: int = 90) -> Column:
    up = F.col("close") > X.lag("close", lookback)
    calm = full(F.stddev_samp, "ret", short) < full(F.stddev_samp, "ret", long)
    return F.when(_bars() > max(lookback, long), _flag(up & calm)).otherwise(0.0)


def vol_target(lookback: int, target: float = 0.30, window: int = 30) -> Column:
    up = _flag(F.col("close") > X.lag("close", lookback))
    ready = _bars() > max(lookback, window)
    return F.when(ready & (up > 0), stepped(vol_scale(target, window))).otherwise(0.0)


def blend(target: float = 0.30, window: int = 30, horizons: tuple[int, ...] = BLEND) -> Column:
    score = sum((_flag(F.col("close") > X.lag("close", h)) for h in horizons), F.lit(0.0))
    ready = _bars() > max(*horizons, window)
    return F.when(ready & (score > 0), stepped(score / len(horizons) * vol_scale(target, window))).otherwise(0.0)


def _latch(on: Column, off: Column, w: WindowSpec | None = None) -> Column:
    """1 from an ``on`` event until an ``off`` event."""
    event = F.when(on, 1.0).when(off, 0.0)
    run = (w or by_symbol()).rowsBetween(W.unboundedPreceding, 0)
    return F.coalesce(F.last(event, ignorenulls=True).over(run), F.lit(0.0))


def with_breakout(df: DataFrame, channel: int, name: str = "breakout") -> DataFrame:
    """Long above the prior ``channel``-bar high, out at or below the prior half-channel low."""
    w = by_symbol()
    out = max(2, channel // 2)
    staged = df.withColumns(
        {
            "__up": F.max("high").over(w.rowsBetween(-channel, -1)),
            "__dn": F.min("low").over(w.rowsBetween(-out, -1)),
            "__ready": _bars() > channel,
        }
    )
    on = F.col("__ready") & (F.col("close") > F.col("__up"))
    off = F.col("__ready") & (F.col("close") <= F.col("__dn"))
    return staged.withColumn(name, _latch(on, off)).drop("__up", "__dn", "__ready")


def bollinger(k: float, window: int) -> Column:
    band = full(F.avg, "close", window) - k * full(F.stddev_samp, "close", window)
    return _flag(F.col("close") < band)


def with_stop(df: DataFrame, name: str = "stopped") -> DataFrame:
    """Chandelier latch: fires at or below high - 2 ATR, clears on a new closing high."""
    staged = df.withColumn("__tr", X.true_range().expr).withColumns(
        {"__hi": full(F.max, "close", HIGH_WINDOW), "__atr": full(F.avg, "__tr", ATR_WINDOW), "__ready": _bars() >= HIGH_WINDOW}
    )
    fire = F.col("__ready") & (F.col("close") <= F.col("__hi") - ATR_MULT * F.col("__atr"))
    clear = F.col("__ready") & (F.col("close") >= F.col("__hi"))
    return staged.withColumn(name, _latch(fire, clear) > 0).drop("__tr", "__hi", "__atr", "__ready")


def single_name_signals(bars: DataFrame) -> DataFrame:
    """Every single-name signal side by side; one shuffle by symbol feeds all the windows."""
    df = bars.select("symbol", "day", "open", "high", "low", "close", "volume", ret().alias("ret"))
    df = df.withColumns(
        {
            "buy_hold": F.lit(1.0),
            "flat": F.lit(0.0),
            "sma_cross": sma_cross(20, 50),
            "ts_momentum": ts_momentum(30),
            "vol_filtered": vol_filtered(30),
            "vol_target": vol_target(30),
            "blend": blend(),
            "bollinger": bollinger(1.5, 20),
        }
    )
    df = with_stop(with_breakout(df, 20), "stopped")
    return df.withColumn("stop_vol_target", F.when(F.col("stopped"), 0.0).otherwise(F.col("vol_target")))


# --- books over several names: (day, symbol, weight) -----------------------------------------------


def _as_of_scores(bars: DataFrame, lookback: int, extra: dict[str, Column]) -> DataFrame:
    """Scores of every symbol listed so far on each timeline day, stale names as last seen."""
    scored = bars.select(
        "symbol", "day", (F.try_divide(F.col("close"), X.lag("close", lookback)) - 1).alias("score"),
        *(c.alias(n) for n, c in extra.items()),
    )
    return carry_forward(scored).drop("day").withColumnRenamed("as_of", "day")


def _top(scores: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("day").orderBy(F.col("score").desc(), "symbol")
    ranked = scores.where("score is not null").withColumn("rank", F.row_number().over(w))
    return ranked.where((F.col("rank") <= k) & (F.col("score") > 0))


def rotation(bars: DataFrame, lookback: int, k: int = 2) -> DataFrame:
    """Top ``k`` by trailing return, positive only, each at 1/k; the rest is cash."""
    return _top(_as_of_scores(bars, lookback, {}), k).select("day", "symbol", F.lit(1.0 / k).alias("weight"))


def vol_target_rotation(
    bars: DataFrame, lookback: int, k: int = 2, target: float = 0.30, window: int = 30, stops: bool = False
) -> DataFrame:
    """Rotation scaled to a volatility target of the selected basket.

    The basket's deviation is taken over the mean, lag by lag, of the selected names' own last
    ``window`` returns. A day with any selected name short of history stays in cash. With
    ``stops``, stopped names leave before ranking.
    """
    df = bars.select("symbol", "day", "open", "high", "low", "close", ret().alias("ret"))
    if stops:
        df = with_stop(df)
    recent = by_symbol().rowsBetween(-(window - 1), 0)
    extra = {"recent": F.collect_list("ret").over(recent)}
    if stops:
        extra["stopped"] = F.col("stopped")
    scores = _as_of_scores(df, lookback, extra)
    picked = shared(_top(scores.where("not stopped") if stops else scores, k))  # k rows per day
    short = picked.groupBy("day").agg(F.min(F.size("recent")).alias("least"))
    lags = picked.select("day", F.posexplode("recent").alias("lag", "r"))
    basket = lags.groupBy("day", "lag").agg(F.avg("r").alias("r")).groupBy("day").agg(F.stddev_samp("r").alias("sd"))
    sized = short.where(F.col("least") >= window).join(basket, "day")
    realized = F.col("sd") * F.sqrt(F.lit(float(YEAR)))
    scale = F.when(realized <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(F.lit(target), realized)))
    return picked.select("day", "symbol").join(sized.select("day", scale.alias("scale")), "day").select(
        "day", "symbol", (F.col("scale") / k).alias("weight")
    )


def crash_bounce(bars: DataFrame, leader: str, threshold: float = -0.03) -> DataFrame:
    """Equal weight in every other listed name at the close of a leader crash day."""
    r = bars.select("symbol", "day", ret().alias("ret"))
    crash = r.where((F.col("symbol") == leader) & (F.col("ret") < threshold)).select("day")
    listed = carry_forward(r.select("symbol", "day")).select("symbol", F.col("as_of").alias("day"))
    live = listed.where(F.col("symbol") != leader).join(crash, "day", "left_semi")
    return live.withColumn("weight", 1.0 / F.count(F.lit(1)).over(W.partitionBy("day")))


def tranche_ladder(qualifiers: DataFrame, tradable: DataFrame, hold: int) -> DataFrame:
    """Weights of ``hold`` overlapping tranches from ``(day, symbol)`` qualifiers.

    Each entry day's names get (1/hold)/n for ``hold`` days; ``n`` is fixed on the entry day,
    so a name that cannot trade leaves its slot in cash.
    """
    n = F.count(F.lit(1)).over(W.partitionBy("day"))
    legs = qualifiers.withColumn("w", F.lit(1.0 / hold) / n).select(
        "symbol", "w", F.explode(F.sequence(F.col("day"), F.date_add("day", hold - 1))).alias("day")
    )
    live = legs.join(tradable.select("day", "symbol"), ["day", "symbol"], "left_semi")
    return live.groupBy("day", "symbol").agg(F.sum("w").alias("weight"))


def equal_weight_live(bars: DataFrame) -> DataFrame:
    """1/n in every name with a bar that day."""
    return bars.select("day", "symbol", (1.0 / F.count(F.lit(1)).over(W.partitionBy("day"))).alias("weight"))


def combine(books: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted sum of weight tables."""
    out = None
    for df, share in books:
        part = df.select("day", "symbol", (F.col("weight") * share).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("day", "symbol").agg(F.sum("weight").alias("weight"))


def overlay_idle(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Base weights plus the overlay scaled to the cash the base leaves idle that day."""
    used = base.groupBy("day").agg(F.sum("weight").alias("used"))
    idle = F.greatest(F.lit(0.0), 1.0 - F.coalesce("used", F.lit(0.0)))
    extra = overlay.join(used, "day", "left").select("day", "symbol", (F.col("weight") * idle).alias("weight"))
    return combine([(base, 1.0), (extra, 1.0)])


def fade_exposure(bars: DataFrame, last_hour: int = 23) -> DataFrame:
    """Intraday fade exposures: against the opening-range break and against the first hour.

    ``bars`` carries ``symbol, day, ts, hh`` and the session facts of the opening. Both are
    flat from the day's last scheduled bar.
    """
    w = W.partitionBy("symbol", "day").orderBy("ts")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    c = F.col("close")
    inside = F.col("ok_open") & F.col("hh").between(1, 5)
    brk = F.when(inside & (c > F.col("open_high")), -1.0).when(inside & (c < F.col("open_low")), 1.0)
    # Only the first break of a day counts, and each day starts where the previous one ended flat.
    first = F.first(brk, ignorenulls=True).over(run)
    hour = F.when(F.col("ok_open"), -F.signum(F.col("open_last") - F.col("open_first")))
    shut = F.col("hh") >= last_hour
    return bars.select(
        "symbol", "ts", "day", "hh",
        F.when(shut, 0.0).otherwise(F.coalesce(first, F.lit(0.0))).alias("fade_range"),
        F.when(shut, 0.0).otherwise(F.coalesce(hour, F.lit(0.0))).alias("fade_hour"),
    )


# --- risk caps on a target stream with a given equity ---------------------------------------------


def risk_caps(
    stream: DataFrame, key: str, max_exposure: float | None = None, soft: float | None = None,
    hard: float | None = None, daily_loss: float | None = None,
) -> DataFrame:
    """Add ``allowed``: ``target`` after an exposure cap, a drawdown guard and a daily halt.

    The guard shrinks linearly between ``soft`` and ``hard`` drawdown and latches at ``hard``
    for good; the halt lasts until the next day. All three read the given equity only.
    """
    w = W.partitionBy(key).orderBy("ts")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    d = W.partitionBy(key, "day").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    t = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("target")))
    if max_exposure is not None:
        t = F.greatest(F.lit(-max_exposure), F.least(F.lit(max_exposure), t))
    out = stream.withColumn("allowed", t)
    if hard is not None:
        out = out.withColumn("__dd", 1 - F.try_divide(F.col("equity"), F.max("equity").over(run)))
        out = out.withColumn("__dead", F.max((F.col("__dd") >= hard - 1e-12).cast("int")).over(run) > 0)
        scale = F.when(F.col("__dd") <= soft, 1.0).otherwise((hard - F.col("__dd")) / (hard - soft))
        out = out.withColumn("allowed", F.when(F.col("__dead"), 0.0).otherwise(F.col("allowed") * scale)).drop("__dd", "__dead")
    if daily_loss is not None:
        start = F.first("equity").over(d)
        out = out.withColumn("__cut", (F.col("equity") <= start * (1 - daily_loss)).cast("int"))
        out = out.withColumn("allowed", F.when(F.max("__cut").over(d) > 0, 0.0).otherwise(F.col("allowed"))).drop("__cut")
    return out


# The two published risk presets.
PRESETS = {
    "preserve": {"max_exposure": 0.5, "soft": 0.05, "hard": 0.10, "daily_loss": 0.02},
    "explore": {"max_exposure": 1.0, "soft": 0.25, "hard": 0.40},
}
