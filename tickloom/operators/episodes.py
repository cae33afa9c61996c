"""Leads, episodes and performance under conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.windows import islands, robust_z


def volatility_leads(panel: DataFrame, window: int = 90, threshold: float = 4.0) -> DataFrame:
    """Symbol-days whose absolute return is far outside its trailing norm."""
    z = robust_z(panel.select("symbol", "day", F.abs("ret").alias("observed")), "observed", window)
    return _leads(z.where(F.abs("z") > threshold), "volatility", F.col("symbol"))


def _leads(flagged: DataFrame, kind: str, scope: Column) -> DataFrame:
    return flagged.select(F.lit(kind).alias("kind"), "day", scope.alias("scope"), F.abs("z").alias("severity"), "observed")


def _daily(panel: DataFrame, stat: Column, least: int) -> DataFrame:
    rows = panel.dropna(subset=["ret"]).groupBy("day").agg(stat.alias("observed"), F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("n") >= least).withColumn("symbol", F.lit("cross-section"))


def dispersion_leads(panel: DataFrame, window: int = 90, threshold: float = 4.0, least: int = 5) -> DataFrame:
    z = robust_z(_daily(panel, F.stddev_samp("ret"), least), "observed", window)
    return _leads(z.where(F.abs("z") > threshold), "dispersion", F.col("symbol"))


def comovement_leads(panel: DataFrame, window: int = 90, threshold: float = 4.0, least: int = 5) -> DataFrame:
    share = F.abs(F.avg((F.col("ret") > 0).cast("double")) - 0.5) * 2
    z = robust_z(_daily(panel, share, least), "observed", window)
    return _leads(z.where(F.col("z") > threshold), "comovement", F.col("symbol"))


def scan(panel: DataFrame, window: int = 90, threshold: float = 4.0) -> DataFrame:
    """Every lead of the three detectors."""
    return (
        volatility_leads(panel, window, threshold)
        .unionByName(dispersion_leads(panel, window, threshold))
        .unionByName(comovement_leads(panel, window, threshold))
    )


def segments(df: DataFrame, max_gap_days: int, longer_than: int = 0, key: str = "symbol") -> DataFrame:
    """Add ``segment``: contiguous runs of days, a gap over ``max_gap_days`` starting a new one.

    Only segments longer than ``longer_than`` rows are kept, so lags and trailing windows taken
    inside a segment never bridge the gap.
    """
    w = W.partitionBy(key).orderBy("day")
    out = islands(df, F.datediff("day", F.lag("day").over(w)) > max_gap_days, w, "segment")
    n = F.count(F.lit(1)).over(W.partitionBy(key, "segment"))
    return out.withColumn("__n", n).where(F.col("__n") > longer_than).drop("__n")


def episodes(df: DataFrame, condition: Column, value: str, key: str = "symbol") -> DataFrame:
    """(key, start, end, days, mean): runs of consecutive rows where the condition holds.

    A null condition counts as off.
    """
    w = W.partitionBy(key).orderBy("day")
    on = df.withColumn("__on", F.coalesce(condition, F.lit(False)))
    run = islands(on, F.col("__on") & ~F.coalesce(F.lag("__on").over(w), F.lit(False)), w, "run")
    return run.where("__on").groupBy(key, "run").agg(
        F.min("day").alias("start"), F.max("day").alias("end"), F.count(F.lit(1)).alias("days"),
        (F.sum(F.coalesce(value, F.lit(0.0))) / F.count(F.lit(1))).alias("mean"),
    ).drop("run")


# Fixed value: conditions seen in fewer episodes than this are flagged.
FEW_EPISODES = 10


def condition_matrix(df: DataFrame, conditions: dict[str, Column], value: str, key: str = "symbol") -> DataFrame:
    """(key, condition, episodes, days, mean_on, mean_off, few): one job for all conditions."""
    w = W.partitionBy(key).orderBy("day")
    flags = df.withColumns({f"c_{n}": F.coalesce(c, F.lit(False)) for n, c in conditions.items()})
    starts = flags.withColumns(
        {f"s_{n}": (F.col(f"c_{n}") & ~F.coalesce(F.lag(f"c_{n}").over(w), F.lit(False))).cast("int") for n in conditions}
    )
    aggs = []
    for n in conditions:
        on = F.col(f"c_{n}")
        aggs += [
            F.sum(f"s_{n}").alias(f"e_{n}"), F.count_if(on).alias(f"d_{n}"),
            F.coalesce(F.avg(F.when(on, F.col(value))), F.lit(0.0)).alias(f"on_{n}"),
            F.coalesce(F.avg(F.when(~on, F.col(value))), F.lit(0.0)).alias(f"off_{n}"),
        ]
    rows = [
        F.struct(
            F.lit(n).alias("condition"), F.col(f"e_{n}").alias("episodes"), F.col(f"d_{n}").alias("days"),
            F.col(f"on_{n}").alias("mean_on"), F.col(f"off_{n}").alias("mean_off"), (F.col(f"e_{n}") < FEW_EPISODES).alias("few"),
        )
        for n in conditions
    ]
    return starts.groupBy(key).agg(*aggs).select(key, F.inline(F.array(*rows)))


def refuse_window(df: DataFrame, start: str, end: str, reference: str | None = None) -> DataFrame:
    """(first, last, refused): whether a frame overlaps a guarded window without a reference.

    A blank reference is none. An empty frame is not refused.
    """
    span = df.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    overlap = (F.col("first") <= F.lit(end).cast("date")) & (F.col("last") >= F.lit(start).cast("date"))
    return span.withColumn("refused", F.coalesce(overlap, F.lit(False)) & F.lit(not (reference or "").strip()))


def withheld(df: DataFrame, start: str, end: str, reference: str | None = None) -> DataFrame:
    """The frame itself, or none of its rows where :func:`refuse_window` refuses it.

    The verdict is one row, read as a scalar subquery; with a reference nothing is asked.
    """
    if (reference or "").strip():
        return df
    verdict = refuse_window(df, start, end, reference).select("refused")
    return df.where(~verdict.scalar())

