"""Decisions over many tests: step-up control, outcome tables, score cards, path tests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.normal import EULER_GAMMA, wilson
from tickloom.operators.bootstrap import hashed_start
from tickloom.session import settled, sided


def by_factor(m: Column) -> Column:
    """Sum of 1/i for i up to m: the step-up penalty under any dependence.

    One formula for every m: the series for large arguments, sixteen terms further on, where it
    is exact to double precision, less those sixteen terms.
    """
    x = m.cast("double") + 16
    series = F.log(x) + EULER_GAMMA + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, 4)) - 1 / (252 * F.pow(x, 6))
    return series - reduce(lambda a, b: a + b, [1.0 / (m + i) for i in range(16, 0, -1)])


def step_up(
    tests: DataFrame, q: float, group: Sequence[str] = (), declared: str | None = None,
    dependent: bool = False, buckets: int = 256,
) -> DataFrame:
    """Add ``rank``, ``threshold`` and ``discovery`` (step-up at level ``q``) per group.

    ``tests`` has ``test_id`` and ``p_value``. ``declared`` names a column with the cells
    declared up front; that count, not the number run, is the denominator, and declaring fewer
    than were run is an error. No task holds a whole group: tests are bucketed by p-value,
    bucket counts (one row per group and bucket) give each bucket its starting rank, and rows
    are ranked inside their bucket only.
    """
    keys = list(group)
    rows = tests.withColumn("__b", F.least(F.floor(F.col("p_value") * buckets), F.lit(buckets - 1)).cast("int"))
    extra = [F.max(declared).alias("__decl")] if declared else []
    counts = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"), *extra)
    run = W.partitionBy(*keys)
    ran = F.sum("__c").over(run)
    m = ran
    if declared:
        said = F.max("__decl").over(run)
        m = F.when(said < ran, F.raise_error(F.lit("more cells run than declared")).cast("bigint")).otherwise(said)
    placed = counts.select(
        *keys, "__b", m.alias("__m"),
        F.coalesce(F.sum("__c").over(run.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    inner = W.partitionBy(*keys, "__b").orderBy("p_value", "test_id")
    t = rows.join(placed, [*keys, "__b"]).withColumn("rank", F.col("__before") + F.row_number().over(inner))
    penalty = by_factor(F.col("__m")) if dependent else F.lit(1.0)
    t = t.withColumn("threshold", F.col("rank") * q / (F.col("__m") * penalty))
    cut = t.groupBy(*keys).agg(F.max(F.when(F.col("p_value") <= F.col("threshold"), F.col("rank"))).alias("__cut"))
    out = t.join(cut, keys) if keys else t.withColumn("__cut", cut.scalar())
    out = out.withColumn("discovery", F.coalesce(F.col("rank") <= F.col("__cut"), F.lit(False)))
    return out.drop("__b", "__before", "__m", "__cut")


def family_budget(families: DataFrame, q: float) -> DataFrame:
    """Add each family's share of the level (q m / M) and its first-discovery line (share / m)."""
    out = families.withColumn("__total", families.agg(F.sum("cells")).scalar())
    out = out.withColumn("budget", q * F.col("cells") / F.col("__total"))
    return out.withColumns(
        {"first_line": F.col("budget") / F.col("cells"), "by_factor": by_factor(F.col("cells"))}
    ).drop("__total")


def decide(low: Column, high: Column, one_sided: bool = False) -> Column:
    """True when the interval lies above zero, or (two-sided) on either side of it."""
    return low > 0 if one_sided else (low > 0) | (high < 0)


def replication_outcomes(original: DataFrame, variants: DataFrame) -> DataFrame:
    """(claim, variant, survived): interval excludes zero in the direction of the claim's original."""
    o = original.select("claim", F.signum("point").alias("direction"))
    v = variants.join(o, "claim")
    return v.withColumn("survived", decide(F.col("low"), F.col("high")) & (F.signum("point") == F.col("direction")))


def maturity_moves(runs: DataFrame) -> DataFrame:
    """(cell, current, stresses, broke, replications, survived, dimensions, next).

    ``runs`` holds ``cell, kind (stress|replication), dimension, survived, current`` with levels
    0 to 7. A broken stress demotes to level 3 at most; surviving confers nothing. Replication
    lifts to level 5 only with a surviving run and at least two dimensions varied.
    """
    stress, rep = F.col("kind") == "stress", F.col("kind") == "replication"
    g = runs.groupBy("cell").agg(
        F.max("current").alias("current"), F.count_if(stress).alias("stresses"),
        F.count_if(stress & ~F.col("survived")).alias("broke"), F.count_if(rep).alias("replications"),
        F.count_if(rep & F.col("survived")).alias("survived"), F.count_distinct(F.when(rep, F.col("dimension"))).alias("dimensions"),
    )
    lifted = F.when((F.col("survived") >= 1) & (F.col("dimensions") >= 2), F.greatest(F.col("current"), F.lit(5))).otherwise(F.col("current"))
    return g.withColumn("next", F.when(F.col("broke") > 0, F.least(lifted, F.lit(3))).otherwise(lifted))


def roc_auc(scored: DataFrame, group: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """Tie-aware AUC per group from counts per distinct score.

    Positives beat every negative of a smaller score and half of those tied with them; rows are
    first reduced to one per (group, score), so ties and size do not matter.
    """
    per = scored.groupBy(*group, score).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")
    )
    below = W.partitionBy(*group).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    t = per.withColumn("__below", F.coalesce(F.sum("n").over(below), F.lit(0)))
    return t.groupBy(*group).agg(
        F.sum("p").alias("positives"), F.sum("n").alias("negatives"),
        F.try_divide(F.sum(F.col("p") * (F.col("__below") + F.col("n") / 2)), (F.sum("p") * F.sum("n")).cast("double")).alias("auc"),
    )


def classification(scored: DataFrame, group: Sequence[str], threshold: float = 0.55) -> DataFrame:
    """Accuracy, base rate, and coverage/precision of calls beyond a symmetric threshold."""
    p, y = F.col("score"), F.col("label")
    called = (p >= threshold) | (p <= 1 - threshold)
    right = ((p >= 0.5).cast("int") == y).cast("double")
    return scored.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"),
        F.greatest(F.avg(y.cast("double")), 1 - F.avg(y.cast("double"))).alias("base_rate"),
        F.avg(called.cast("double")).alias("coverage"), F.avg(F.when(called, right)).alias("precision"),
    )


def trading_score(rows: DataFrame, group: Sequence[str], threshold: float = 0.55, cost: float = 0.001) -> DataFrame:
    """Trades, mean net log return, t-statistic and hit rate of calls beyond the threshold.

    ``rows`` carries ``score`` and ``outcome``: the log return from the next open onwards. A group
    without a call beyond the threshold keeps its row, with no trades and nulls. The t-statistic is
    taken from nets in whole 10^-12, added up exactly: the spread of nets that nearly agree would
    otherwise hang on the order of rows. Nets without a spread have none.
    """
    side = F.when(F.col("score") >= threshold, 1.0).when(F.col("score") <= 1 - threshold, -1.0)
    t = rows.withColumn("__net", side * F.col("outcome") - cost)
    t = t.withColumn("__units", F.floor(F.col("__net") * 1e12 + 0.5).cast("decimal(19,0)"))
    n, total, squares = F.count("__net"), F.sum("__units"), F.sum(F.col("__units") * F.col("__units"))
    spread = (n.cast("decimal(19,0)") * squares - total * total).cast("double")
    return t.groupBy(*group).agg(
        n.alias("trades"), F.avg("__net").alias("mean_net"),
        (total.cast("double") * F.sqrt(n - 1) / F.when(spread > 0, F.sqrt(spread))).alias("t_stat"),
        F.avg((F.col("__net") > 0).cast("double")).alias("hit_rate"),
    )


def pooled_summary(folds: DataFrame, group: Sequence[str]) -> DataFrame:
    """Fold rows to one per group: AUC averaged, trade means weighted by trades."""
    return folds.groupBy(*group).agg(
        F.count(F.lit(1)).alias("folds"), F.avg("auc").alias("auc"), F.sum("trades").alias("trades"),
        F.try_divide(F.sum(F.col("mean_net") * F.col("trades")), F.sum("trades").cast("double")).alias("mean_net"),
    )


def leak_alarm(panel: DataFrame, features: Sequence[str], outcome: str, limit: float = 0.95, least: int = 30) -> DataFrame:
    """(feature, n, corr, alarm): too much correlation with the outcome, or a forward-looking name."""
    aggs = []
    for f in features:
        both = F.col(f).isNotNull() & F.col(outcome).isNotNull()
        aggs += [F.count_if(both).alias(f"n_{f}"), F.corr(F.col(f).cast("double"), F.col(outcome)).alias(f"c_{f}")]
    rows = [
        F.struct(
            F.lit(f).alias("feature"), F.col(f"n_{f}").alias("n"), F.col(f"c_{f}").alias("corr"),
            (F.lit(f.startswith("fwd")) | F.coalesce((F.abs(f"c_{f}") > limit) & (F.col(f"n_{f}") >= least), F.lit(False))).alias("alarm"),
        )
        for f in features
    ]
    return panel.agg(*aggs).select(F.inline(F.array(*rows)))


# --- path tests ------------------------------------------------------------------------------------------


def path_days(days: DataFrame, n_paths: int, block: int, horizon: int, seed: int) -> DataFrame:
    """(path, d, r): resampled daily returns, ``d`` from 1 to ``horizon``.

    Each path's block starts are hashed; a block is expanded to its days by an equi-join on the
    day position, so the work is spread over (path, block) rows.
    """
    days, n = settled(days.select("day", "ret"))
    series = days.select((F.row_number().over(W.orderBy("day")) - 1).alias("pos"), "ret")  # one row per day
    spark = days.sparkSession
    blocks = -(-horizon // block)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    picks = (
        spark.range(0, n_paths, 1, tasks)
        .select(F.col("id").cast("int").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"))
        .select("path", "blk", hashed_start(seed, F.col("path"), F.col("blk"), F.lit(n - block + 1)).alias("start"))
    )
    rows = picks.select("path", "blk", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("j")).select(
        "path", (F.col("blk") * block + F.col("j") + 1).alias("d"), (F.col("start") + F.col("j")).alias("pos")
    ).where(F.col("d") <= horizon)
    return rows.join(sided(series, n), "pos").select("path", "d", F.col("ret").alias("r"))


def barrier_outcomes(
    paths: DataFrame, scales: Sequence[float], target: float, static: float | None = None,
    trailing: float | None = None, daily: float | None = None, first_day: int = 1,
) -> DataFrame:
    """(scale, path, outcome, day): first event per path at each constant scale.

    A constant scale needs no fold: equity is a running product, the peak a running maximum, and
    the outcome the earliest of the event days, loss events ahead of the target on the same day.
    """
    ks = F.array(*(F.lit(float(s)) for s in scales))
    rows = paths.select("path", "d", "r", F.explode(ks).alias("scale"))
    w = W.partitionBy("scale", "path").orderBy("d")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    step = 1 + F.col("r") * F.col("scale")
    e = rows.withColumn("eq", F.exp(F.sum(F.log(F.when(step > 0, step).otherwise(1e-300))).over(run)))
    e = e.withColumn("peak", F.greatest(F.lit(1.0), F.max("eq").over(run)))
    losses = []
    if daily is not None:
        losses.append(step <= 1 - daily)
    if trailing is not None:
        losses.append(F.col("eq") <= F.col("peak") * (1 - trailing))
    if static is not None:
        losses.append(F.col("eq") <= 1 - static)
    bust = reduce(lambda a, b: a | b, losses)
    hit = F.when(bust, F.struct("d", F.lit("bust").alias("o"))).when(
        (F.col("eq") >= 1 + target) & (F.col("d") >= first_day), F.struct("d", F.lit("pass").alias("o"))
    )
    g = e.groupBy("scale", "path").agg(F.min(hit).alias("h"), F.max("d").alias("last"))
    return g.select(
        "scale", "path", F.coalesce("h.o", F.lit("timeout")).alias("outcome"), F.coalesce("h.d", "last").alias("day")
    )


def two_stage(first: DataFrame, second: DataFrame) -> DataFrame:
    """Outcomes of a path that must pass the first stage, then the second on a fresh account."""
    j = first.join(second.select("scale", "path", F.col("outcome").alias("o2"), F.col("day").alias("d2")), ["scale", "path"])
    through = F.col("outcome") == "pass"
    return j.select(
        "scale", "path", F.when(through, F.col("o2")).otherwise(F.col("outcome")).alias("outcome"),
        (F.col("day") + F.when(through, F.col("d2")).otherwise(0)).alias("day"),
    )


def adaptive_outcomes(
    paths: DataFrame, base: float, reduced: float, target: float, static: float, min_days: int = 0
) -> DataFrame:
    """(path, outcome, day) when the scale depends on the state: ``reduced`` below the start.

    After the target is reached before ``min_days`` the account coasts at zero scale until then.
    A Catalyst fold per path over its own ordered days (bounded by the horizon).
    """
    packed = paths.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("d", "r"))).alias("days"))
    fold = f"""aggregate(days, named_struct('eq', 1D, 'o', cast(null as string), 'day', 0), (s, x) -> CASE
      WHEN s.o IS NOT NULL THEN s
      ELSE aggregate(array(s.eq * (1 + x.r * CASE WHEN s.eq >= 1 + {target}D THEN 0D WHEN s.eq < 1 THEN {reduced}D ELSE {base}D END)), s, (t, e) ->
        named_struct('eq', e, 'o', CASE WHEN e <= 1 - {static}D THEN 'bust' WHEN e >= 1 + {target}D AND x.d >= {min_days} THEN 'pass' END, 'day', x.d)) END)"""
    return packed.withColumn("s", F.expr(fold)).select("path", F.coalesce("s.o", F.lit("timeout")).alias("outcome"), F.col("s.day").alias("day"))


def evaluation_table(outcomes: DataFrame, keys: Sequence[str], fee: float, value: float) -> DataFrame:
    """Pass, bust and timeout rates, Wilson interval, median days, expected value per attempt and day."""
    n, ok = F.count(F.lit(1)), F.count_if(F.col("outcome") == "pass")
    passed = F.when(F.col("outcome") == "pass", F.col("day"))
    g = outcomes.groupBy(*keys).agg(
        n.alias("n_paths"), ok.alias("passes"), F.count_if(F.col("outcome") == "bust").alias("busts"),
        F.array_sort(F.collect_list(passed)).alias("__days"), F.avg("day").alias("mean_days"),
    )
    low, high = wilson(F.col("passes"), F.col("n_paths"))
    rate = F.col("passes") / F.col("n_paths")
    g = g.withColumns(
        {
            "pass_rate": rate, "bust_rate": F.col("busts") / F.col("n_paths"),
            "timeout_rate": (F.col("n_paths") - F.col("passes") - F.col("busts")) / F.col("n_paths"),
            "pass_low": low, "pass_high": high,
            "median_days": F.try_element_at("__days", F.floor(F.size("__days") / 2).cast("int") + 1),
            "ev": rate * value - fee, "breakeven_value": F.try_divide(F.lit(float(fee)), rate),
        }
    )
    return g.withColumn("ev_per_day", F.try_divide("ev", "mean_days")).drop("__days")


def best_sizing(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row with the best expected value per day."""
    packed = F.struct(*keys, "ev_per_day", "pass_rate")
    return table.agg(F.max_by(packed, F.struct("ev_per_day", *(F.col(k) for k in keys))).alias("b")).select("b.*")
