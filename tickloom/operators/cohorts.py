"""Cohorts: first sightings, what happened afterwards, and what a ticket of a given size keeps.

A pool can hold a large share of all sightings, so nothing collects a pool's history: every
per-pool result is a map-side-combined aggregate. Joining a pool's few facts back onto its
sightings is salted: the facts side holds one row per pool and is repeated once per salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators.skew import exact_percentiles, with_facts
from tickloom.session import shared

# Horizons in minutes, share of a horizon that must be observed, losses.
HORIZONS = (15, 60, 240, 1440)
COVERED = 0.75
LOST = -1.0
DEATH = 0.90


def first_sightings(sightings: DataFrame, columns: Sequence[str] = ("price", "liquidity", "alive", "event_id")) -> DataFrame:
    """One row per pool: its earliest sighting, never revised (ties by event id)."""
    row = F.struct("observed_at", "event_id", *(c for c in columns if c != "event_id"))
    g = sightings.groupBy("pool").agg(F.min_by(row, F.struct("observed_at", "event_id")).alias("f"))
    return g.select("pool", "f.*")


def minutes(later: Column, earlier: Column) -> Column:
    us = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return us / 60_000_000.0


def entries(sightings: DataFrame, discovered: DataFrame) -> DataFrame:
    """(pool, discovered_at, entry_at, entry_price, entry_liquidity, observations).

    Entry is the first alive, positively priced sighting strictly after discovery.
    """
    d = discovered.select("pool", F.col("observed_at").alias("discovered_at"))
    j = with_facts(sightings, d, "pool")
    ok = (F.col("observed_at") > F.col("discovered_at")) & F.col("alive") & (F.col("price") > 0)
    row = F.struct("observed_at", "event_id", "price", "liquidity")
    g = j.groupBy("pool", "discovered_at").agg(F.min(F.when(ok, row)).alias("e"), F.count(F.lit(1)).alias("observations"))
    return g.select(
        "pool", "discovered_at", "observations", F.col("e.observed_at").alias("entry_at"), F.col("e.price").alias("entry_price"),
        F.col("e.liquidity").alias("entry_liquidity"), F.col("e.event_id").alias("entry_event"),
    )


def _label(h: int) -> str:
    return f"{h}m"


def outcomes(sightings: DataFrame, discovered: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """One row per pool: forward return, best and worst excursion per horizon, peak, delisting.

    A horizon is claimed only if the last sighting inside it reaches 75% of it. A sighting that
    is dead or unpriced counts as a total loss from then on. All horizons are conditional
    aggregates of one pass over the sightings after entry.
    """
    ent = entries(sightings, discovered)
    live = ent.where(F.col("entry_at").isNotNull() & (F.col("observations") >= 2))
    j = with_facts(sightings, live.select("pool", "entry_at", "entry_price", "entry_event"), "pool")
    at = F.struct("observed_at", "event_id")
    fwd = j.where(at >= F.struct("entry_at", "entry_event"))
    gone = ~F.col("alive") | F.coalesce(F.col("price") <= 0, F.lit(True))
    fwd = fwd.withColumns(
        {
            "m": minutes(F.col("observed_at"), F.col("entry_at")),
            "gone": gone,
            "r": F.when(gone, LOST).otherwise(F.try_divide("price", "entry_price") - 1),
        }
    )
    aggs = []
    for h in horizons:
        inside = F.col("m") <= h
        aggs += [
            F.max(F.when(inside, F.col("m"))).alias(f"last{h}"),
            F.max_by(F.when(inside, F.col("r")), F.when(inside, at)).alias(f"ret{h}"),
            F.max(F.when(inside, F.col("r"))).alias(f"mfe{h}"),
            F.min(F.when(inside, F.col("r"))).alias(f"mae{h}"),
        ]
    g = fwd.groupBy("pool").agg(
        F.max("m").alias("minutes_covered"), F.max("r").alias("peak_return"),
        F.min_by("m", F.struct((-F.col("r")).alias("nr"), "observed_at", "event_id")).alias("minutes_to_peak"),
        F.min(F.when(F.col("gone"), F.col("m"))).alias("delisted_at_min"), *aggs,
    )
    cols = []
    for h in horizons:
        seen = F.col(f"last{h}") >= h * COVERED
        cols += [
            F.when(seen, F.greatest(f"ret{h}", F.lit(LOST))).alias(f"ret_{_label(h)}"),
            F.when(seen, F.col(f"mfe{h}")).alias(f"mfe_{_label(h)}"),
            F.when(seen, F.greatest(f"mae{h}", F.lit(LOST))).alias(f"mae_{_label(h)}"),
        ]
    return ent.drop("entry_event").join(
        g.select("pool", "minutes_covered", "peak_return", "minutes_to_peak", "delisted_at_min", *cols), "pool", "left"
    ).withColumn(
        "reason",
        F.when(F.col("observations") < 2, "too few observations").when(F.col("entry_at").isNull(), "no priced observation after discovery").otherwise("ok"),
    )


def bar_outcomes(bars: DataFrame, observed: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """The same from minute-stamped bars: entry is the open of the first bar after observation.

    A horizon is dropped when coverage falls short of it and its last bar is more than a minute
    early. ``died_within`` is the first horizon whose worst low is a 90% loss.
    """
    o = observed.select("symbol", F.col("observed_at"))
    after = bars.join(o, "symbol").where(F.col("ts") > F.col("observed_at"))
    ent = after.groupBy("symbol").agg(F.min(F.struct("ts", "open")).alias("e")).select(
        "symbol", F.col("e.ts").alias("entry_at"), F.col("e.open").alias("entry_price")
    ).where("entry_price > 0")
    fwd = bars.join(ent, "symbol").where(F.col("ts") >= F.col("entry_at")).withColumn("m", minutes(F.col("ts"), F.col("entry_at")))
    aggs = []
    for h in horizons:
        inside = F.col("m") <= h
        aggs += [
            F.max(F.when(inside, F.col("m"))).alias(f"last{h}"), F.max_by(F.when(inside, F.col("close")), F.when(inside, F.col("ts"))).alias(f"c{h}"),
            F.max(F.when(inside, F.col("high"))).alias(f"h{h}"), F.min(F.when(inside, F.col("low"))).alias(f"l{h}"),
        ]
    g = fwd.groupBy("symbol", "entry_at", "entry_price").agg(
        F.max("m").alias("minutes_covered"), (F.max("high") / F.first("entry_price") - 1).alias("peak_return"),
        F.min_by("m", F.struct((-F.col("high")).alias("nh"), "ts")).alias("minutes_to_peak"), *aggs,
    )
    p = F.col("entry_price")
    cols, deaths = [], []
    for h in horizons:
        claim = ~((F.col("minutes_covered") + 1 < h) & (F.col(f"last{h}") < h - 1))
        mae = F.when(claim, F.col(f"l{h}") / p - 1)
        deaths.append(F.when(mae <= -DEATH, h))
        cols += [
            F.when(claim, F.col(f"c{h}") / p - 1).alias(f"ret_{_label(h)}"), F.when(claim, F.col(f"h{h}") / p - 1).alias(f"mfe_{_label(h)}"),
            mae.alias(f"mae_{_label(h)}"),
        ]
    return g.select("symbol", "entry_at", "entry_price", "minutes_covered", "peak_return", "minutes_to_peak", *cols, F.coalesce(*deaths).alias("died_within"))


def long_outcomes(out: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """(pool, horizon, ret, mfe, mae, liquidity, peak) from the wide outcome row."""
    rows = [
        F.struct(F.lit(h).alias("horizon"), F.col(f"ret_{_label(h)}").alias("ret"), F.col(f"mfe_{_label(h)}").alias("mfe"), F.col(f"mae_{_label(h)}").alias("mae"))
        for h in horizons
    ]
    return out.where(F.col("entry_price").isNotNull()).select("pool", "entry_liquidity", "peak_return", F.inline(F.array(*rows)))


def base_rates(long: DataFrame, upside: Sequence[float] = (0.5, 1.0, 4.0, 9.0)) -> DataFrame:
    """Per horizon: counts, median, mean, p90, p99, share up, upside tail and downside shares."""
    share = lambda c: F.avg(c.cast("double"))
    rows = shared(long.where("ret is not null"))
    rates = rows.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), share(F.col("ret") > 0).alias("up"),
        *(share(F.col("mfe") >= t).alias(f"mfe_ge_{int(t * 100)}") for t in upside),
        share(F.col("mae") <= -0.5).alias("mae_half"), share(F.col("mae") <= -0.9).alias("mae_dead"),
        F.count_if((F.abs("ret") < 1e-9) & (F.abs("mfe") < 1e-9) & (F.abs("mae") < 1e-9)).alias("never_moved"),
    )
    ret = exact_percentiles(rows, ["horizon"], "ret", {"median": 0.5, "p90": 0.9, "p99": 0.99})
    return rates.join(ret, "horizon").join(exact_percentiles(rows, ["horizon"], "mae", {"mae_median": 0.5}), "horizon")


# --- costs ------------------------------------------------------------------------------------------------

# Flat fee in dollars, venue fee, failure rate, extra slippage, friction ceiling.
FLAT_FEE, VENUE_FEE, FAILURE, SLIPPAGE, CEILING = 0.40, 0.0025, 0.05, 0.01, 0.15
FEE_PAID = 2.0 / (1.0 - FAILURE) * FLAT_FEE


def impact(notional: Column, reserve: Column) -> Column:
    return F.when(reserve <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(2.0 * notional, reserve)))


def round_trip_frac(notional: Column, reserve: Column) -> Column:
    """Round-trip friction per dollar traded: both legs' fees, impact, slippage, expected flat fees."""
    cost = 2.0 * notional * (VENUE_FEE + impact(notional, reserve) + SLIPPAGE) + FEE_PAID
    return F.when(notional > 0, cost / notional)


def verdict(notional: Column, reserve: Column, ceiling: float = CEILING) -> dict[str, Column]:
    """Friction, share of it that is flat fees, viability and the reason."""
    frac = round_trip_frac(notional, reserve)
    fees = F.try_divide(F.lit(FEE_PAID), frac * notional)
    reason = (
        F.when(~(notional > 0), "non-positive notional").when(frac <= ceiling, "within ceiling")
        .when(fees > 0.5, "flat fees dominate").otherwise("pool too thin")
    )
    return {"friction": frac, "fee_share": fees, "viable": F.coalesce(frac <= ceiling, F.lit(False)), "verdict": reason}


def viable_notionals(reserve: Column, ceiling: float = CEILING) -> tuple[Column, Column]:
    """Smallest and largest notional inside the ceiling: the roots of the friction quadratic.

    Where no size fits, the smallest is null and the largest zero.
    """
    a, b = 4.0 / reserve, 2.0 * (VENUE_FEE + SLIPPAGE) - ceiling
    disc = b * b - 4.0 * a * FEE_PAID
    root = F.sqrt(F.when((reserve > 0) & (disc >= 0), disc))
    low, high = (-b - root) / (2.0 * a), (-b + root) / (2.0 * a)
    return F.when(root.isNotNull(), F.greatest(F.lit(0.0), low)), F.coalesce(F.greatest(F.lit(0.0), F.when(high > 0, high).otherwise(low)), F.lit(0.0))


def tradable(out: DataFrame, tickets: Sequence[float]) -> DataFrame:
    """(ticket, tradable, quoted, cohort): pools whose friction at that size is inside the ceiling."""
    live = out.where(F.col("entry_price").isNotNull())
    depth = F.col("entry_liquidity")
    aggs = [F.count(F.lit(1)).alias("cohort"), F.count(depth).alias("quoted")]
    aggs += [F.count_if(round_trip_frac(F.lit(float(t)), depth) <= CEILING).alias(f"t{i}") for i, t in enumerate(tickets)]
    rows = [F.struct(F.lit(float(t)).alias("ticket"), F.col(f"t{i}").alias("tradable")) for i, t in enumerate(tickets)]
    return live.agg(*aggs).select("cohort", "quoted", F.inline(F.array(*rows)))


def net_outcomes(long: DataFrame, notional: float) -> DataFrame:
    """(horizon, pool, net): return less friction, floored at a total loss, tradable pools only."""
    frac = round_trip_frac(F.lit(float(notional)), F.col("entry_liquidity"))
    rows = long.dropna(subset=["ret", "entry_liquidity"]).where(frac <= CEILING)
    return rows.select("horizon", "pool", F.greatest(F.lit(-1.0), F.col("ret") - frac).alias("net"))


def trimmed_summary(net: DataFrame, share: float = 0.01, least: int = 40, buckets: int = 512) -> DataFrame:
    """Per horizon: n, median, mean, win share, and the mean without ``share`` of rows at each end.

    Trimming applies above ``least`` rows. Ranks come from bucket counts plus an order inside the
    bucket, over distinct values with their counts, so a horizon is never sorted in one task.
    """
    net = shared(net)
    squashed = F.col("net") / (1 + F.abs("net"))  # monotone map of returns onto (-1, 1)
    # Equal values are one row with a count: trimming takes values, so their order is free.
    per_value = net.groupBy("horizon", "net").agg(F.count(F.lit(1)).alias("__c"))
    per_value = per_value.withColumn("__b", F.floor((squashed + 1) / 2 * buckets).cast("int"))
    counts = per_value.groupBy("horizon", "__b").agg(F.sum("__c").alias("__t"))
    run = W.partitionBy("horizon").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    placed = counts.select(
        "horizon", "__b", F.coalesce(F.sum("__t").over(run), F.lit(0)).alias("__before"), F.sum("__t").over(W.partitionBy("horizon")).alias("__n")
    )
    inner = W.partitionBy("horizon", "__b").orderBy("net").rowsBetween(W.unboundedPreceding, 0)
    r = per_value.join(placed, ["horizon", "__b"]).withColumn("__hi", F.col("__before") + F.sum("__c").over(inner))
    cut = F.when(F.col("__n") > least, F.floor(F.col("__n") * share)).otherwise(0)
    lo, hi = F.greatest(F.col("__hi") - F.col("__c"), cut), F.least(F.col("__hi"), F.col("__n") - cut)
    kept = F.greatest(hi - lo, F.lit(0))
    out = r.groupBy("horizon").agg(
        F.sum("__c").alias("n"), F.try_divide(F.sum(F.col("net") * F.col("__c")), F.sum("__c").cast("double")).alias("mean"),
        F.try_divide(F.sum(F.col("net") * kept), F.sum(kept).cast("double")).alias("trimmed_mean"),
        F.try_divide(F.sum(F.when(F.col("net") > 0, F.col("__c")).otherwise(0)), F.sum("__c").cast("double")).alias("win_share"),
    )
    return out.join(exact_percentiles(net, ["horizon"], "net", {"median": 0.5}), "horizon")


def best_peaks(out: DataFrame, ks: Sequence[int] = (1, 5, 10, 25, 50)) -> DataFrame:
    """(k, peak): the k-th best peak return, as an ordered limit of the largest ``max(ks)``."""
    top = out.where("peak_return is not null").select("peak_return", "pool").orderBy(F.col("peak_return").desc(), "pool").limit(max(ks))
    # The window runs over the limited rows only.
    ranked = top.withColumn("k", F.row_number().over(W.orderBy(F.col("peak_return").desc(), "pool")))
    return ranked.where(F.col("k").isin(*ks)).select("k", F.col("peak_return").alias("peak"))


def aged_sample(registry: DataFrame, now: str, min_age_min: float, n: int, seed: int, key: str = "pool") -> DataFrame:
    """A fixed sample without replacement of rows at least that old: the ``n`` smallest seeded hashes."""
    age = minutes(F.lit(now).cast("timestamp_ntz"), F.col("observed_at"))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)))
    return registry.where(age >= min_age_min).withColumn("__h", h).orderBy("__h").limit(n).drop("__h")


def tracked(registry: DataFrame, now: str, max_age_min: float) -> DataFrame:
    age = minutes(F.lit(now).cast("timestamp_ntz"), F.col("observed_at"))
    return registry.where(age < max_age_min)


def span(sightings: DataFrame) -> DataFrame:
    """(pools, rows, first, last, hours) of the panel."""
    g = sightings.agg(
        F.count_distinct("pool").alias("pools"), F.count(F.lit(1)).alias("rows"), F.min("observed_at").alias("first"), F.max("observed_at").alias("last")
    )
    return g.withColumn("hours", minutes(F.col("last"), F.col("first")) / 60)
