"""Cohort queries over the sightings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import asof
from tickloom.operators import cohorts as C
from tickloom.operators.skew import exact_percentiles, with_facts
from tickloom.plans.oracle import over
from tickloom.registry import query
from tickloom.session import shared
from tickloom.sources import market

_FIRST = "WITH fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY observed_at, event_id) AS rn FROM sightings) x WHERE rn = 1)"
_TS = "strftime({c}, '%Y-%m-%d %H:%M:%S') AS {n}"


@query("first_sightings", "L1 G13 A9", over("sightings", _FIRST + """
SELECT pool, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at, R6(price) AS price, R6(liquidity) AS liquidity, alive, event_id FROM fs"""))
def first_sightings(spark, sf_dir):
    return C.first_sightings(market.sightings(spark, sf_dir))


HZ = (15, 60, 240, 1440)
_OUT = _FIRST + """,
 en AS (SELECT s.pool, min(f.observed_at) AS disc, count(*) AS obs, min({'t': s.observed_at, 'e': s.event_id, 'p': s.price, 'l': s.liquidity}) FILTER (WHERE s.observed_at > f.observed_at AND s.alive AND s.price > 0) AS en FROM sightings s JOIN fs f ON s.pool = f.pool GROUP BY s.pool),
 fw AS (SELECT s.pool, s.observed_at, s.event_id, (epoch_us(s.observed_at) - epoch_us(en.en.t)) / 60000000.0 AS m, NOT s.alive OR coalesce(s.price <= 0, TRUE) AS gone,
  CASE WHEN NOT s.alive OR coalesce(s.price <= 0, TRUE) THEN -1.0 ELSE s.price / en.en.p - 1 END AS r FROM sightings s JOIN en ON s.pool = en.pool WHERE en.en IS NOT NULL AND obs >= 2 AND (s.observed_at > en.en.t OR (s.observed_at = en.en.t AND s.event_id >= en.en.e))),
 ag AS (SELECT pool, max(m) AS mc, max(r) AS peak, min_by(m, {'a': -r, 'b': observed_at, 'c': event_id}) AS mtp, min(m) FILTER (WHERE gone) AS del, """ + ", ".join(
    f"max(m) FILTER (WHERE m <= {h}) AS l{h}, max_by(r, {{'a': observed_at, 'b': event_id}}) FILTER (WHERE m <= {h}) AS r{h}, max(r) FILTER (WHERE m <= {h}) AS x{h}, min(r) FILTER (WHERE m <= {h}) AS n{h}" for h in HZ) + """ FROM fw GROUP BY pool),
 oc AS (SELECT en.pool, disc, obs, en.en.t AS entry_at, en.en.p AS ep, en.en.l AS el, mc, peak, mtp, del, """ + ", ".join(
    f"CASE WHEN l{h} >= {h} * 0.75 THEN greatest(r{h}, -1.0) END AS ret_{h}m, CASE WHEN l{h} >= {h} * 0.75 THEN x{h} END AS mfe_{h}m, CASE WHEN l{h} >= {h} * 0.75 THEN greatest(n{h}, -1.0) END AS mae_{h}m" for h in HZ) + """,
   CASE WHEN obs < 2 THEN 'too few observations' WHEN en.en IS NULL THEN 'no priced observation after discovery' ELSE 'ok' END AS reason FROM en LEFT JOIN ag ON en.pool = ag.pool)"""


def _outcomes(spark, sf_dir):
    s = market.sightings(spark, sf_dir)
    return C.outcomes(s, C.first_sightings(s))


@query("launch_outcomes", "L2 J8 A8", over("sightings", _OUT + """
SELECT pool, strftime(disc, '%Y-%m-%d %H:%M:%S') AS discovered_at, obs AS observations, strftime(entry_at, '%Y-%m-%d %H:%M:%S') AS entry_at, R6(ep) AS entry_price, R6(el) AS entry_liquidity, R6(mc) AS minutes_covered, R6(peak) AS peak_return,
 R6(mtp) AS minutes_to_peak, R6(del) AS delisted_at_min, """ + ", ".join(f"R6({k}_{h}m) AS {k}_{h}m" for h in HZ for k in ("ret", "mfe", "mae")) + ", reason FROM oc"))
def launch_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@query("launch_first_after", "J8", over("sightings", _FIRST + """
SELECT s.pool, strftime(min(s.observed_at), '%Y-%m-%d %H:%M:%S') AS next_at, R6(min_by(s.price, s.observed_at)) AS next_price FROM sightings s JOIN fs ON s.pool = fs.pool WHERE s.observed_at > fs.observed_at GROUP BY s.pool"""))
def launch_first_after(spark, sf_dir):
    """First sighting strictly after discovery, whatever its state."""
    s = market.sightings(spark, sf_dir)
    found = C.first_sightings(s).select("pool", F.col("observed_at").alias("at"))
    nxt = asof.first_after(found, s.select("pool", F.col("observed_at").alias("next_at"), F.col("price").alias("next_price")), "pool", "at", "next_at", ["next_price"])
    return nxt.drop("at")


@query("bar_outcomes", "L3", over("bars_1h", """
WITH o AS (SELECT symbol, min(ts) + INTERVAL 30 MINUTE AS ob FROM bars_1h GROUP BY symbol),
 e AS (SELECT b.symbol, min(b.ts) AS t, min_by(b.open, b.ts) AS p FROM bars_1h b JOIN o ON b.symbol = o.symbol WHERE b.ts > ob GROUP BY b.symbol),
 f AS (SELECT b.*, t, p, date_diff('minute', t, ts) AS m FROM bars_1h b JOIN e ON b.symbol = e.symbol WHERE ts >= t),
 g AS (SELECT symbol, t, p, max(m) AS mc, max(high) / p - 1 AS peak, min_by(m, {'a': -high, 'b': ts}) AS mtp, """ + ", ".join(
    f"max(m) FILTER (WHERE m <= {h}) AS l{h}, max_by(close, ts) FILTER (WHERE m <= {h}) AS c{h}, max(high) FILTER (WHERE m <= {h}) AS h{h}, min(low) FILTER (WHERE m <= {h}) AS w{h}" for h in HZ) + """ FROM f GROUP BY symbol, t, p)
SELECT symbol, strftime(t, '%Y-%m-%d %H:%M:%S') AS entry_at, R6(p) AS entry_price, R6(mc) AS minutes_covered, R6(peak) AS peak_return, R6(mtp) AS minutes_to_peak, """ + ", ".join(
    f"R6(CASE WHEN NOT (mc + 1 < {h} AND l{h} < {h} - 1) THEN c{h} / p - 1 END) AS ret_{h}m, R6(CASE WHEN NOT (mc + 1 < {h} AND l{h} < {h} - 1) THEN h{h} / p - 1 END) AS mfe_{h}m, R6(CASE WHEN NOT (mc + 1 < {h} AND l{h} < {h} - 1) THEN w{h} / p - 1 END) AS mae_{h}m" for h in HZ)
    + ", CAST(coalesce(" + ", ".join(f"CASE WHEN w{h} / p - 1 <= -0.90 THEN {h} END" for h in HZ) + ", -1) AS INTEGER) AS died_within FROM g"))
def bar_outcomes(spark, sf_dir):
    """Outcomes from bars, observed half an hour after each symbol's first bar."""
    bars = market.bars_1h(spark, sf_dir)
    obs = bars.groupBy("symbol").agg((F.min("ts") + F.expr("interval 30 minutes")).alias("observed_at"))
    return C.bar_outcomes(bars, obs).withColumn("died_within", F.coalesce("died_within", F.lit(-1)))


_LONG = _OUT + """,
 lg AS (""" + " UNION ALL ".join(f"SELECT pool, el, peak, {h} AS horizon, ret_{h}m AS ret, mfe_{h}m AS mfe, mae_{h}m AS mae FROM oc WHERE ep IS NOT NULL" for h in HZ) + ")"


@query("cohort_base_rates", "L4 L10 G2 G5", over("sightings", _LONG + """
SELECT horizon, count(*) AS n, R6(median(ret)) AS median, R6(avg(ret)) AS mean, R6(quantile_cont(ret, 0.9)) AS p90, R6(quantile_cont(ret, 0.99)) AS p99, R6(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)) AS up, """ + ", ".join(
    f"R6(avg(CASE WHEN mfe >= {t} THEN 1.0 ELSE 0.0 END)) AS mfe_ge_{int(t * 100)}" for t in (0.5, 1.0, 4.0, 9.0)) + """,
 R6(median(mae)) AS mae_median, R6(avg(CASE WHEN mae <= -0.5 THEN 1.0 ELSE 0.0 END)) AS mae_half, R6(avg(CASE WHEN mae <= -0.9 THEN 1.0 ELSE 0.0 END)) AS mae_dead,
 count(*) FILTER (WHERE abs(ret) < 1e-9 AND abs(mfe) < 1e-9 AND abs(mae) < 1e-9) AS never_moved FROM lg WHERE ret IS NOT NULL GROUP BY horizon"""))
def cohort_base_rates(spark, sf_dir):
    return C.base_rates(C.long_outcomes(_outcomes(spark, sf_dir)))


_FRAC = "(2.0 * {n} * (0.0025 + CASE WHEN {r} <= 0 THEN 1.0 ELSE least(1.0, 2.0 * {n} / NULLIF({r}, 0)) END + 0.01) + 2.0 / 0.95 * 0.40) / {n}"


@query("ticket_verdicts", "L5 L6 L7", over("sightings", f"""
WITH t AS (SELECT event_id, liquidity AS r, 25.0 + event_id % 7 * 100 AS n FROM sightings),
 f AS (SELECT *, {_FRAC.format(n='n', r='r')} AS fr FROM t), g AS (SELECT *, 2.0 / 0.95 * 0.40 / (fr * n) AS fs, 4.0 / NULLIF(r, 0) AS a, 2 * 0.0125 - 0.15 AS b FROM f),
 h AS (SELECT *, CASE WHEN r > 0 AND b * b - 4 * a * (2.0 / 0.95 * 0.40) >= 0 THEN sqrt(b * b - 4 * a * (2.0 / 0.95 * 0.40)) END AS sq FROM g)
SELECT CASE WHEN fr <= 0.15 THEN 'within ceiling' WHEN fs > 0.5 THEN 'flat fees dominate' ELSE 'pool too thin' END AS verdict, count(*) AS rows, R6(avg(fr)) AS friction, R6(avg(fs)) AS fee_share,
 R6(avg(CASE WHEN sq IS NOT NULL THEN greatest(0, (-b - sq) / (2 * a)) END)) AS min_notional, R6(avg(coalesce(greatest(0, CASE WHEN (-b + sq) / (2 * a) > 0 THEN (-b + sq) / (2 * a) ELSE (-b - sq) / (2 * a) END), 0))) AS max_notional FROM h GROUP BY 1"""))
def ticket_verdicts(spark, sf_dir):
    """Friction, reason and the viable band of sizes at every sighting's depth."""
    s = market.sightings(spark, sf_dir).select("event_id", F.col("liquidity").alias("r"), (25.0 + F.col("event_id") % 7 * 100).alias("n"))
    v = C.verdict(F.col("n"), F.col("r"))
    low, high = C.viable_notionals(F.when(F.col("r") > 0, F.col("r")))
    rows = s.withColumns({**v, "low": low, "high": high})
    return rows.groupBy("verdict").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("friction").alias("friction"), F.avg("fee_share").alias("fee_share"),
        F.avg("low").alias("min_notional"), F.avg("high").alias("max_notional"),
    )


TICKETS = (10.0, 25.0, 50.0, 100.0, 250.0, 1000.0)


@query("tradable_universe", "L8", over("sightings", _OUT + f""",
 k AS (SELECT unnest({list(TICKETS)}) AS ticket)
SELECT R6(ticket) AS ticket, count(*) AS cohort, count(el) AS quoted, count(*) FILTER (WHERE {_FRAC.format(n='ticket', r='el')} <= 0.15) AS tradable FROM oc, k WHERE ep IS NOT NULL GROUP BY ticket"""))
def tradable_universe(spark, sf_dir):
    return C.tradable(_outcomes(spark, sf_dir), TICKETS)


@query("depth_deciles", "L8 G2", over("sightings", _OUT + """
SELECT R6(quantile_cont(el, 0.1)) AS p10, R6(quantile_cont(el, 0.25)) AS p25, R6(quantile_cont(el, 0.5)) AS p50, R6(quantile_cont(el, 0.75)) AS p75, R6(quantile_cont(el, 0.9)) AS p90 FROM oc WHERE ep IS NOT NULL"""))
def depth_deciles(spark, sf_dir):
    qs = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    live = _outcomes(spark, sf_dir).where("entry_price is not null").select(F.lit("all").alias("cohort"), "entry_liquidity")
    return exact_percentiles(live, ["cohort"], "entry_liquidity", qs).drop("cohort")


@query("net_outcomes", "L9 G4", over("sightings", _LONG + f""",
 nt AS (SELECT horizon, pool, greatest(-1.0, ret - {_FRAC.format(n='100.0', r='el')}) AS net FROM lg WHERE ret IS NOT NULL AND el IS NOT NULL AND {_FRAC.format(n='100.0', r='el')} <= 0.15),
 rk AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY net, pool) AS r, count(*) OVER (PARTITION BY horizon) AS n FROM nt)
SELECT horizon, count(*) AS n, R6(median(net)) AS median, R6(avg(net)) AS mean, R6(avg(net) FILTER (WHERE r > CASE WHEN n > 40 THEN floor(n * 0.01) ELSE 0 END AND r <= n - CASE WHEN n > 40 THEN floor(n * 0.01) ELSE 0 END)) AS trimmed_mean,
 R6(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)) AS win_share FROM rk GROUP BY horizon"""))
def net_outcomes(spark, sf_dir):
    """What a hundred-dollar ticket keeps, over pools it could enter."""
    return C.trimmed_summary(C.net_outcomes(C.long_outcomes(_outcomes(spark, sf_dir)), 100.0))


@query("best_peaks", "L10 K10", over("sightings", _OUT + """
SELECT k, R6(peak) AS peak FROM (SELECT peak, row_number() OVER (ORDER BY peak DESC, pool) AS k FROM oc WHERE peak IS NOT NULL) x WHERE k IN (1, 5, 10, 25, 50)"""))
def best_peaks(spark, sf_dir):
    return C.best_peaks(_outcomes(spark, sf_dir))


@query("aged_sample", "L11", over("sightings", _FIRST + """
SELECT pool, event_id FROM fs WHERE (epoch_us(TIMESTAMP '2024-01-05') - epoch_us(observed_at)) / 60000000.0 >= 1440 ORDER BY md5('17|' || pool) LIMIT 20"""))
def aged_sample(spark, sf_dir):
    """A reproducible sample of twenty aged launches."""
    return C.aged_sample(C.first_sightings(market.sightings(spark, sf_dir)), "2024-01-05", 1440, 20, 17).select("pool", "event_id")


@query("tracked_set", "L12 J9", over("sightings", _FIRST + """
SELECT fs.pool, count(s.event_id) AS sightings FROM fs LEFT JOIN sightings s ON s.pool = fs.pool AND s.observed_at > fs.observed_at WHERE (epoch_us(TIMESTAMP '2024-01-03') - epoch_us(fs.observed_at)) / 60000000.0 < 2000 GROUP BY fs.pool"""))
def tracked_set(spark, sf_dir):
    s = market.sightings(spark, sf_dir)
    t = shared(C.tracked(C.first_sightings(s), "2024-01-03", 2000).select("pool", F.col("observed_at").alias("found")))
    later = with_facts(s, t, "pool").where("observed_at > found").groupBy("pool").agg(F.count(F.lit(1)).alias("sightings"))
    return t.select("pool").join(later, "pool", "left").fillna(0, ["sightings"])


@query("panel_span", "L13", over("sightings", """
SELECT count(DISTINCT pool) AS pools, count(*) AS rows, strftime(min(observed_at), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(observed_at), '%Y-%m-%d %H:%M:%S') AS last, R6((epoch_us(max(observed_at)) - epoch_us(min(observed_at))) / 3600000000.0) AS hours FROM sightings"""))
def panel_span(spark, sf_dir):
    return C.span(market.sightings(spark, sf_dir))


@query("unregistered_pools", "J9 K9", over("sightings", _FIRST + """
SELECT DISTINCT s.pool FROM sightings s WHERE s.pool NOT IN (SELECT pool FROM fs WHERE observed_at < TIMESTAMP '2024-01-02')"""))
def unregistered_pools(spark, sf_dir):
    """Pools seen but not in the registry of the first day (anti join)."""
    s = market.sightings(spark, sf_dir)
    known = C.first_sightings(s).where("observed_at < timestamp_ntz'2024-01-02'").select("pool")
    return s.select("pool").distinct().join(known, "pool", "left_anti")
