"""Intraday event studies on hourly bars: one event per symbol-day, signed to an outcome.

A symbol-day holds at most 24 hourly bars, so day-level facts (opening range, day close,
previous levels) are window columns over (symbol, day) and events need no loops.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import features as X
from tickloom.functions import windows as V
from tickloom.operators import bars as B
from tickloom.operators import bootstrap as R
from tickloom.operators import signals as S
from tickloom.operators.cells import Cell, Event, event_days, two_group_days
from tickloom.plans.oracle import event_mean, over, percentile_rank, rolling, two_group
from tickloom.registry import query
from tickloom.sources import market

MIN_BARS = 18  # hourly bars a day needs to count
LEADER = "view"


def day_window():
    return W.partitionBy("symbol", "day")


def hourly(spark, sf_dir):
    return B.intraday(market.bars_1h(spark, sf_dir))


def session_frame(bars, open_hours: int = 1, open_bars: int = 1, min_bars: int = MIN_BARS):
    """Hourly bars with day facts: bar number, opening range and return, day close, prior levels.

    Days with too few bars are dropped and also reset the prior-day levels; an opening counts
    only when it has exactly ``open_bars`` bars.
    """
    d = day_window()
    first = F.col("hh") < open_hours
    run = d.orderBy("ts")
    df = bars.withColumns(
        {
            "n": F.count(F.lit(1)).over(d),
            "i": F.row_number().over(run) - 1,
            "n_open": F.count_if(first).over(d),
            "open_high": F.max(F.when(first, F.col("high"))).over(d),
            "open_low": F.min(F.when(first, F.col("low"))).over(d),
            "open_first": F.min_by(F.when(first, F.col("open")), F.when(first, F.col("ts"))).over(d),
            "open_last": F.max_by(F.when(first, F.col("close")), F.when(first, F.col("ts"))).over(d),
            "day_open": F.min_by("open", "ts").over(d),
            "day_close": F.max_by("close", "ts").over(d),
            "day_high": F.max("high").over(d),
            "day_low": F.min("low").over(d),
        }
    ).withColumn("ok_open", F.col("n_open") == open_bars)
    levels = df.groupBy("symbol", "day").agg(
        F.first("n").alias("nb"), F.first("day_high").alias("dh"), F.first("day_low").alias("dl")
    )
    w = V.by_symbol()
    prior_ok = F.lag("nb").over(w) >= min_bars
    levels = levels.select(
        "symbol",
        "day",
        F.when(prior_ok, F.lag("dh").over(w)).alias("prev_high"),
        F.when(prior_ok, F.lag("dl").over(w)).alias("prev_low"),
    )
    return df.where(F.col("n") >= min_bars).join(levels, ["symbol", "day"])


def first_break(df, up, down, scope):
    """(symbol, day, v): signed return to the day close from the first bar breaking a level."""
    hit = df.where(scope & (up | down)).groupBy("symbol", "day").agg(
        F.min_by(F.struct(F.when(up, 1.0).otherwise(-1.0).alias("s"), "close", "day_close"), "ts").alias("e")
    )
    return hit.select("symbol", "day", (F.col("e.s") * (F.try_divide("e.day_close", "e.close") - 1)).alias("v"))


_SESSION = f"""
WITH h AS (SELECT *, CAST(ts AS DATE) AS day, hour(ts) AS hh FROM bars_1h),
 d AS (SELECT symbol, day, count(*) AS n, count(*) FILTER (WHERE hh < 1) AS n_open, max(high) FILTER (WHERE hh < 1) AS oh, min(low) FILTER (WHERE hh < 1) AS ol,
  min_by(open, ts) FILTER (WHERE hh < 1) AS o_first, max_by(close, ts) FILTER (WHERE hh < 1) AS o_last, min_by(open, ts) AS d_open, max_by(close, ts) AS d_close, max(high) AS dh, min(low) AS dl FROM h GROUP BY symbol, day),
 e AS (SELECT *, CASE WHEN lag(n) OVER w >= {MIN_BARS} THEN lag(dh) OVER w END AS ph, CASE WHEN lag(n) OVER w >= {MIN_BARS} THEN lag(dl) OVER w END AS pl FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 f AS (SELECT h.symbol, h.ts, h.day, h.hh, h.open, h.high, h.low, h.close, h.volume, e.n, n_open, oh, ol, o_first, o_last, d_open, d_close, dh, dl, ph, pl,
  row_number() OVER (PARTITION BY h.symbol, h.day ORDER BY h.ts) - 1 AS i FROM h JOIN e ON h.symbol = e.symbol AND h.day = e.day WHERE e.n >= {MIN_BARS})"""


@query("study_session_events", "E44 E45 E46 E48 R4 S2", over("bars_1h", event_mean(_SESSION + """,
 b44 AS (SELECT symbol, day, min_by({'v': (CASE WHEN close > oh THEN 1.0 ELSE -1.0 END) * (d_close / close - 1)}, ts).v AS v FROM f WHERE n_open = 1 AND hh BETWEEN 1 AND 5 AND (close > oh OR close < ol) GROUP BY symbol, day),
 b48 AS (SELECT symbol, day, min_by({'v': (CASE WHEN close > ph THEN 1.0 ELSE -1.0 END) * (d_close / close - 1)}, ts).v AS v FROM f WHERE hh < 12 AND ph IS NOT NULL AND (close > ph OR close < pl) GROUP BY symbol, day),
 b45 AS (SELECT symbol, day, sign(o_last / o_first - 1) * (d_close / o_last - 1) AS v FROM f WHERE n_open = 1 AND i = 0 AND o_last <> o_first),
 b46 AS (SELECT symbol, day, sign(c2 / c1 - 1) * (dc / c2 - 1) AS v FROM (SELECT symbol, day, max(close) FILTER (WHERE hh = 13) AS c1, max(close) FILTER (WHERE hh = 15) AS c2, max(d_close) AS dc FROM f GROUP BY symbol, day) x WHERE c1 <> c2),
 ev AS (SELECT 'opening_range' AS cell, day, v FROM b44 UNION ALL SELECT 'first_hour', day, v FROM b45 UNION ALL SELECT 'midday', day, v FROM b46 UNION ALL SELECT 'prior_level', day, v FROM b48)""", block=3, seed=4410)))
def study_session_events(spark, sf_dir):
    """Opening-range break, first-hour and mid-day momentum, previous-day level break."""
    f = session_frame(hourly(spark, sf_dir))
    c = F.col("close")
    opening = first_break(f, c > F.col("open_high"), c < F.col("open_low"), F.col("ok_open") & F.col("hh").between(1, 5))
    prior = first_break(f, c > F.col("prev_high"), c < F.col("prev_low"), (F.col("hh") < 12) & F.col("prev_high").isNotNull())
    start = F.try_divide("open_last", "open_first") - 1
    first = f.where(F.col("ok_open") & (F.col("i") == 0) & (start != 0)).select(
        "symbol", "day", (F.signum(start) * (F.try_divide("day_close", "open_last") - 1)).alias("v")
    )
    mid = f.groupBy("symbol", "day").agg(
        F.max(F.when(F.col("hh") == 13, c)).alias("a"), F.max(F.when(F.col("hh") == 15, c)).alias("b"), F.first("day_close").alias("dc")
    ).where("a <> b")
    mid = mid.select("symbol", "day", (F.signum(F.col("b") / F.col("a") - 1) * (F.col("dc") / F.col("b") - 1)).alias("v"))
    tagged = [
        df.select(F.lit(name).alias("cell"), "day", "v")
        for name, df in (("opening_range", opening), ("first_hour", first), ("midday", mid), ("prior_level", prior))
    ]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3])
    days = rows.groupBy("cell", "day").agg(F.sum("v").alias("v_sum"), F.count("v").alias("v_n")).where("v_n > 0")
    return R.event_mean_ci(days, block=3, seed=4410)


def burst_panel(spark, sf_dir):
    """Hourly return, trailing deviation before the bar, session VWAP stretch, two-hour outcome."""
    w = V.by_symbol("ts")
    run = day_window().orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    p = hourly(spark, sf_dir).withColumns(
        {
            "ret": X.ret(w=w).expr,
            "fwd2": X.forward_return(2, w=w).expr,
            "vwap": F.try_divide(F.sum(typical * F.col("volume")).over(run), F.sum("volume").over(run)),
        }
    )
    p = p.withColumns({"stretch": F.try_divide("close", "vwap") - 1, "sigma": V.full(F.stddev_samp, "ret", 24, w, end=-1)})
    return p.withColumn("sstd", V.full(F.stddev_samp, "stretch", 24, w, end=-1))


_BURST = f"""
WITH a AS (SELECT symbol, ts, CAST(ts AS DATE) AS day, close, volume, taker_buy, close / lag(close) OVER w - 1 AS ret, lead(close, 2) OVER w / close - 1 AS fwd2,
  sum((high + low + close) / 3 * volume) OVER s / NULLIF(sum(volume) OVER s, 0) AS vwap FROM bars_1h
  WINDOW w AS (PARTITION BY symbol ORDER BY ts), s AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)),
 b AS (SELECT *, close / vwap - 1 AS stretch, {rolling('stddev_samp', 'ret', 24, -1, order='ts')} AS sigma FROM a),
 c AS (SELECT *, {rolling('stddev_samp', 'stretch', 24, -1, order='ts')} AS sstd FROM b)"""


@query("study_bursts", "E49 E50 F22", over("bars_1h", event_mean(_BURST + """,
 ev AS (SELECT 'burst' AS cell, day, CASE WHEN ret > 0 THEN fwd2 ELSE -fwd2 END AS v FROM c WHERE abs(ret) > 2.0 * sigma AND fwd2 IS NOT NULL
  UNION ALL SELECT 'vwap_reversion', day, CASE WHEN stretch > 0 THEN -fwd2 ELSE fwd2 END FROM c WHERE abs(stretch) > 1.5 * sstd AND fwd2 IS NOT NULL)""", block=3, seed=4910)))
def study_bursts(spark, sf_dir):
    """Volatility-burst continuation and session-VWAP reversion."""
    p = burst_panel(spark, sf_dir).dropna(subset=["fwd2"])
    burst = F.when(F.abs("ret") > 2.0 * F.col("sigma"), F.when(F.col("ret") > 0, F.col("fwd2")).otherwise(-F.col("fwd2")))
    back = F.when(F.abs("stretch") > 1.5 * F.col("sstd"), F.when(F.col("stretch") > 0, -F.col("fwd2")).otherwise(F.col("fwd2")))
    return R.event_mean_ci(event_days(p, [Event("burst", burst), Event("vwap_reversion", back)]), block=3, seed=4910)


@query("study_aggressor_imbalance", "E53 F23", over("bars_1h", event_mean(f"""
WITH a AS (SELECT symbol, ts, CAST(ts AS DATE) AS day, close, taker_buy / volume - 0.5 AS raw FROM bars_1h WHERE volume > 0),
 b AS (SELECT *, {rolling('avg', 'raw', 4, order='ts')} AS imb, lead(close, 4) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS fwd4 FROM a),
 c AS (SELECT *, {rolling('avg', 'imb', 24, -1, order='ts')} AS mu, {rolling('stddev_samp', 'imb', 24, -1, order='ts')} AS sd FROM b),
 ev AS (SELECT 'imbalance' AS cell, day, CASE WHEN imb > mu THEN fwd4 ELSE -fwd4 END AS v FROM c WHERE abs((imb - mu) / NULLIF(sd, 0)) > 2.0 AND fwd4 IS NOT NULL)""", block=3, seed=5310)))
def study_aggressor_imbalance(spark, sf_dir):
    w = V.by_symbol("ts")
    p = market.bars_1h(spark, sf_dir).where("volume > 0").select(
        "symbol", "ts", F.to_date("ts").alias("day"), "close", (F.col("taker_buy") / F.col("volume") - 0.5).alias("raw")
    )
    p = p.withColumns({"imb": V.full(F.avg, "raw", 4, w), "fwd4": X.forward_return(4, w=w).expr})
    p = p.withColumns({"mu": V.full(F.avg, "imb", 24, w, end=-1), "sd": V.full(F.stddev_samp, "imb", 24, w, end=-1)})
    z = F.try_divide(F.col("imb") - F.col("mu"), F.col("sd"))
    v = F.when((F.abs(z) > 2.0) & F.col("fwd4").isNotNull(), F.when(z > 0, F.col("fwd4")).otherwise(-F.col("fwd4")))
    return R.event_mean_ci(event_days(p, [Event("imbalance", v)]), block=3, seed=5310)


@query("study_settlement_drift", "E47 J5 F17", over("bars_1h", two_group(f"""
WITH s AS (SELECT symbol, ts, round(taker_buy / volume, 12) AS rate FROM bars_1h WHERE volume > 0 AND hour(ts) IN (0, 8, 16)),
 r AS (SELECT *, {percentile_rank('rate', 30, order='ts')} AS pct FROM s),
 j AS (SELECT r.symbol, CAST(r.ts AS DATE) AS day, pct, l.close / n.close - 1 AS fwd FROM r JOIN bars_1h n ON n.symbol = r.symbol AND n.ts = r.ts
   JOIN bars_1h l ON l.symbol = r.symbol AND l.ts = r.ts + INTERVAL 1 HOUR WHERE pct IS NOT NULL),
 obs AS (SELECT 'drift' AS cell, day, CASE WHEN pct >= 0.9 THEN fwd END AS a, CASE WHEN pct < 0.9 THEN fwd END AS b FROM j)""", block=3, seed=4710)))
def study_settlement_drift(spark, sf_dir):
    """Return over the hour after a settlement stamp, high readings against the rest."""
    bars = market.bars_1h(spark, sf_dir)
    stamps = bars.where((F.col("volume") > 0) & F.hour("ts").isin(0, 8, 16)).select(
        "symbol", "ts", "close", F.round(F.col("taker_buy") / F.col("volume"), 12).alias("rate")
    )
    ranked = stamps.withColumn("pct", V.trailing_percentile("rate", 30, V.by_symbol("ts"))).dropna(subset=["pct"])
    later = bars.select("symbol", (F.col("ts") - F.expr("interval 1 hour")).alias("ts"), F.col("close").alias("after"))
    j = ranked.join(later, ["symbol", "ts"]).select(
        F.to_date("ts").alias("day"), "pct", (F.col("after") / F.col("close") - 1).alias("fwd")
    )
    return R.two_group_ci(two_group_days(j, [Cell("drift", F.col("fwd"), F.col("pct") >= 0.9)]), block=3, seed=4710)


@query("study_leader_lag", "E55 J1", over("bars_1h", event_mean(_BURST + """,
 l AS (SELECT ts, day, ret AS lead_ret FROM c WHERE symbol = 'view' AND abs(ret) > 1.5 * sigma),
 x AS (SELECT symbol, ts, lead(close, 1) OVER w / close - 1 AS f1, lead(close, 4) OVER w / close - 1 AS f4 FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 j AS (SELECT l.day, lead_ret, f1, f4 FROM l JOIN x ON l.ts = x.ts WHERE x.symbol <> 'view' AND f1 IS NOT NULL AND f4 IS NOT NULL),
 ev AS (SELECT 'next1' AS cell, day, CASE WHEN lead_ret > 0 THEN f1 ELSE -f1 END AS v FROM j UNION ALL SELECT 'next4', day, CASE WHEN lead_ret > 0 THEN f4 ELSE -f4 END FROM j)""", block=3, seed=5510)))
def study_leader_lag(spark, sf_dir):
    """Followers' next one and four bars after a large leader bar."""
    w = V.by_symbol("ts")
    p = hourly(spark, sf_dir).withColumns(
        {"ret": X.ret(w=w).expr, "f1": X.forward_return(1, w=w).expr, "f4": X.forward_return(4, w=w).expr}
    ).withColumn("sigma", V.full(F.stddev_samp, "ret", 24, w, end=-1))
    lead = p.where((F.col("symbol") == LEADER) & (F.abs("ret") > 1.5 * F.col("sigma"))).select("ts", F.col("ret").alias("lead_ret"))
    j = p.where(F.col("symbol") != LEADER).dropna(subset=["f1", "f4"]).join(lead, "ts")
    sign = lambda c: F.when(F.col("lead_ret") > 0, F.col(c)).otherwise(-F.col(c))
    return R.event_mean_ci(event_days(j, [Event("next1", sign("f1")), Event("next4", sign("f4"))]), block=3, seed=5510)


@query("study_ratio_reversion", "E56 F20", over("bars_1h", event_mean(f"""
WITH p AS (SELECT 'r' AS symbol, a.ts, CAST(a.ts AS DATE) AS day, a.close AS a, b.close AS b, ln(a.close / b.close) AS lr FROM bars_1h a JOIN bars_1h b ON a.ts = b.ts WHERE a.symbol = 'click' AND b.symbol = 'view'),
 q AS (SELECT *, (lr - {rolling('avg', 'lr', 24, -1, order='ts')}) / NULLIF({rolling('stddev_samp', 'lr', 24, -1, order='ts')}, 0) AS z,
  (lead(a, 2) OVER w / a) / (lead(b, 2) OVER w / b) - 1 AS fr FROM p WINDOW w AS (ORDER BY ts)),
 ev AS (SELECT 'ratio' AS cell, day, CASE WHEN z > 0 THEN -fr ELSE fr END AS v FROM q WHERE abs(z) > 1.5 AND fr IS NOT NULL)""", block=3, seed=5610)))
def study_ratio_reversion(spark, sf_dir):
    bars = market.bars_1h(spark, sf_dir)
    a = bars.where(F.col("symbol") == "click").select("ts", F.col("close").alias("a"))
    b = bars.where(F.col("symbol") == "view").select("ts", F.col("close").alias("b"))
    w = W.partitionBy("pair").orderBy("ts")
    p = a.join(b, "ts").withColumns({"pair": F.lit("click/view"), "lr": F.log(F.try_divide("a", "b")), "day": F.to_date("ts")})
    z = F.try_divide(F.col("lr") - V.full(F.avg, "lr", 24, w, end=-1), V.full(F.stddev_samp, "lr", 24, w, end=-1))
    q = p.withColumns({"z": z, "fr": X.relative_forward_ratio(2, "a", "b", "fr", w).expr}).dropna(subset=["z", "fr"])
    v = F.when(F.abs("z") > 1.5, F.when(F.col("z") > 0, -F.col("fr")).otherwise(F.col("fr")))
    return R.event_mean_ci(event_days(q, [Event("ratio", v)]), block=3, seed=5610)


def control_points(frame, buckets: int = 20):
    """(symbol, day, poc): mid price of the price bucket with most volume; lowest bucket on ties."""
    span = F.col("day_high") - F.col("day_low")
    bucket = F.least(F.floor((F.col("close") - F.col("day_low")) / span * buckets), F.lit(buckets - 1))
    by_bucket = (
        frame.where(span > 0)
        .groupBy("symbol", "day", bucket.alias("b"))
        .agg(F.sum("volume").alias("v"), F.first("day_low").alias("lo"), F.first("day_high").alias("hi"))
    )
    best = by_bucket.groupBy("symbol", "day").agg(
        F.max_by("b", F.struct("v", (-F.col("b")).alias("nb"))).alias("b"), F.first("lo").alias("lo"), F.first("hi").alias("hi")
    )
    return best.select("symbol", "day", (F.col("lo") + (F.col("b") + 0.5) * (F.col("hi") - F.col("lo")) / buckets).alias("poc"))


_POC = _SESSION + """,
 g AS (SELECT symbol, day, least(floor((close - dl) / (dh - dl) * 20), 19) AS b, sum(volume) AS v, max(dl) AS lo, max(dh) AS hi FROM f WHERE dh > dl GROUP BY 1, 2, 3),
 pk AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY v DESC, b) AS rn FROM g),
 poc AS (SELECT symbol, day, lo + (b + 0.5) * (hi - lo) / 20 AS poc FROM pk WHERE rn = 1)"""


@query("volume_control_points", "G12", over("bars_1h", _POC + """
SELECT symbol, CAST(day AS VARCHAR) AS day, R6(poc) AS poc FROM poc"""))
def volume_control_points(spark, sf_dir):
    return control_points(session_frame(hourly(spark, sf_dir)))


@query("study_control_point_touch", "E57 G12", over("bars_1h", event_mean(_POC + """,
 days0 AS (SELECT DISTINCT symbol, CAST(ts AS DATE) AS day FROM bars_1h),
 pv AS (SELECT d.symbol, d.day, lag(p.poc) OVER (PARTITION BY d.symbol ORDER BY d.day) AS pp FROM days0 d LEFT JOIN poc p ON d.symbol = p.symbol AND d.day = p.day),
 t AS (SELECT f.*, pp, lead(close, 4) OVER (PARTITION BY f.symbol, f.day ORDER BY ts) AS c4 FROM f JOIN pv ON f.symbol = pv.symbol AND f.day = pv.day),
 u AS (SELECT symbol, day, min_by({'v': -(CASE WHEN pp > d_open THEN 1.0 ELSE -1.0 END) * (c4 / close - 1)}, ts).v AS v FROM t
  WHERE pp IS NOT NULL AND abs(pp / d_open - 1) > 0.002 AND low <= pp AND high >= pp AND i < n - 4 GROUP BY symbol, day),
 ev AS (SELECT 'poc_touch' AS cell, day, v FROM u)""", block=3, seed=5710)))
def study_control_point_touch(spark, sf_dir):
    """First bar containing the prior day's point of control, four bars on."""
    bars = hourly(spark, sf_dir)
    f = session_frame(bars)
    days = bars.select("symbol", "day").distinct()
    prev = days.join(control_points(f), ["symbol", "day"], "left").select(
        "symbol", "day", F.lag("poc").over(V.by_symbol()).alias("pp")
    )
    t = f.withColumn("c4", F.lead("close", 4).over(day_window().orderBy("ts"))).join(prev, ["symbol", "day"])
    touch = t.where(
        (F.abs(F.try_divide("pp", "day_open") - 1) > 0.002) & (F.col("low") <= F.col("pp")) & (F.col("high") >= F.col("pp"))
        & (F.col("i") < F.col("n") - 4)
    )
    approach = F.when(F.col("pp") > F.col("day_open"), 1.0).otherwise(-1.0)
    u = touch.groupBy("symbol", "day").agg(F.min_by(F.struct((-approach * (F.col("c4") / F.col("close") - 1)).alias("v")), "ts").alias("e"))
    days_v = event_days(u.select("day", F.col("e.v").alias("v")), [Event("poc_touch", F.col("v"))])
    return R.event_mean_ci(days_v, block=3, seed=5710)


def fade_days(frame, maker: float = 0.0002, taker: float = 0.00065):
    """(symbol, day, filled, ret): first-hour fade with a one-bar limit fill.

    The order rests at the first hour's close and fills only if the next bar trades through;
    an unfilled day earns zero.
    """
    second = frame.where("ok_open and i = 1")
    r0 = F.try_divide("open_last", "open_first") - 1
    side = F.when(r0 > 0, -1.0).otherwise(1.0)
    filled = F.when(side > 0, F.col("low") <= F.col("open_last")).otherwise(F.col("high") >= F.col("open_last"))
    gross = side * (F.try_divide("day_close", "open_last") - 1)
    return second.where(r0 != 0).select(
        "symbol", "day", filled.alias("filled"), F.when(filled, gross - maker - taker).otherwise(0.0).alias("ret")
    )


_FADE = _SESSION + """,
 s AS (SELECT symbol, day, CASE WHEN o_last > o_first THEN high >= o_last ELSE low <= o_last END AS filled,
  (CASE WHEN o_last > o_first THEN -1.0 ELSE 1.0 END) * (d_close / o_last - 1) AS gross FROM f WHERE n_open = 1 AND i = 1 AND o_last <> o_first),
 dd AS (SELECT 'book' AS symbol, day, avg(CASE WHEN filled THEN gross - 0.0002 - 0.00065 ELSE 0.0 END) AS ret, count(*) AS signals, count(*) FILTER (WHERE filled) AS fills FROM s GROUP BY day)"""


@query("fade_exposures", "P17", over("bars_1h", f"""
WITH b AS (SELECT symbol, ts, CAST(ts AS DATE) AS day, hour(ts) AS hh, open, high, low, close FROM bars_1h),
 f AS (SELECT *, count(*) OVER d AS n, count(*) FILTER (WHERE hh < 1) OVER d AS n_open, max(high) FILTER (WHERE hh < 1) OVER d AS oh, min(low) FILTER (WHERE hh < 1) OVER d AS ol,
  min(open) FILTER (WHERE hh < 1) OVER d AS fo, min(close) FILTER (WHERE hh < 1) OVER d AS fc FROM b WINDOW d AS (PARTITION BY symbol, day)),
 k AS (SELECT *, CASE WHEN n_open = 1 AND hh BETWEEN 1 AND 5 AND close > oh THEN -1.0 WHEN n_open = 1 AND hh BETWEEN 1 AND 5 AND close < ol THEN 1.0 END AS brk FROM f WHERE n >= {MIN_BARS})
SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(day AS VARCHAR) AS day, hh,
 R6(CASE WHEN hh >= 23 THEN 0.0 ELSE coalesce(first_value(brk IGNORE NULLS) OVER (PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING), 0.0) END) AS fade_range,
 R6(CASE WHEN hh >= 23 OR n_open <> 1 THEN 0.0 ELSE -sign(fc - fo) END) AS fade_hour FROM k"""))
def fade_exposures(spark, sf_dir):
    """Exposures against the first break of the opening range and against the first hour."""
    return S.fade_exposure(session_frame(hourly(spark, sf_dir)))


@query("fade_book_daily", "E52 F25", over("bars_1h", _FADE + f""",
 v AS (SELECT *, {rolling('stddev_samp', 'ret', 10, -1)} AS sd FROM dd)
SELECT CAST(day AS VARCHAR) AS day, signals, fills, R6(ret) AS ret, R6(greatest(least(0.30 / NULLIF(sd * sqrt(365), 0), 1.0), 0.0)) AS scale,
 R6(ret * greatest(least(0.30 / NULLIF(sd * sqrt(365), 0), 1.0), 0.0)) AS scaled FROM v WHERE sd IS NOT NULL AND sd > 0"""))
def fade_book_daily(spark, sf_dir):
    """Daily mean of the fade, scaled to a volatility target on returns before the day."""
    d = fade_days(session_frame(hourly(spark, sf_dir)))
    daily = d.groupBy("day").agg(
        F.avg("ret").alias("ret"), F.count(F.lit(1)).alias("signals"), F.count_if(F.col("filled")).alias("fills")
    ).withColumn("symbol", F.lit("book"))
    sd = V.full(F.stddev_samp, "ret", 10, end=-1)
    scaled = daily.withColumn("scale", F.greatest(F.least(F.try_divide(F.lit(0.30), sd * F.sqrt(F.lit(365.0))), F.lit(1.0)), F.lit(0.0)))
    scaled = scaled.withColumn("sd", sd).where("sd > 0")
    return scaled.select("day", "signals", "fills", "ret", "scale", (F.col("ret") * F.col("scale")).alias("scaled"))
