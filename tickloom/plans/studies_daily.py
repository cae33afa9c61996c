"""Daily and weekly event studies: panel, condition, day sums, resampled interval."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import features as X
from tickloom.functions import windows as V
from tickloom.operators import bars as B
from tickloom.operators import bootstrap as R
from tickloom.operators import crosssection as K
from tickloom.operators.cells import Cell, Event, event_days, two_group_days
from tickloom.plans.oracle import daily_mean, event_mean, over, percentile_rank, rolling, two_group
from tickloom.registry import query
from tickloom.session import settled
from tickloom.sources import market

HORIZONS = (1, 7, 30)


def _obs(*parts: tuple[str, str, str, str]) -> str:
    """``obs`` CTE from (cell, source, a condition => value, b condition => value)."""
    return "obs AS (" + " UNION ALL ".join(
        f"SELECT '{cell}' AS cell, day, {a} AS a, {b} AS b FROM {src}" for cell, src, a, b in parts
    ) + ")"


def _case(cond: str, y: str) -> str:
    return f"CASE WHEN {cond} THEN {y} END"


# --- funding and basis extremes -------------------------------------------------------------


def extremes_panel(series, closes, value: str, window: int = 90):
    """Join a daily series to closes, rank it over its trailing window, add forward returns."""
    panel = series.join(closes.select("symbol", "day", "close"), ["symbol", "day"])
    panel = panel.withColumn("pct", V.trailing_percentile(value, window))
    panel = panel.withColumns({f.name: f.expr for f in map(X.forward_return, HORIZONS)})
    return panel.dropna(subset=["pct", "fwd7"])


def extreme_cells():
    return [
        Cell(f"fwd{h}", F.col(f"fwd{h}"), F.col("pct") <= 0.10, F.col("pct") >= 0.90, F.col(f"fwd{h}").isNotNull())
        for h in HORIZONS
    ]


def funding_panel(spark, sf_dir):
    daily = B.funding_by_day(market.funding(spark, sf_dir)).withColumn("funding", F.round("funding", 12))
    return extremes_panel(daily, market.walk_1d(spark, sf_dir), "funding")


def basis_panel(spark, sf_dir):
    legs = market.spot_perp_1d(spark, sf_dir).select(
        "symbol", "day", F.round(F.try_divide("perp_close", "close") - 1, 12).alias("basis")
    )
    return extremes_panel(legs, market.walk_1d(spark, sf_dir), "basis")


_EXT_TAIL = """,
 p AS (SELECT *, {pct} AS pct, lead(close, 1) OVER w / close - 1 AS fwd1, lead(close, 7) OVER w / close - 1 AS fwd7, lead(close, 30) OVER w / close - 1 AS fwd30
  FROM j WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 p2 AS (SELECT * FROM p WHERE pct IS NOT NULL AND fwd7 IS NOT NULL)"""
_EXT_OBS = ", " + _obs(*[(f"fwd{h}", f"p2 WHERE fwd{h} IS NOT NULL", _case("pct <= 0.10", f"fwd{h}"), _case("pct >= 0.90", f"fwd{h}")) for h in HORIZONS])
_FUND = """WITH d AS (SELECT symbol, day, round(sum(rate), 12) AS x FROM funding GROUP BY symbol, day),
 j AS (SELECT d.symbol, d.day, d.x, w.close FROM d JOIN walk_1d w ON d.symbol = w.symbol AND d.day = w.day)""" + _EXT_TAIL.format(pct=percentile_rank("x", 90))
_BASIS = """WITH d AS (SELECT b.symbol, b.day, round(p.perp_close / b.close - 1, 12) AS x FROM bars_1d b JOIN perp_1d p ON b.symbol = p.symbol AND b.day = p.day),
 j AS (SELECT d.symbol, d.day, d.x, w.close FROM d JOIN walk_1d w ON d.symbol = w.symbol AND d.day = w.day)""" + _EXT_TAIL.format(pct=percentile_rank("x", 90))


@query("study_funding_extremes", "E08 F4 F17 G1 J1 R1 R2 B8", over("funding walk_1d", two_group(_FUND + _EXT_OBS, seed=8)))
def study_funding_extremes(spark, sf_dir):
    return R.two_group_ci(two_group_days(funding_panel(spark, sf_dir), extreme_cells()), seed=8)


@query("study_basis_extremes", "E10 F24 F17", over("bars_1d perp_1d walk_1d", two_group(_BASIS + _EXT_OBS, seed=10)))
def study_basis_extremes(spark, sf_dir):
    return R.two_group_ci(two_group_days(basis_panel(spark, sf_dir), extreme_cells()), seed=10)


def symbol_consistency(panel, y: str, a, b, pooled):
    """(symbol, diff, agrees): each symbol's own effect and whether its sign matches ``pooled``."""
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col(y))), F.lit(0.0))
    per = panel.groupBy("symbol").agg((mean(a) - mean(b)).alias("diff"))
    return per.withColumn("agrees", F.signum("diff") == F.signum(F.lit(pooled)))


@query("basis_symbol_consistency", "G8 E10", over("bars_1d perp_1d walk_1d", _BASIS + """
SELECT symbol, R6(coalesce(avg(CASE WHEN pct <= 0.10 THEN fwd7 END), 0) - coalesce(avg(CASE WHEN pct >= 0.90 THEN fwd7 END), 0)) AS diff,
 sign(coalesce(avg(CASE WHEN pct <= 0.10 THEN fwd7 END), 0) - coalesce(avg(CASE WHEN pct >= 0.90 THEN fwd7 END), 0)) = 1 AS agrees
FROM p2 GROUP BY symbol"""))
def basis_symbol_consistency(spark, sf_dir):
    return symbol_consistency(basis_panel(spark, sf_dir), "fwd7", F.col("pct") <= 0.10, F.col("pct") >= 0.90, 1.0)


@query("funding_gross_premium", "E05", over("funding", """
SELECT symbol, count(*) AS stamps, R6(1000000 * avg(rate)) AS mean_rate_ppm, R6(avg(rate) * 3 * 365) AS annualised FROM funding GROUP BY symbol"""))
def funding_gross_premium(spark, sf_dir):
    """Mean settlement rate and its annualisation (three settlements a day)."""
    return market.funding(spark, sf_dir).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("stamps"),
        (F.avg("rate") * 1e6).alias("mean_rate_ppm"),
        (F.avg("rate") * 3 * 365).alias("annualised"),
    )


# --- calendar ---------------------------------------------------------------------------------


@query("study_calendar", "E09a-c B9 S4", over("walk_1d", two_group("""
WITH d AS (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM walk_1d), """ + _obs(
    ("turn_of_month", "d WHERE ret IS NOT NULL", _case("day(day) <= 2 OR day(day) >= day(last_day(day)) - 1", "ret"), _case("NOT (day(day) <= 2 OR day(day) >= day(last_day(day)) - 1)", "ret")),
    ("weekend", "d WHERE ret IS NOT NULL", _case("isodow(day) >= 6", "ret"), _case("isodow(day) < 6", "ret")),
), seed=9)))
def study_calendar(spark, sf_dir):
    """Turn of month and weekend on daily returns."""
    daily = X.panel(market.walk_1d(spark, sf_dir), [], base=("symbol", "day", "ret"), drop_nulls=["ret"])
    y = F.col("ret")
    days = two_group_days(
        B.calendar_flags(daily), [Cell("turn_of_month", y, F.col("turn_of_month")), Cell("weekend", y, F.col("weekend"))]
    )
    return R.two_group_ci(days, seed=9)


@query("study_sessions", "E09a-c E20 A4 B9", over("bars_1h", two_group("""
WITH h AS (SELECT symbol, ts, CAST(ts AS DATE) AS day, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars_1h), """ + _obs(
    ("settlement_hours", "h WHERE ret IS NOT NULL", _case("hour(ts) IN (0, 8, 16)", "ret"), _case("hour(ts) NOT IN (0, 8, 16)", "ret")),
    *[(f"session{i}", "h WHERE ret IS NOT NULL", _case(f"hour(ts) // 8 = {i}", "ret"), _case(f"hour(ts) // 8 <> {i}", "ret")) for i in range(3)],
), block=5, seed=9)))
def study_sessions(spark, sf_dir):
    """Settlement hours and the three sessions on hourly returns (thirty days: short blocks)."""
    hourly = B.intraday(market.bars_1h(spark, sf_dir))
    hourly = hourly.withColumn("ret", X.ret(w=V.by_symbol("ts")).expr).dropna(subset=["ret"])
    y = F.col("ret")
    cells = [Cell("settlement_hours", y, F.col("hh").isin(0, 8, 16))] + [Cell(f"session{i}", y, F.col("session") == i) for i in range(3)]
    return R.two_group_ci(two_group_days(hourly, cells), block=5, seed=9)


# --- shocks and breakouts ---------------------------------------------------------------------


def shock_panel(spark, sf_dir):
    panel = X.panel(
        market.walk_1d(spark, sf_dir),
        [[X.vol_before(30, "vol30"), X.vol_before(10, "vol10")], [X.forward_return(7), X.Feature("vol10_pct", V.trailing_percentile("vol10", 365, skip_nulls=True))]],
        base=("symbol", "day", "ret", "close"),
        drop_nulls=["ret", "vol30", "fwd7"],
    )
    return panel.withColumns({"z": F.try_divide("ret", "vol30"), "dir7": F.col("fwd7") * F.signum("ret")})


_SHOCK = f"""WITH a AS (SELECT symbol, day, close, close / lag(close) OVER w - 1 AS ret, lead(close, 7) OVER w / close - 1 AS fwd7 FROM walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 b AS (SELECT *, {rolling('stddev_samp', 'ret', 30, -1)} AS vol30, {rolling('stddev_samp', 'ret', 10, -1)} AS vol10 FROM a),
 b2 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS rn,
   list(vol10) FILTER (WHERE vol10 IS NOT NULL) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 365 PRECEDING AND CURRENT ROW) AS l FROM b),
 c AS (SELECT *, ret / NULLIF(vol30, 0) AS z, fwd7 * sign(ret) AS dir7,
   CASE WHEN rn > 365 AND vol10 IS NOT NULL THEN CAST(len(list_filter(l, lambda v: v <= vol10)) AS DOUBLE) / len(l) END AS vp
   FROM b2 WHERE ret IS NOT NULL AND vol30 IS NOT NULL AND fwd7 IS NOT NULL)"""


@query("study_shock_persistence", "E13 F7", over("walk_1d", two_group(_SHOCK + ", " + _obs(
    ("extreme_up", "c", _case("z >= 2", "fwd7"), _case("abs(z) < 1", "fwd7")),
    ("moderate_up", "c", _case("z >= 1 AND z < 2", "fwd7"), _case("abs(z) < 1", "fwd7")),
    ("moderate_down", "c", _case("z > -2 AND z <= -1", "fwd7"), _case("abs(z) < 1", "fwd7")),
    ("extreme_down", "c", _case("z <= -2", "fwd7"), _case("abs(z) < 1", "fwd7")),
), seed=13)))
def study_shock_persistence(spark, sf_dir):
    z, y = F.col("z"), F.col("fwd7")
    quiet = F.abs(z) < 1
    cells = [
        Cell("extreme_up", y, z >= 2, quiet),
        Cell("moderate_up", y, (z >= 1) & (z < 2), quiet),
        Cell("moderate_down", y, (z > -2) & (z <= -1), quiet),
        Cell("extreme_down", y, z <= -2, quiet),
    ]
    return R.two_group_ci(two_group_days(shock_panel(spark, sf_dir), cells), seed=13)


@query("study_compression_breakout", "E14 F17 S5", over("walk_1d", two_group(_SHOCK + ", " + _obs(
    ("increment", "c WHERE vol10 IS NOT NULL AND vp IS NOT NULL", _case("abs(ret) > 2 * vol10 AND vp <= 0.20", "dir7"), _case("abs(ret) > 2 * vol10 AND vp > 0.20", "dir7"))), seed=141)))
def study_compression_breakout(spark, sf_dir):
    """Breakout after compression against breakout without it."""
    trigger = F.abs("ret") > 2 * F.col("vol10")
    tight = F.col("vol10_pct") <= 0.20
    scope = F.col("vol10").isNotNull() & F.col("vol10_pct").isNotNull()
    cell = Cell("increment", F.col("dir7"), trigger & tight, trigger & ~tight, scope)
    return R.two_group_ci(two_group_days(shock_panel(spark, sf_dir), [cell]), seed=141)


@query("study_compression_events", "E14 R4", over("walk_1d", event_mean(_SHOCK + """,
 ev AS (SELECT 'breakout' AS cell, day, CASE WHEN abs(ret) > 2 * vol10 AND vp <= 0.20 THEN dir7 END AS v FROM c)""", block=5, seed=14)))
def study_compression_events(spark, sf_dir):
    hit = (F.abs("ret") > 2 * F.col("vol10")) & (F.col("vol10_pct") <= 0.20)
    days = event_days(shock_panel(spark, sf_dir), [Event("breakout", F.when(hit, F.col("dir7")))])
    return R.event_mean_ci(days, block=5, seed=14)


# --- weekly cross-section: crashes, angels, overextension, lead-lag, conviction ----------------


def swing_panel(spark, sf_dir):
    return X.panel(
        market.walk_wk(spark, sf_dir),
        [
            [
                X.momentum(7), X.momentum(14), X.momentum(30), X.vol_before(10, "vol10"),
                X.rolling_mean("close", 20, "ma"), X.rolling_max("close", 52, "peak"),
                X.rolling_mean("volume", 7, "v7"), X.rolling_mean("volume", 30, "v30"),
                X.forward_return(1), X.forward_return(7), X.forward_return(30),
            ],
            [X.Feature("vol10_ago", X.lag("vol10", 7)), X.Feature("stretch", F.try_divide("close", "ma") - 1)],
        ],
        base=("symbol", "day", "close", "volume", "ret"),
    )


_SWING = f"""WITH a AS (SELECT symbol, day, close, volume, close / lag(close) OVER w - 1 AS ret, close / lag(close, 7) OVER w - 1 AS r7, close / lag(close, 14) OVER w - 1 AS r14,
  close / lag(close, 30) OVER w - 1 AS r30, lead(close, 1) OVER w / close - 1 AS fwd1, lead(close, 7) OVER w / close - 1 AS fwd7, lead(close, 30) OVER w / close - 1 AS fwd30
  FROM walk_wk WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 b AS (SELECT *, {rolling('stddev_samp', 'ret', 10, -1)} AS vol10, {rolling('avg', 'close', 20)} AS ma, {rolling('max', 'close', 52)} AS peak,
  {rolling('avg', 'volume', 7)} AS v7, {rolling('avg', 'volume', 30)} AS v30 FROM a),
 c AS (SELECT *, lag(vol10, 7) OVER (PARTITION BY symbol ORDER BY day) AS vol10_ago, close / NULLIF(ma, 0) - 1 AS stretch FROM b)"""

CRASH = -0.04
ANGEL_DROP, ANGEL_RISE = -0.04, 0.02


@query("study_swings", "E15 E17 F9 F10", over("walk_wk", two_group(_SWING + ", " + _obs(
    ("crash", "c WHERE r7 IS NOT NULL AND fwd7 IS NOT NULL", _case(f"r7 <= {CRASH}", "fwd7"), _case(f"r7 > {CRASH}", "fwd7")),
    ("crash_vol_falling", f"c WHERE r7 <= {CRASH} AND fwd7 IS NOT NULL AND vol10 IS NOT NULL AND vol10_ago IS NOT NULL", _case("vol10 < vol10_ago", "fwd7"), _case("vol10 >= vol10_ago", "fwd7")),
    ("fallen_angel", "c WHERE peak IS NOT NULL AND r14 IS NOT NULL AND fwd30 IS NOT NULL",
     _case(f"close / peak - 1 <= {ANGEL_DROP} AND r14 >= {ANGEL_RISE}", "fwd30"), _case(f"NOT (close / peak - 1 <= {ANGEL_DROP} AND r14 >= {ANGEL_RISE})", "fwd30")),
), seed=151)))
def study_swings(spark, sf_dir):
    """Crash bounce, its split by falling or rising volatility, and fallen angels."""
    crash = F.col("r7") <= CRASH
    base = F.col("r7").isNotNull() & F.col("fwd7").isNotNull()
    angel = (F.try_divide("close", "peak") - 1 <= ANGEL_DROP) & (F.col("r14") >= ANGEL_RISE)
    vols = F.col("vol10").isNotNull() & F.col("vol10_ago").isNotNull()
    cells = [
        Cell("crash", F.col("fwd7"), crash, None, base),
        Cell("crash_vol_falling", F.col("fwd7"), F.col("vol10") < F.col("vol10_ago"), None, base & crash & vols),
        Cell("fallen_angel", F.col("fwd30"), angel, None,
             F.col("peak").isNotNull() & F.col("r14").isNotNull() & F.col("fwd30").isNotNull()),
    ]
    return R.two_group_ci(two_group_days(swing_panel(spark, sf_dir), cells), seed=151)


@query("study_overextension", "E18 F17", over("walk_wk", two_group(_SWING + f""",
 s AS (SELECT * FROM c WHERE ma IS NOT NULL AND fwd7 IS NOT NULL AND fwd30 IS NOT NULL),
 t AS (SELECT *, {percentile_rank('stretch', 52)} AS spct FROM s), """ + _obs(
    ("fwd7", "t WHERE spct IS NOT NULL", _case("spct >= 0.95", "fwd7"), _case("spct < 0.95", "fwd7")),
    ("fwd30", "t WHERE spct IS NOT NULL", _case("spct >= 0.95", "fwd30"), _case("spct < 0.95", "fwd30")),
), seed=181)))
def study_overextension(spark, sf_dir):
    p = swing_panel(spark, sf_dir).dropna(subset=["ma", "fwd7", "fwd30"])
    p = p.withColumn("spct", V.trailing_percentile("stretch", 52)).dropna(subset=["spct"])
    hot = F.col("spct") >= 0.95
    return R.two_group_ci(two_group_days(p, [Cell("fwd7", F.col("fwd7"), hot), Cell("fwd30", F.col("fwd30"), hot)]), seed=181)


@query("study_leader_follower", "E19 J2", over("walk_wk", two_group(_SWING + """,
 m AS (SELECT day, ret AS mkt FROM c WHERE symbol = 'P0'),
 s AS (SELECT c.*, mkt FROM c JOIN m ON c.day = m.day WHERE symbol <> 'P0' AND fwd1 IS NOT NULL), """ + _obs(
    ("leader_up", "s", _case("mkt > 0.02", "fwd1"), _case("abs(mkt) < 0.005", "fwd1")),
    ("leader_down", "s", _case("mkt < -0.02", "fwd1"), _case("abs(mkt) < 0.005", "fwd1"))), seed=191)))
def study_leader_follower(spark, sf_dir):
    p = swing_panel(spark, sf_dir)
    leader = p.where(F.col("symbol") == "P0").select("day", F.col("ret").alias("mkt"))
    s = p.where((F.col("symbol") != "P0") & F.col("fwd1").isNotNull()).join(leader, "day")
    quiet, y = F.abs("mkt") < 0.005, F.col("fwd1")
    cells = [Cell("leader_up", y, F.col("mkt") > 0.02, quiet), Cell("leader_down", y, F.col("mkt") < -0.02, quiet)]
    return R.two_group_ci(two_group_days(s, cells), seed=191)


@query("study_acceleration", "E16 K2", over("walk_wk", daily_mean(_SWING + """,
 q AS (SELECT *, r7 - (r30 - r7) AS accel FROM c WHERE r7 IS NOT NULL AND r30 IS NOT NULL AND fwd7 IS NOT NULL),
 l AS (SELECT 'r7' AS cell, day, symbol, r7 AS x, fwd7 AS y FROM q UNION ALL SELECT 'accel', day, symbol, accel, fwd7 FROM q UNION ALL SELECT 'r30', day, symbol, r30, fwd7 FROM q),
 rk AS (SELECT cell, day, y, row_number() OVER (PARTITION BY cell, day ORDER BY x, symbol) AS lo, row_number() OVER (PARTITION BY cell, day ORDER BY x DESC, symbol DESC) AS hi, count(*) OVER (PARTITION BY cell, day) AS n FROM l),
 days AS (SELECT cell, day, sum(CASE WHEN hi <= 2 THEN y END) / 2 - sum(CASE WHEN lo <= 2 THEN y END) / 2 AS v FROM rk WHERE n >= 10 GROUP BY cell, day)""", seed=161)))
def study_acceleration(spark, sf_dir):
    p = swing_panel(spark, sf_dir).dropna(subset=["r7", "r30", "fwd7"])
    p = p.withColumn("accel", F.col("r7") - (F.col("r30") - F.col("r7")))
    return R.daily_mean_ci(K.ranking_spreads(p, {c: {"by": c} for c in ("r7", "accel", "r30")}), seed=161)


@query("study_volume_conviction", "E21 K3", over("walk_wk", two_group(_SWING + """,
 q AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY r30 DESC, symbol DESC) AS hi, count(*) OVER (PARTITION BY day) AS n FROM c
  WHERE r30 IS NOT NULL AND fwd7 IS NOT NULL AND v7 IS NOT NULL AND v30 IS NOT NULL), """ + _obs(
    ("volume_up", "q WHERE n >= 10 AND hi <= 2", _case("v7 > v30", "fwd7"), _case("v7 <= v30", "fwd7"))), seed=211)))
def study_volume_conviction(spark, sf_dir):
    p = swing_panel(spark, sf_dir).dropna(subset=["r30", "fwd7", "v7", "v30"])
    picks = K.top_k(p, "r30", 2, min_symbols=10)
    return R.two_group_ci(two_group_days(picks, [Cell("volume_up", F.col("fwd7"), F.col("v7") > F.col("v30"))]), seed=211)


@query("study_relative_strength", "E11 K2 J3", over("walk_wk", daily_mean("""
WITH cal AS (SELECT day, row_number() OVER (ORDER BY day) AS o FROM (SELECT DISTINCT day FROM walk_wk) d),
 p AS (SELECT w.symbol, w.day, w.close, c.o FROM walk_wk w JOIN cal c ON w.day = c.day),
 l AS (SELECT 'L' || k.n AS cell, a.day, a.symbol, a.close / b.close - 1 AS x, f.close / a.close - 1 AS y FROM p a, (VALUES (30), (90)) k(n), p b, p f
  WHERE b.symbol = a.symbol AND b.o = a.o - k.n AND f.symbol = a.symbol AND f.o = a.o + 7),
 rk AS (SELECT cell, day, y, row_number() OVER (PARTITION BY cell, day ORDER BY x, symbol) AS lo, row_number() OVER (PARTITION BY cell, day ORDER BY x DESC, symbol DESC) AS hi, count(*) OVER (PARTITION BY cell, day) AS n FROM l),
 days AS (SELECT cell, day, sum(CASE WHEN hi <= 2 THEN y END) / 2 - sum(CASE WHEN lo <= 2 THEN y END) / 2 AS v FROM rk WHERE n >= 6 GROUP BY cell, day)""", seed=11)))
def study_relative_strength(spark, sf_dir):
    """Spread by lookback on the union timeline: lags count calendar rows, not own bars."""
    p = B.with_ordinal(market.walk_wk(spark, sf_dir).select("symbol", "day", "close"))
    at = lambda n: B.union_lag(p, "close", n)
    p = p.select(
        "symbol", "day",
        (F.try_divide(F.col("close"), at(30)) - 1).alias("L30"),
        (F.try_divide(F.col("close"), at(90)) - 1).alias("L90"),
        (F.try_divide(at(-7), F.col("close")) - 1).alias("fwd7"),
    )
    specs = {c: {"by": c, "min_symbols": 6} for c in ("L30", "L90")}
    return R.daily_mean_ci(K.ranking_spreads(p, specs), seed=11)


# --- weekly cross-section: blends, dials, stops -------------------------------------------------


def trend_panel(spark, sf_dir):
    return X.panel(
        market.walk_wk(spark, sf_dir),
        [
            [X.momentum(30), X.momentum(60), X.momentum(90), X.rolling_max("close", 30, "hi30"), X.true_range(),
             X.forward_return(7), X.forward_return(30)],
            [X.rolling_mean("tr", 14, "atr14")],
        ],
        base=("symbol", "day", "close", "high", "low", "ret"),
    )


_TREND = f"""WITH a AS (SELECT symbol, day, close, close / lag(close) OVER w - 1 AS ret, close / lag(close, 30) OVER w - 1 AS r30, close / lag(close, 60) OVER w - 1 AS r60,
  close / lag(close, 90) OVER w - 1 AS r90, lead(close, 7) OVER w / close - 1 AS fwd7, lead(close, 30) OVER w / close - 1 AS fwd30,
  greatest(high - low, abs(high - coalesce(lag(close) OVER w, high)), abs(low - coalesce(lag(close) OVER w, low))) AS tr FROM walk_wk WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 c AS (SELECT *, {rolling('max', 'close', 30)} AS hi30, {rolling('avg', 'tr', 14)} AS atr14 FROM a)"""


@query("study_momentum_blend", "E33 G7 S2", over("walk_wk", two_group(_TREND + """,
 s AS (SELECT *, CAST(r30 > 0 AS INT) + CAST(r60 > 0 AS INT) + CAST(r90 > 0 AS INT) AS score FROM c WHERE r30 IS NOT NULL AND r60 IS NOT NULL AND r90 IS NOT NULL AND fwd7 IS NOT NULL), """ + _obs(
    ("all_agree", "s WHERE score >= 1", _case("score = 3", "fwd7"), _case("score < 3", "fwd7"))), seed=3310)))
def study_momentum_blend(spark, sf_dir):
    s = scored(trend_panel(spark, sf_dir)).where("score >= 1")
    return R.two_group_ci(two_group_days(s, [Cell("all_agree", F.col("fwd7"), F.col("score") == 3)]), seed=3310)


def scored(p):
    up = lambda c: (F.col(c) > 0).cast("int")
    return p.dropna(subset=["r30", "r60", "r90", "fwd7"]).withColumn("score", up("r30") + up("r60") + up("r90"))


@query("score_bucket_means", "G7 E33", over("walk_wk", _TREND + """
SELECT CAST(r30 > 0 AS INT) + CAST(r60 > 0 AS INT) + CAST(r90 > 0 AS INT) AS score, count(*) AS n, R6(avg(fwd7)) AS mean_fwd7 FROM c
WHERE r30 IS NOT NULL AND r60 IS NOT NULL AND r90 IS NOT NULL AND fwd7 IS NOT NULL GROUP BY 1"""))
def score_bucket_means(spark, sf_dir):
    return scored(trend_panel(spark, sf_dir)).groupBy("score").agg(
        F.count(F.lit(1)).alias("n"), F.avg("fwd7").alias("mean_fwd7")
    )


@query("study_short_leg", "E36 J2", over("walk_wk", two_group(_TREND + """,
 q AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY r90, symbol) AS lo, count(*) OVER (PARTITION BY day) AS n FROM c WHERE r90 IS NOT NULL AND fwd7 IS NOT NULL), """ + _obs(
    ("bottom2", "q", _case("n >= 10 AND lo <= 2", "fwd7"), _case("NOT (n >= 10 AND lo <= 2)", "fwd7"))), seed=3610)))
def study_short_leg(spark, sf_dir):
    """Bottom-two names against the rest; the flag is a window column, not a join back."""
    q = trend_panel(spark, sf_dir).dropna(subset=["r90", "fwd7"])
    q = K.ranked(q, "r90").withColumn("bottom", (F.col("breadth") >= 10) & (F.col("lo") <= 2))
    return R.two_group_ci(two_group_days(q, [Cell("bottom2", F.col("fwd7"), F.col("bottom"))]), seed=3610)


@query("study_trailing_stop", "E40 F11 F12", over("walk_wk", two_group(_TREND + ", " + _obs(
    ("fired", "c WHERE r90 > 0 AND atr14 IS NOT NULL AND hi30 IS NOT NULL AND fwd30 IS NOT NULL", _case("hi30 - close >= 2.0 * atr14", "fwd30"), _case("hi30 - close < 2.0 * atr14", "fwd30"))), seed=4010)))
def study_trailing_stop(spark, sf_dir):
    p = trend_panel(spark, sf_dir).dropna(subset=["r90", "atr14", "hi30", "fwd30"]).where("r90 > 0")
    fired = F.col("hi30") - F.col("close") >= 2.0 * F.col("atr14")
    return R.two_group_ci(two_group_days(p, [Cell("fired", F.col("fwd30"), fired)]), seed=4010)


def pair_correlation(panel, picks, window: int = 90, least: int = 60):
    """(day, corr): trailing correlation of the day's two picks over the union timeline.

    Each day's pair is expanded to its trailing ``window`` timeline rows and both names' returns
    are fetched by equi-join, so only picked pairs are touched, never all pairs.
    """
    placed = B.with_ordinal(panel.select("symbol", "day", "ret")).drop("day")
    pair = picks.groupBy("day").agg(F.min("symbol").alias("a"), F.max("symbol").alias("b"))
    days = B.with_ordinal(panel.select("symbol", "day")).select("day", "ord").distinct()
    back = pair.join(days, "day").where(F.col("ord") > window).select(
        "day", "a", "b", F.explode(F.sequence(F.col("ord") - window + 1, F.col("ord"))).alias("ord")
    )
    x = placed.select(F.col("symbol").alias("a"), "ord", F.col("ret").alias("x"))
    y = placed.select(F.col("symbol").alias("b"), "ord", F.col("ret").alias("y"))
    both = back.join(x, ["a", "ord"]).join(y, ["b", "ord"]).dropna(subset=["x", "y"])
    return both.groupBy("day").agg(
        F.when(F.count(F.lit(1)) >= least, F.corr("x", "y")).alias("pick_corr")
    )


def daily_dials(p):
    """(day, top2, breadth, dispersion, spread, pick_corr): the cross-section of each day.

    Days with fewer than ten names are left out, so dispersion and spread are always defined.
    """
    p, _ = settled(p)
    base = p.dropna(subset=["r90", "fwd7"])
    r = K.ranked(base, "r90", min_symbols=10)
    day = W.partitionBy("day")
    r = r.withColumns(
        {
            "lo30": F.row_number().over(day.orderBy("r30", "symbol")),
            "n30": F.count("r30").over(day),
        }
    )
    hi30 = F.col("n30") - F.col("lo30") + 1
    stats = r.groupBy("day").agg(
        F.avg(F.when(F.col("hi") <= 2, F.col("fwd7"))).alias("top2"),
        F.avg((F.col("r90") > 0).cast("double")).alias("breadth"),
        F.stddev_samp("r30").alias("dispersion"),
        (F.avg(F.when(hi30 <= 2, F.col("fwd7"))) - F.avg(F.when(F.col("lo30") <= 2, F.col("fwd7")))).alias("spread"),
    )
    corr = pair_correlation(p, r.where("hi <= 2").select("day", "symbol"))
    return stats.join(corr, "day", "left")


_DIALS = _TREND + """,
 q AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY r90 DESC, symbol DESC) AS hi, row_number() OVER (PARTITION BY day ORDER BY r30, symbol) AS lo30,
  row_number() OVER (PARTITION BY day ORDER BY r30 DESC, symbol DESC) AS h30, count(*) OVER (PARTITION BY day) AS n FROM c WHERE r90 IS NOT NULL AND fwd7 IS NOT NULL),
 st AS (SELECT day, avg(CASE WHEN hi <= 2 THEN fwd7 END) AS top2, avg(CASE WHEN r90 > 0 THEN 1.0 ELSE 0.0 END) AS breadth, stddev_samp(r30) AS dispersion,
  avg(CASE WHEN h30 <= 2 THEN fwd7 END) - avg(CASE WHEN lo30 <= 2 THEN fwd7 END) AS spread, min(symbol) FILTER (WHERE hi <= 2) AS pa, max(symbol) FILTER (WHERE hi <= 2) AS pb FROM q WHERE n >= 10 GROUP BY day),
 cal AS (SELECT day, row_number() OVER (ORDER BY day) AS o FROM (SELECT DISTINCT day FROM c) d),
 pc AS (SELECT s.day, CASE WHEN count(*) >= 60 THEN corr(x.ret, y.ret) END AS pick_corr FROM st s JOIN cal k ON s.day = k.day JOIN cal k2 ON k2.o BETWEEN k.o - 89 AND k.o
   JOIN c x ON x.symbol = s.pa AND x.day = k2.day JOIN c y ON y.symbol = s.pb AND y.day = k2.day WHERE k.o > 90 AND x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY s.day),
 dl AS (SELECT s.*, pc.pick_corr FROM st s LEFT JOIN pc ON s.day = pc.day)"""


@query("daily_dials", "G6 F19 E37-E39 J4", over("walk_wk", _DIALS + """
SELECT CAST(day AS VARCHAR) AS day, R6(top2) AS top2, R6(breadth) AS breadth, R6(dispersion) AS dispersion, R6(spread) AS spread, R6(pick_corr) AS pick_corr FROM dl"""))
def daily_dials_query(spark, sf_dir):
    return daily_dials(trend_panel(spark, sf_dir))


def tercile_days(dials, dial: str, y: str):
    """Top against bottom third of days by ``dial``; the cut points are exact, linear quantiles."""
    d = dials.dropna(subset=[dial, y])
    d = d.withColumn("q", d.agg(F.percentile(dial, F.array(F.lit(1 / 3), F.lit(2 / 3)))).scalar())
    return two_group_days(d, [Cell(dial, F.col(y), F.col(dial) > F.col("q")[1], F.col(dial) <= F.col("q")[0])])


@query("study_dials", "E37-E39 G3", over("walk_wk", two_group(_DIALS + """,
 t1 AS (SELECT quantile_cont(breadth, 1/3) AS q1, quantile_cont(breadth, 2/3) AS q2 FROM dl WHERE top2 IS NOT NULL),
 t2 AS (SELECT quantile_cont(dispersion, 1/3) AS q1, quantile_cont(dispersion, 2/3) AS q2 FROM dl WHERE spread IS NOT NULL),
 t3 AS (SELECT median(pick_corr) AS q FROM dl WHERE top2 IS NOT NULL), """ + _obs(
    ("breadth", "dl, t1", _case("breadth > q2", "top2"), _case("breadth <= q1", "top2")),
    ("dispersion", "dl, t2 WHERE dispersion IS NOT NULL AND spread IS NOT NULL", _case("dispersion > q2", "spread"), _case("dispersion <= q1", "spread")),
    ("pick_corr", "dl, t3 WHERE pick_corr IS NOT NULL", _case("pick_corr <= q", "top2"), _case("pick_corr > q", "top2"))), seed=3710)))
def study_dials(spark, sf_dir):
    """Breadth and dispersion terciles, and low against high correlation of the two picks."""
    dials, _ = settled(daily_dials(trend_panel(spark, sf_dir)))
    corr = dials.dropna(subset=["pick_corr", "top2"])
    corr = corr.withColumn("q", corr.agg(F.percentile("pick_corr", F.lit(0.5))).scalar())
    low = F.col("pick_corr") <= F.col("q")
    days = (
        tercile_days(dials, "breadth", "top2")
        .unionByName(tercile_days(dials, "dispersion", "spread"))
        .unionByName(two_group_days(corr, [Cell("pick_corr", F.col("top2"), low)]))
    )
    return R.two_group_ci(days, seed=3710)


@query("study_basis_momentum", "E34 F24", over("walk_1d bars_1d perp_1d", two_group("""
WITH f AS (SELECT symbol, day, close / lag(close, 90) OVER w - 1 AS r90, lead(close, 7) OVER w / close - 1 AS fwd7 FROM walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 l AS (SELECT b.symbol, b.day, round(p.perp_close / b.close - 1, 12) AS basis FROM bars_1d b JOIN perp_1d p ON b.symbol = p.symbol AND b.day = p.day),
 g AS (SELECT f.*, round(basis - lag(basis, 7) OVER (PARTITION BY f.symbol ORDER BY f.day), 12) AS d7 FROM f JOIN l ON f.symbol = l.symbol AND f.day = l.day), """ + _obs(
    ("rising_basis", "g WHERE d7 IS NOT NULL AND r90 > 0 AND fwd7 IS NOT NULL", _case("d7 > 0", "fwd7"), _case("d7 <= 0", "fwd7"))), seed=3410)))
def study_basis_momentum(spark, sf_dir):
    f = X.panel(market.walk_1d(spark, sf_dir), [[X.momentum(90), X.forward_return(7)]])
    legs = market.spot_perp_1d(spark, sf_dir).select(
        "symbol", "day", F.round(F.try_divide("perp_close", "close") - 1, 12).alias("basis")
    )
    g = f.join(legs, ["symbol", "day"]).withColumn("d7", F.round(F.col("basis") - X.lag("basis", 7), 12))
    g = g.dropna(subset=["d7", "r90", "fwd7"]).where("r90 > 0")
    return R.two_group_ci(two_group_days(g, [Cell("rising_basis", F.col("fwd7"), F.col("d7") > 0)]), seed=3410)


def pair_panel(closes):
    """(pair, day, a, b): closes of unordered symbol pairs on common days (equi-join on day)."""
    a = closes.select(F.col("symbol").alias("sa"), "day", F.col("close").alias("a"))
    b = closes.select(F.col("symbol").alias("sb"), "day", F.col("close").alias("b"))
    both = a.join(b, "day").where("sa < sb")
    return both.select(F.concat_ws("/", "sa", "sb").alias("symbol"), "sa", "sb", "day", "a", "b")


@query("study_pair_reversion", "E35 J4 F5 F20", over("walk_1d", event_mean(f"""
WITH p AS (SELECT x.symbol || '/' || y.symbol AS symbol, x.day, x.close AS a, y.close AS b, ln(x.close / y.close) AS lr FROM walk_1d x JOIN walk_1d y ON x.day = y.day AND x.symbol < y.symbol),
 q AS (SELECT *, (lr - {rolling('avg', 'lr', 90)}) / NULLIF({rolling('stddev_samp', 'lr', 90)}, 0) AS z,
  (lead(a, 7) OVER w / a) / (lead(b, 7) OVER w / b) - 1 AS fr FROM p WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 ev AS (SELECT 'reversion' AS cell, day, CASE WHEN z > 0 THEN -fr ELSE fr END AS v FROM q WHERE abs(z) >= 1.5 AND fr IS NOT NULL)""", seed=3510)))
def study_pair_reversion(spark, sf_dir):
    p = pair_panel(market.walk_1d(spark, sf_dir)).withColumn("lr", F.log(F.try_divide("a", "b")))
    z = F.try_divide(F.col("lr") - V.full(F.avg, "lr", 90), V.full(F.stddev_samp, "lr", 90))
    q = p.withColumns({"z": z, "fr": X.relative_forward_ratio(7, "a", "b", "fr").expr}).dropna(subset=["z", "fr"])
    v = F.when(F.abs("z") >= 1.5, F.when(F.col("z") > 0, -F.col("fr")).otherwise(F.col("fr")))
    return R.event_mean_ci(event_days(q, [Event("reversion", v)]), seed=3510)
