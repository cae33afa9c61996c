"""Signals and books over the random-walk bars."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import features as X
from tickloom.operators import asof, books, metrics, pairs
from tickloom.operators import crosssection as K
from tickloom.operators import signals as S
from tickloom.operators.skew import exact_percentiles
from tickloom.plans.oracle import over, rolling
from tickloom.registry import query
from tickloom.session import shared
from tickloom.sources import market

_RET = "WITH a AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY day) AS rn FROM {src})"


def _up(n: int) -> str:
    return f"coalesce(close > lag(close, {n}) OVER (PARTITION BY symbol ORDER BY day), FALSE)"


def _scale(n: int = 30) -> str:
    sd = rolling("stddev_samp", "ret", n)
    return f"CASE WHEN {sd} <= 0 THEN 1.0 ELSE least(1.0, 0.30 / ({sd} * sqrt(365))) END"


_SIG = _RET.format(src="walk_1d") + f""",
 b AS (SELECT *, greatest(high - low, abs(high - coalesce(lag(close) OVER w, high)), abs(low - coalesce(lag(close) OVER w, low))) AS tr,
   max(high) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS up, min(low) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS dn
   FROM a WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 c AS (SELECT *, {rolling('max', 'close', 30)} AS hi, {rolling('avg', 'tr', 14)} AS atr FROM b),
 d AS (SELECT *, CASE WHEN rn > 20 AND close > up THEN 1.0 WHEN rn > 20 AND close <= dn THEN 0.0 END AS bev,
   CASE WHEN rn >= 30 AND close <= hi - 2 * atr THEN 1.0 WHEN rn >= 30 AND close >= hi THEN 0.0 END AS sev FROM c),
 e AS (SELECT symbol, day, close, ret, rn, open, volume, coalesce(last_value(bev IGNORE NULLS) OVER r, 0.0) AS breakout, coalesce(last_value(sev IGNORE NULLS) OVER r, 0.0) = 1 AS stopped,
   CASE WHEN coalesce({rolling('avg', 'close', 20)} > {rolling('avg', 'close', 50)}, FALSE) THEN 1.0 ELSE 0.0 END AS sma_cross,
   CASE WHEN {_up(30)} THEN 1.0 ELSE 0.0 END AS ts_momentum,
   CASE WHEN rn > 90 AND {_up(30)} AND {rolling('stddev_samp', 'ret', 30)} < {rolling('stddev_samp', 'ret', 90)} THEN 1.0 ELSE 0.0 END AS vol_filtered,
   CASE WHEN rn > 30 AND {_up(30)} THEN round_even(({_scale()}) * 20, 0) / 20 ELSE 0.0 END AS vol_target,
   CASE WHEN rn > 180 AND ({_up(30)} OR {_up(90)} OR {_up(180)}) THEN round_even((CAST({_up(30)} AS INT) + CAST({_up(90)} AS INT) + CAST({_up(180)} AS INT)) / 3 * ({_scale()}) * 20, 0) / 20 ELSE 0.0 END AS blend,
   CASE WHEN coalesce(close < {rolling('avg', 'close', 20)} - 1.5 * {rolling('stddev_samp', 'close', 20)}, FALSE) THEN 1.0 ELSE 0.0 END AS bollinger
   FROM d WINDOW r AS (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING))"""


@query("signals_single_name", "P1 P2 P3 P4 P5 P6 P7 P8 P9 P10 S5", over("walk_1d", _SIG + """
SELECT symbol, CAST(day AS VARCHAR) AS day, R6(1.0) AS buy_hold, R6(0.0) AS flat, R6(sma_cross) AS sma_cross, R6(ts_momentum) AS ts_momentum, R6(vol_filtered) AS vol_filtered, R6(vol_target) AS vol_target, R6(blend) AS blend, R6(breakout) AS breakout, R6(bollinger) AS bollinger, stopped,
 R6(CASE WHEN stopped THEN 0.0 ELSE vol_target END) AS stop_vol_target FROM e"""))
def signals_single_name(spark, sf_dir):
    return S.single_name_signals(market.walk_1d(spark, sf_dir)).drop("open", "high", "low", "close", "volume", "ret")


@query("screen_returns", "P22 S6", over("walk_1d", _SIG + """,
 h AS (SELECT symbol, day, ret, coalesce(lag(vol_target) OVER w, 0) AS p1, coalesce(lag(vol_target, 2) OVER w, 0) AS p2 FROM e WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, CAST(day AS VARCHAR) AS day, R6(p1 * ret - 0.0011 * abs(p1 - p2)) AS book_ret FROM h"""))
def screen_returns(spark, sf_dir):
    s = S.single_name_signals(market.walk_1d(spark, sf_dir))
    return s.select("symbol", "day", metrics.screen(s, "vol_target", 0.0011).alias("book_ret"))


_LEDGER = _SIG + """,
 t AS (SELECT symbol, day, close, vol_target AS tg, lag(vol_target) OVER w AS pt, lead(day) OVER w AS nd, lead(open) OVER w AS no, lead(volume) OVER w AS nv FROM e WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 ev AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS k FROM t WHERE (pt IS NULL OR pt <> tg) AND nd IS NOT NULL),
 st(symbol, k, cash, pos, fat, qty, price, fee) AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT), CAST(10000 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DATE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM ev
  UNION ALL SELECT symbol, k, cash - (d * p + abs(d) * p * 10 * 1e-4), pos + d, nd, d, p, abs(d) * p * 10 * 1e-4 FROM
   (SELECT *, no * (1 + sign(d) * (1 + 25 * CASE WHEN nv > 0 THEN least(abs(d) / nv, 1) ELSE 1 END) * 1e-4) AS p FROM
    (SELECT e2.symbol, e2.k, s.cash, s.pos, e2.nd, e2.no, e2.nv, e2.tg * (s.cash + s.pos * e2.close) / e2.close - s.pos AS d FROM st s JOIN ev e2 ON e2.symbol = s.symbol AND e2.k = s.k + 1) q1) q2),
 mk AS (SELECT t.symbol, t.day, t.close, last_value(s.cash IGNORE NULLS) OVER r AS cash, last_value(s.pos IGNORE NULLS) OVER r AS pos
  FROM t LEFT JOIN st s ON t.symbol = s.symbol AND t.day = s.fat AND s.qty <> 0 WINDOW r AS (PARTITION BY t.symbol ORDER BY t.day ROWS UNBOUNDED PRECEDING)),
 eq AS (SELECT symbol, day, coalesce(cash, 10000) + coalesce(pos, 0) * close AS equity, coalesce(pos, 0) * close / (coalesce(cash, 10000) + coalesce(pos, 0) * close) AS exposure FROM mk)"""
_LEDGER = "WITH RECURSIVE " + _LEDGER.strip()[5:]


def _targets(spark, sf_dir):
    s = S.single_name_signals(market.walk_1d(spark, sf_dir))
    return s.select("symbol", "day", "open", "close", "volume", F.col("vol_target").alias("target"))


@query("ledger_equity", "P21", over("walk_1d", _LEDGER + """
SELECT symbol, CAST(day AS VARCHAR) AS day, R6(equity) AS equity, R6(exposure) AS exposure FROM eq"""))
def ledger_equity(spark, sf_dir):
    return books.ledger(_targets(spark, sf_dir), ["symbol"])


@query("ledger_fills", "P21", over("walk_1d", _LEDGER + """
SELECT symbol, CAST(fat AS VARCHAR) AS "at", R6(qty) AS qty, R6(price) AS price, R6(fee) AS fee FROM st WHERE qty <> 0"""))
def ledger_fills(spark, sf_dir):
    return books.fills(_targets(spark, sf_dir), ["symbol"]).select("symbol", "at", "qty", "price", "fee")


@query("book_performance", "R13", over("walk_1d", _LEDGER + """,
 r AS (SELECT *, equity / lag(equity) OVER w - 1 AS ret, equity / max(equity) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM eq WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 g AS (SELECT symbol, count(*) AS n, min_by(equity, day) AS f, max_by(equity, day) AS l, avg(ret) AS m, stddev_samp(ret) AS s, min(dd) AS dd, avg(CASE WHEN abs(exposure) > 1e-9 THEN 1.0 ELSE 0.0 END) AS tim FROM r GROUP BY symbol)
SELECT symbol, n AS n_bars, R6(l / f - 1) AS total_return, R6(pow(l / f, 365.0 / (n - 1)) - 1) AS cagr, R6(m / s * sqrt(365)) AS sharpe, R6(dd) AS max_drawdown, R6(tim) AS time_in_market FROM g"""))
def book_performance(spark, sf_dir):
    return metrics.performance(books.ledger(_targets(spark, sf_dir), ["symbol"]), ["symbol"])


def _unit_fills(spark, sf_dir):
    """Momentum positions of one or two units, long or flat in the first half of a year and long or short in the second, dealt at the close that decides."""
    w = W.partitionBy("symbol").orderBy("day")
    sign = F.when(F.col("close") > F.lag("close", 30).over(w), 1.0).when(F.month("day") <= 6, 0.0).otherwise(-1.0)
    size = F.when(F.month("day") % 3 == 0, 2.0).otherwise(1.0)
    held = market.walk_1d(spark, sf_dir).select("symbol", "day", "close", F.when(F.lag("close", 30).over(w).isNull(), 0.0).otherwise(sign * size).alias("units"))
    qty = F.col("units") - F.coalesce(F.lag("units").over(w), F.lit(0.0))
    moved = held.select("symbol", F.col("day").alias("at"), qty.alias("qty"), F.col("close").alias("price"))
    return moved.where("qty != 0").withColumn("fee", books.COST_RATE * F.abs("qty") * F.col("price"))


_TRIPS = """
WITH RECURSIVE u AS (SELECT symbol, day, close, CASE WHEN lag(close, 30) OVER w IS NULL THEN 0.0 ELSE CASE WHEN close > lag(close, 30) OVER w THEN 1.0 WHEN month(day) <= 6 THEN 0.0 ELSE -1.0 END * CASE WHEN month(day) % 3 = 0 THEN 2.0 ELSE 1.0 END END::DOUBLE AS units FROM walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 q AS (SELECT symbol, day, close, units - coalesce(lag(units) OVER (PARTITION BY symbol ORDER BY day), 0) AS qty FROM u),
 f AS (SELECT *, abs(qty) * close * CAST(0.0011 AS DOUBLE) AS fee, row_number() OVER (PARTITION BY symbol ORDER BY day) AS k FROM q WHERE qty <> 0),
 st(symbol, k, day, pos, cost, entry, pnl, done_entry, done) AS (
  SELECT DISTINCT symbol, 0::BIGINT, NULL::DATE, 0::DOUBLE, 0::DOUBLE, NULL::DATE, 0::DOUBLE, NULL::DATE, NULL::DOUBLE FROM f
  UNION ALL
  SELECT f.symbol, f.k, f.day, s.pos + f.qty,
   CASE WHEN s.pos * f.qty >= 0 THEN (s.cost * abs(s.pos) + f.close * abs(f.qty)) / (abs(s.pos) + abs(f.qty)) WHEN s.pos * (s.pos + f.qty) < 0 THEN f.close ELSE s.cost END,
   CASE WHEN s.pos = 0 OR s.pos * (s.pos + f.qty) < 0 THEN f.day ELSE s.entry END,
   CASE WHEN s.pos = 0 THEN -f.fee WHEN s.pos * f.qty > 0 THEN s.pnl - f.fee WHEN s.pos * (s.pos + f.qty) <= 0 THEN 0 ELSE s.pnl + sign(s.pos) * abs(f.qty) * (f.close - s.cost) - f.fee END,
   CASE WHEN s.pos <> 0 AND s.pos * (s.pos + f.qty) <= 0 THEN s.entry END,
   CASE WHEN s.pos <> 0 AND s.pos * (s.pos + f.qty) <= 0 THEN s.pnl + s.pos * (f.close - s.cost) - f.fee END
  FROM st s JOIN f ON f.symbol = s.symbol AND f.k = s.k + 1),
 trips AS (SELECT symbol, done_entry AS entry_at, day AS exit_at, done AS pnl FROM st WHERE done IS NOT NULL)"""


@query("book_trips", "R14", over("walk_1d", _TRIPS + """
SELECT symbol, CAST(entry_at AS VARCHAR) AS entry_at, CAST(exit_at AS VARCHAR) AS exit_at, R6(pnl) AS pnl FROM trips"""))
def book_trips(spark, sf_dir):
    """Every completed trip, against an average-cost ledger kept fill by fill in SQL."""
    return metrics.round_trips(_unit_fills(spark, sf_dir), ["symbol"])


@query("book_round_trips", "R14", over("walk_1d", _TRIPS + """
SELECT symbol, count(*) AS trips, R6(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)) AS win_rate, R6(coalesce(sum(pnl) FILTER (pnl > 0), 0) / nullif(abs(sum(pnl) FILTER (pnl <= 0)), 0)) AS profit_factor FROM trips GROUP BY symbol"""))
def book_round_trips(spark, sf_dir):
    """Trips, win rate and profit factor of unit momentum positions."""
    return metrics.trip_summary(metrics.round_trips(_unit_fills(spark, sf_dir), ["symbol"]), ["symbol"])


@query("risk_capped_targets", "P20", over("walk_1d", _LEDGER + """,
 j AS (SELECT e.symbol, e.day, e.vol_target AS tg, eq.equity FROM e JOIN eq ON e.symbol = eq.symbol AND e.day = eq.day),
 k AS (SELECT *, 1 - equity / max(equity) OVER w AS dd, first_value(equity) OVER m AS s0 FROM j
  WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING), m AS (PARTITION BY symbol, date_trunc('month', day) ORDER BY day ROWS UNBOUNDED PRECEDING)),
 l AS (SELECT *, max(CASE WHEN dd >= 0.10 - 1e-12 THEN 1 ELSE 0 END) OVER w AS dead, max(CASE WHEN equity <= s0 * 0.98 THEN 1 ELSE 0 END) OVER m AS halted FROM k
  WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING), m AS (PARTITION BY symbol, date_trunc('month', day) ORDER BY day ROWS UNBOUNDED PRECEDING))
SELECT symbol, CAST(day AS VARCHAR) AS ts, R6(CASE WHEN dead = 1 OR halted = 1 THEN 0.0 ELSE least(tg, 0.5) * CASE WHEN dd <= 0.05 THEN 1.0 ELSE (0.10 - dd) / (0.10 - 0.05) END END) AS allowed FROM l"""))
def risk_capped_targets(spark, sf_dir):
    """The capital-preservation preset; the halt period here is the calendar month of daily bars."""
    t = _targets(spark, sf_dir)
    eq = books.ledger(t, ["symbol"])
    stream = t.join(eq, ["symbol", "day"]).select(
        "symbol", F.col("day").alias("ts"), F.trunc("day", "month").alias("day"), "target", "equity"
    )
    return S.risk_caps(stream, "symbol", **S.PRESETS["preserve"]).select("symbol", "ts", "allowed")


# --- rotation -------------------------------------------------------------------------------------------

_CARRY = """,
 cal AS (SELECT day, row_number() OVER (ORDER BY day) AS o FROM (SELECT DISTINCT day FROM {src}) d),
 sc AS (SELECT a.*, cal.o, coalesce(lead(cal.o) OVER (PARTITION BY symbol ORDER BY cal.o) - 1, (SELECT max(o) FROM cal)) AS hi FROM a JOIN cal ON a.day = cal.day),
 asf AS (SELECT sc.* EXCLUDE (day, o, hi), c2.day FROM sc JOIN cal c2 ON c2.o BETWEEN sc.o AND sc.hi)"""
_ROT = """WITH a0 AS (SELECT symbol, day, close, high, low, close / lag(close) OVER w - 1 AS ret, close / lag(close, 12) OVER w - 1 AS score FROM walk_wk WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 a AS (SELECT symbol, day, score, list(ret) FILTER (WHERE ret IS NOT NULL) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS recent FROM a0)""" + _CARRY.format(src="walk_wk")


@query("rotation_weights", "P11 K4 J10", over("walk_wk", _ROT + """,
 r AS (SELECT day, symbol, score, row_number() OVER (PARTITION BY day ORDER BY score DESC, symbol) AS rk FROM asf WHERE score IS NOT NULL)
SELECT CAST(day AS VARCHAR) AS day, symbol, R6(0.5) AS weight FROM r WHERE rk <= 2 AND score > 0"""))
def rotation_weights(spark, sf_dir):
    return S.rotation(market.walk_wk(spark, sf_dir), 12, 2)


def _vt_rot(extra: str, src: str) -> str:
    return extra + f""",
 r AS (SELECT day, symbol, score, recent, row_number() OVER (PARTITION BY day ORDER BY score DESC, symbol) AS rk FROM {src} WHERE score IS NOT NULL),
 p AS (SELECT * FROM r WHERE rk <= 2 AND score > 0),
 ok AS (SELECT day FROM p GROUP BY day HAVING min(len(recent)) >= 30),
 bl AS (SELECT day, i, avg(recent[i]) AS m FROM (SELECT day, recent, unnest(range(1, 31)) AS i FROM p WHERE day IN (SELECT day FROM ok)) x GROUP BY day, i),
 sd AS (SELECT day, stddev_samp(m) AS sd FROM bl GROUP BY day)
SELECT CAST(p.day AS VARCHAR) AS day, p.symbol, R6(least(1.0, 0.30 / (sd * sqrt(365))) / 2) AS weight FROM p JOIN sd ON p.day = sd.day"""


@query("vol_target_rotation_weights", "P12", over("walk_wk", _vt_rot(_ROT, "asf")))
def vol_target_rotation_weights(spark, sf_dir):
    return S.vol_target_rotation(market.walk_wk(spark, sf_dir), 12, 2)


_STOP_ROT = f"""WITH a0 AS (SELECT symbol, day, close, close / lag(close) OVER w - 1 AS ret, close / lag(close, 12) OVER w - 1 AS score, row_number() OVER w AS rn,
  greatest(high - low, abs(high - coalesce(lag(close) OVER w, high)), abs(low - coalesce(lag(close) OVER w, low))) AS tr FROM walk_wk WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 a1 AS (SELECT *, {rolling('max', 'close', 30)} AS hi0, {rolling('avg', 'tr', 14)} AS atr FROM a0),
 a2 AS (SELECT *, CASE WHEN rn >= 30 AND close <= hi0 - 2 * atr THEN 1 WHEN rn >= 30 AND close >= hi0 THEN 0 END AS sev FROM a1),
 a AS (SELECT symbol, day, score, list(ret) FILTER (WHERE ret IS NOT NULL) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS recent,
  coalesce(last_value(sev IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING), 0) = 1 AS stopped FROM a2)""" + _CARRY.format(src="walk_wk") + """,
 live AS (SELECT * FROM asf WHERE NOT stopped)"""


@query("stopped_rotation_weights", "P13 P9", over("walk_wk", _vt_rot(_STOP_ROT, "live")))
def stopped_rotation_weights(spark, sf_dir):
    return S.vol_target_rotation(market.walk_wk(spark, sf_dir), 12, 2, stops=True)


_CRASH = """WITH a AS (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM walk_1d)""" + _CARRY.format(src="walk_1d") + """,
 cr AS (SELECT day FROM a WHERE symbol = 'AF' AND ret < -0.015),
 cb AS (SELECT s.day, s.symbol, 1.0 / count(*) OVER (PARTITION BY s.day) AS weight FROM asf s WHERE s.symbol <> 'AF' AND s.day IN (SELECT day FROM cr))"""


@query("crash_bounce_weights", "P14 J9", over("walk_1d", _CRASH + """
SELECT CAST(day AS VARCHAR) AS day, symbol, R6(weight) AS weight FROM cb"""))
def crash_bounce_weights(spark, sf_dir):
    return S.crash_bounce(market.walk_1d(spark, sf_dir), "AF", -0.015)


@query("combined_weights", "P16 P19", over("walk_1d", _CRASH + """,
 ew AS (SELECT day, symbol, 0.6 / count(*) OVER (PARTITION BY day) AS weight FROM walk_1d),
 u AS (SELECT day, sum(weight) AS used FROM ew GROUP BY day),
 al AS (SELECT day, symbol, weight FROM ew UNION ALL SELECT cb.day, cb.symbol, cb.weight * greatest(0.0, 1 - coalesce(used, 0)) FROM cb LEFT JOIN u ON cb.day = u.day)
SELECT CAST(day AS VARCHAR) AS day, symbol, R6(sum(weight)) AS weight FROM al GROUP BY day, symbol"""))
def combined_weights(spark, sf_dir):
    """A 60% equal-weight base with the crash overlay on the idle cash."""
    bars = shared(market.walk_1d(spark, sf_dir))
    base = S.combine([(S.equal_weight_live(bars), 0.6)])
    return S.overlay_idle(base, S.crash_bounce(bars, "AF", -0.015))


UNIVERSE = {"size": 10, "volume_window": 12, "min_history": 26, "every": 84, "start": "1995-06-05", "end": "2001-12-31"}
_UNI = """WITH re AS (SELECT CAST(unnest(generate_series(DATE '1995-06-05', DATE '2001-12-31', INTERVAL 84 DAY)) AS DATE) AS eff),
 h AS (SELECT eff, symbol, quote_volume, row_number() OVER (PARTITION BY eff, symbol ORDER BY day DESC) AS back, count(*) OVER (PARTITION BY eff, symbol) AS n FROM re JOIN walk_wk ON day <= eff),
 m AS (SELECT eff, symbol, avg(quote_volume) AS tv FROM h WHERE n >= 26 AND back <= 12 GROUP BY eff, symbol),
 uni AS (SELECT eff, symbol, tv, rk FROM (SELECT *, row_number() OVER (PARTITION BY eff ORDER BY tv DESC, symbol DESC) AS rk FROM m WHERE tv > 0) x WHERE rk <= 10)"""


@query("universe_schedule", "K5", over("walk_wk", _UNI + """
SELECT CAST(eff AS VARCHAR) AS effective, symbol, R6(tv / 1000000) AS turnover_m, rk AS rank FROM uni"""))
def universe_schedule(spark, sf_dir):
    u = K.universes(market.walk_wk(spark, sf_dir), **UNIVERSE)
    return u.select("effective", "symbol", (F.col("turnover") / 1e6).alias("turnover_m"), "rank")


@query("universe_turnover", "K6 K9", over("walk_wk", _UNI + """,
 e AS (SELECT eff, row_number() OVER (ORDER BY eff) AS k FROM (SELECT DISTINCT eff FROM uni) d)
SELECT CAST(e.eff AS VARCHAR) AS effective, (SELECT count(*) FROM uni u WHERE u.eff = e.eff) AS size,
 (SELECT count(*) FROM uni u WHERE u.eff = e.eff AND u.symbol NOT IN (SELECT symbol FROM uni v JOIN e p ON v.eff = p.eff WHERE p.k = e.k - 1)) AS added FROM e WHERE k > 1"""))
def universe_turnover(spark, sf_dir):
    return K.universe_turnover(K.universes(market.walk_wk(spark, sf_dir), **UNIVERSE))


@query("universe_masked_panel", "P18 J6 J13", over("walk_wk", _UNI + """,
 sp AS (SELECT eff, coalesce(lead(eff) OVER (ORDER BY eff), DATE '2100-01-01') AS until FROM (SELECT DISTINCT eff FROM uni) d)
SELECT u.symbol, count(*) AS days, CAST(min(w.day) AS VARCHAR) AS first, CAST(max(w.day) AS VARCHAR) AS last FROM walk_wk w JOIN sp ON w.day >= sp.eff AND w.day < sp.until JOIN uni u ON u.eff = sp.eff AND u.symbol = w.symbol GROUP BY u.symbol"""))
def universe_masked_panel(spark, sf_dir):
    bars = shared(market.walk_wk(spark, sf_dir))
    kept = K.mask_members(bars, K.universes(bars, **UNIVERSE), UNIVERSE["every"], UNIVERSE["start"], UNIVERSE["end"])
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("days"), F.min("day").alias("first"), F.max("day").alias("last"))


def _book_sql(books: dict[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{n}' AS book, CAST(day AS DATE) AS day, symbol, weight FROM ({q.replace('R6(', '(')}) {n}_w" for n, q in books.items())
    return f"""WITH br AS (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM walk_wk),
 bw AS ({rows}),
 bp AS (SELECT k.book, br.symbol, br.day, br.ret, coalesce(bw.weight, 0) AS weight FROM br CROSS JOIN (SELECT unnest({list(books)}) AS book) k LEFT JOIN bw ON bw.book = k.book AND bw.symbol = br.symbol AND bw.day = br.day),
 bl AS (SELECT *, coalesce(lag(weight) OVER s, 0) AS held, coalesce(lag(weight, 2) OVER s, 0) AS was FROM bp WINDOW s AS (PARTITION BY book, symbol ORDER BY day))
SELECT book, CAST(day AS VARCHAR) AS day, R6(sum(held * coalesce(ret, 0) - 0.0011 * abs(held - was))) AS ret, R6(sum(abs(held - was))) AS turnover, R6(sum(abs(held))) AS exposure FROM bl GROUP BY book, day"""


@query("rotation_book", "P22 P12 P13 P18", over("walk_wk", _book_sql({
    "rotation": _ROT + """,
 r AS (SELECT day, symbol, score, row_number() OVER (PARTITION BY day ORDER BY score DESC, symbol) AS rk FROM asf WHERE score IS NOT NULL)
SELECT day, symbol, 0.5 AS weight FROM r WHERE rk <= 2 AND score > 0""",
    "vol_target": _vt_rot(_ROT, "asf"),
    "stopped": _vt_rot(_STOP_ROT, "live"),
    "equal_weight": "SELECT day, symbol, 1.0 / count(*) OVER (PARTITION BY day) AS weight FROM walk_wk",
})))
def rotation_book(spark, sf_dir):
    """Screened returns of four books side by side."""
    bars = shared(market.walk_wk(spark, sf_dir))
    sets = {
        "rotation": S.rotation(bars, 12, 2),
        "vol_target": S.vol_target_rotation(bars, 12, 2),
        "stopped": S.vol_target_rotation(bars, 12, 2, stops=True),
        "equal_weight": S.equal_weight_live(bars),
    }
    return books.screened_book(books.book_bars(bars.withColumn("ret", S.ret()), sets))


GRID = [7.0, 14.0, 30.0, 60.0]


WARMUP, TRAIN, TEST = 61, 365, 90


def _walk_forward(spark, sf_dir):
    cols = {p: f"m{int(p)}" for p in GRID}
    sig = market.walk_1d(spark, sf_dir).select(
        "symbol", "day", S.ret().alias("ret"), *(S.ts_momentum(int(p)).alias(c) for p, c in cols.items())
    )
    return books.walk_forward(sig, cols, warmup=WARMUP, train=TRAIN, test=TEST)


_FORWARD = f"""
WITH a AS (SELECT symbol, day, close / lag(close) OVER w - 1 AS ret, close / lag(close, 7) OVER w AS g7, close / lag(close, 14) OVER w AS g14, close / lag(close, 30) OVER w AS g30, close / lag(close, 60) OVER w AS g60 FROM walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 l AS (SELECT symbol, day, ret, p, pl, CASE WHEN g > 1 THEN 1.0 ELSE 0.0 END AS tg FROM a, LATERAL (VALUES (7.0, 1, g7), (14.0, 2, g14), (30.0, 3, g30), (60.0, 4, g60)) v(p, pl, g)),
 h AS (SELECT symbol, day, p, pl, coalesce(lag(tg) OVER w, 0)::DOUBLE AS held, coalesce(lag(tg) OVER w * ret, 0) - CAST(0.0011 AS DOUBLE) * abs(coalesce(lag(tg) OVER w, 0) - coalesce(lag(tg, 2) OVER w, 0)) AS r,
  row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol, p) AS n FROM l WINDOW w AS (PARTITION BY symbol, p ORDER BY day)),
 k AS (SELECT symbol, max(n) AS n FROM h GROUP BY symbol),
 wn AS (SELECT symbol, CAST(v AS INTEGER) AS win, v * {TEST} AS a0 FROM k, LATERAL (SELECT unnest(range(0, greatest(0, (n - {TRAIN + TEST}) // {TEST} + 1))) AS v) q WHERE v * {TEST} + {TRAIN + TEST} <= n),
 sh AS (SELECT h.symbol, win, p, pl, CASE WHEN count(DISTINCT r) > 1 THEN avg(r) / stddev_samp(r) * sqrt(365) ELSE 0.0 END AS sharpe FROM h JOIN wn ON h.symbol = wn.symbol AND i >= a0 + {WARMUP} AND i < a0 + {TRAIN} GROUP BY h.symbol, win, p, pl),
 ch AS (SELECT symbol, win, p, sharpe FROM sh QUALIFY row_number() OVER (PARTITION BY symbol, win ORDER BY round(sharpe, 9) DESC, pl) = 1),
 oos AS (SELECT h.symbol, h.day, ch.win, ch.p, ch.sharpe, h.held, h.r, 10000 * exp(sum(ln(1 + h.r)) OVER (PARTITION BY h.symbol ORDER BY h.day ROWS UNBOUNDED PRECEDING)) AS equity
  FROM h JOIN wn ON h.symbol = wn.symbol AND h.i >= a0 + {TRAIN} AND h.i < a0 + {TRAIN + TEST} JOIN ch ON ch.symbol = h.symbol AND ch.win = wn.win AND ch.p = h.p)"""


@query("walk_forward_equity", "P26 R27", over("walk_1d", _FORWARD + """
SELECT symbol, CAST(day AS VARCHAR) AS day, win AS window, R6(p) AS param, R6(sharpe) AS train_sharpe, R6(held) AS exposure, R6(r) AS ret, R6(equity) AS equity FROM oos"""))
def walk_forward_equity(spark, sf_dir):
    """Stitched out-of-sample equity of the walk-forward choice."""
    return _walk_forward(spark, sf_dir)


@query("candidate_portfolio", "P27", over("walk_1d", _FORWARD + """
SELECT CAST(day AS VARCHAR) AS day, R6(avg(r)) AS ret, count(*) AS n FROM oos GROUP BY day"""))
def candidate_portfolio(spark, sf_dir):
    """Equal-weight daily returns of the stitched books, aligned by date."""
    return books.equal_weight_returns(_walk_forward(spark, sf_dir))


@query("parameter_grid_table", "R27", over("walk_1d", """
WITH a AS (SELECT symbol, day, close, close / lag(close) OVER w - 1 AS ret, close / lag(close, 7) OVER w AS g7, close / lag(close, 14) OVER w AS g14, close / lag(close, 30) OVER w AS g30, close / lag(close, 60) OVER w AS g60 FROM walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 l AS (SELECT symbol, day, ret, p, CASE WHEN g > 1 THEN 1.0 ELSE 0.0 END AS tg FROM a, LATERAL (VALUES (7.0, g7), (14.0, g14), (30.0, g30), (60.0, g60)) v(p, g)),
 h AS (SELECT symbol, p, coalesce(lag(tg) OVER w, 0) * ret - 0.0011 * abs(coalesce(lag(tg) OVER w, 0) - coalesce(lag(tg, 2) OVER w, 0)) AS r FROM l WINDOW w AS (PARTITION BY symbol, p ORDER BY day)),
 s AS (SELECT p, symbol, avg(r) / stddev_samp(r) * sqrt(365) AS sh FROM h GROUP BY p, symbol)
SELECT R6(p) AS param, """ + ", ".join(f"R6(max(CASE WHEN symbol = '{s}' THEN sh END)) AS {s}" for s in ("AF", "AO", "NF", "NO", "RF", "RO")) + """, R6(median(sh)) AS median FROM s GROUP BY p"""))
def parameter_grid_table(spark, sf_dir):
    """Screened annual Sharpe of every lookback by symbol, with the median across symbols."""
    cols = {p: f"m{int(p)}" for p in GRID}
    bars = market.walk_1d(spark, sf_dir).select(
        "symbol", "day", S.ret().alias("ret"), *(S.ts_momentum(int(p)).alias(c) for p, c in cols.items())
    )
    long = books.stack_params(bars, cols, ["symbol", "day", "ret"]).withColumn("key", F.concat_ws("/", "symbol", "param"))
    r = long.select("symbol", "param", metrics.screen(long, "target", 0.0011, key="key").alias("r"))
    sh = r.groupBy("param", "symbol").agg((F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(365.0))).alias("sh"))
    names = sorted(r[0] for r in sh.select("symbol").distinct().collect())  # the columns of the table
    table = sh.groupBy("param").pivot("symbol", names).agg(F.first("sh"))
    return table.join(exact_percentiles(sh, ["param"], "sh", {"median": 0.5}), "param")


@query("current_target_table", "P28 J7", over("walk_1d", _SIG + """,
 x AS (SELECT symbol, max(day) AS day, max_by(close, day) AS close, max_by(vol_target, day) AS target, max_by(blend, day) AS blend FROM e GROUP BY symbol)
SELECT symbol, CAST(day AS VARCHAR) AS day, R6(close) AS close, R6(target) AS target, R6(blend) AS blend, R6(target * 10000 / count(*) OVER ()) AS notional,
 abs(target * 10000 / count(*) OVER ()) >= 10000 * 0.005 AS trade, date_diff('day', DATE '2001-06-01', day) >= 90 AS reselect FROM x"""))
def current_target_table(spark, sf_dir):
    s = S.single_name_signals(market.walk_1d(spark, sf_dir))
    now = books.current_targets(s, {"target": "vol_target", "blend": "blend"})
    # One row a symbol here: the account is shared by as many as there are.
    notional = F.col("target") * 10000 / F.count(F.lit(1)).over(W.partitionBy())
    return now.withColumns(
        {
            "notional": notional,
            "trade": F.abs(notional) >= 10000 * 0.005,
            "reselect": books.reselection_due(F.lit("2001-06-01").cast("date"), F.col("day")),
        }
    )


@query("rebalance_orders", "P28", over("walk_1d", _SIG + """,
 x AS (SELECT symbol, max_by(close, day) AS close, max_by(vol_target, day) AS target FROM e GROUP BY symbol),
 h AS (SELECT symbol, 2000 * max_by(vol_target, day) / max_by(close, day) AS units FROM e WHERE day <= DATE '2001-01-01' GROUP BY symbol HAVING max_by(vol_target, day) > 0),
 o AS (SELECT x.symbol, target, close, target * 10000 - coalesce(units, 0) * close AS notional FROM x LEFT JOIN h ON x.symbol = h.symbol)
SELECT symbol, R6(target) AS target, R6(close) AS close, R6(notional) AS notional FROM o WHERE abs(notional) >= 50"""))
def rebalance_orders(spark, sf_dir):
    """Orders from what earlier decisions hold to the newest targets, above the dust share."""
    s = S.single_name_signals(market.walk_1d(spark, sf_dir))
    names = {"target": "vol_target"}
    then = books.current_targets(s.where("day <= date'2001-01-01'"), names)
    held = then.where("target > 0").select("symbol", (2000 * F.col("target") / F.col("close")).alias("units"))
    return books.rebalance_orders(books.current_targets(s, names), held, F.lit(10_000.0))


# --- carry and pairs ----------------------------------------------------------------------------------


def _carry_legs(spark, sf_dir):
    spot = market.walk_1d(spark, sf_dir).select("symbol", "day", "close")
    perp = market.spot_perp_1d(spark, sf_dir).select("symbol", "day", F.try_divide("perp_close", "close").alias("k"))
    return spot.join(perp, ["symbol", "day"]).select("symbol", "day", "close", (F.col("close") * F.col("k")).alias("perp_close"))


_CARRY_SQL = """
WITH l AS (SELECT w.symbol, w.day, w.close, w.close * (p.perp_close / b.close) AS perp FROM walk_1d w JOIN bars_1d b ON w.symbol = b.symbol AND w.day = b.day JOIN perp_1d p ON w.symbol = p.symbol AND w.day = p.day),
 f AS (SELECT symbol, day, sum(rate) AS funding FROM funding GROUP BY symbol, day),
 c0 AS (SELECT l.symbol, l.day, close / lag(close) OVER w - 1 AS rs, perp / lag(perp) OVER w - 1 AS rp, funding FROM l JOIN f ON l.symbol = f.symbol AND l.day = f.day WINDOW w AS (PARTITION BY l.symbol ORDER BY l.day)),
 c1 AS (SELECT * FROM c0 WHERE rs IS NOT NULL),
 c AS (SELECT *, coalesce(count(funding) OVER g = 30 AND avg(funding) OVER g > 0, FALSE) AS hold FROM c1 WINDOW g AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))"""


@query("carry_gross_attribution", "P23 P24 J1 J10 B8", over("walk_1d bars_1d perp_1d funding", _CARRY_SQL + """
SELECT CAST(day AS VARCHAR) AS day, count(*) AS present, R6(coalesce(0.5 / NULLIF(count(*), 0), 0) * sum(CASE WHEN hold THEN funding ELSE 0 END) * 1000) AS funding_permille,
 R6(coalesce(0.5 / NULLIF(count(*), 0), 0) * sum(CASE WHEN hold THEN rs - rp ELSE 0 END)) AS basis_ret FROM c GROUP BY day"""))
def carry_gross_attribution(spark, sf_dir):
    frame = books.carry_frame(_carry_legs(spark, sf_dir), market.funding(spark, sf_dir), gate=30)
    g = books.carry_gross(frame)
    return g.select("day", "present", (F.col("funding_ret") * 1000).alias("funding_permille"), "basis_ret")


@query("carry_book_daily", "P23 P24", over("walk_1d bars_1d perp_1d funding", _CARRY_SQL + """,
 bk AS (SELECT 'gated' AS book, symbol, day, rs, rp, funding, hold FROM c UNION ALL SELECT 'always', symbol, day, rs, rp, funding, TRUE FROM c),
 sh AS (SELECT *, CASE WHEN hold THEN 0.5 / count(*) OVER (PARTITION BY book, day) ELSE 0 END AS w FROM bk),
 tu AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY book, symbol ORDER BY day), 0)) AS turn FROM sh)
SELECT book, CAST(day AS VARCHAR) AS day, R6(sum(w * funding) + sum(w * (rs - rp)) - 0.0022 * sum(turn)) AS ret, R6(sum(w * funding) * 1000) AS funding_permille,
 R6(sum(w * (rs - rp))) AS basis_ret, R6(-0.0022 * sum(turn) * 1000) AS cost_permille, count(*) AS n_symbols FROM tu GROUP BY book, day"""))
def carry_book_daily(spark, sf_dir):
    """Always-on and gated carry books with their costs."""
    legs, funding = shared(_carry_legs(spark, sf_dir)), shared(market.funding(spark, sf_dir))
    frame = books.carry_frame(legs, funding).withColumn("book", F.lit("always")).unionByName(
        books.carry_frame(legs, funding, gate=30).withColumn("book", F.lit("gated"))
    )
    days = books.carry_book(frame)
    return days.select(
        "book", "day", "ret", (F.col("funding_ret") * 1000).alias("funding_permille"), "basis_ret", (F.col("cost_ret") * 1000).alias("cost_permille"), "n_symbols"
    )


FORMATION, TRADING = 104, 52
_PAIR_SQL = """
WITH cal AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS t FROM (SELECT DISTINCT day FROM walk_wk) d),
 g AS (SELECT w.symbol, w.day, w.close, t, k AS regime FROM walk_wk w JOIN cal ON w.day = cal.day JOIN (SELECT unnest(range(0, 8)) AS k) r ON t >= k * 52 AND t < k * 52 + 104),
 ok AS (SELECT regime, symbol FROM g GROUP BY 1, 2 HAVING count(*) = 104),
 p AS (SELECT g.*, ln(close) AS l FROM g JOIN ok ON g.regime = ok.regime AND g.symbol = ok.symbol),
 pr AS (SELECT a.regime, a.symbol AS sa, b.symbol AS sb, a.t, a.l AS la, b.l AS lb FROM p a JOIN p b ON a.regime = b.regime AND a.t = b.t AND a.symbol < b.symbol),
 ft AS (SELECT regime, sa, sb, count(*) AS n_obs, regr_slope(la, lb) AS hedge, regr_intercept(la, lb) AS icpt FROM pr GROUP BY 1, 2, 3),
 s0 AS (SELECT pr.regime, pr.sa, pr.sb, t, n_obs, hedge, icpt, la - hedge * lb - icpt AS s FROM pr JOIN ft ON pr.regime = ft.regime AND pr.sa = ft.sa AND pr.sb = ft.sb),
 s1 AS (SELECT *, lag(s) OVER w AS l1, lag(s, 2) OVER w AS l2 FROM s0 WINDOW w AS (PARTITION BY regime, sa, sb ORDER BY t)),
 x AS (SELECT *, s - l1 AS y, l1 AS x1, l1 - l2 AS x2 FROM s1 WHERE l2 IS NOT NULL),
 m AS (SELECT regime, sa, sb, count(*) AS m, count(*) * var_pop(x1) AS s11, count(*) * var_pop(x2) AS s22, count(*) * covar_pop(x1, x2) AS s12,
   count(*) * covar_pop(x1, y) AS s1y, count(*) * covar_pop(x2, y) AS s2y, count(*) * var_pop(y) AS syy FROM x GROUP BY 1, 2, 3),
 b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m),
 st AS (SELECT regime, sa, sb, b1 / sqrt((syy - b1 * s1y - b2 * s2y) / (m - 3) * s22 / (s11 * s22 - s12 * s12)) AS adf FROM b),
 sp AS (SELECT regime, sa, sb, max(n_obs) AS n_obs, max(hedge) AS hedge, max(icpt) AS icpt, stddev_samp(s) AS sd FROM s0 GROUP BY 1, 2, 3)"""


def _pair_stats(prices):
    placed = pairs.complete_windows(prices, FORMATION, TRADING)
    return pairs.engle_granger(pairs.log_pairs(placed, ["regime"]), ["regime"])


@query("pair_cointegration", "R15 J4 P25", over("walk_wk", _PAIR_SQL + """
SELECT st.regime, st.sa, st.sb, sp.n_obs, R6(hedge) AS hedge, R6(icpt) AS intercept, R6(adf) AS adf, R6(sd) AS spread_std FROM st JOIN sp ON st.regime = sp.regime AND st.sa = sp.sa AND st.sb = sp.sb"""))
def pair_cointegration(spark, sf_dir):
    """Formation statistics of every gap-free pair in every formation window."""
    return _pair_stats(market.walk_wk(spark, sf_dir)).drop("spread_mean")


@query("pairs_book_grid", "P25 R27", over("walk_wk", _PAIR_SQL + """,
 ad AS (SELECT st.regime, st.sa, st.sb, hedge, icpt, sd, (SELECT avg(s) FROM s0 z WHERE z.regime = st.regime AND z.sa = st.sa AND z.sb = st.sb) AS mu FROM st JOIN sp ON st.regime = sp.regime AND st.sa = sp.sa AND st.sb = sp.sb WHERE adf < -3.04),
 tr AS (SELECT w.symbol, w.day, cal.t, ln(w.close) AS l, w.close / v.close - 1 AS r FROM walk_wk w JOIN cal ON w.day = cal.day LEFT JOIN cal c2 ON c2.t = cal.t - 1 LEFT JOIN walk_wk v ON v.symbol = w.symbol AND v.day = c2.day),
 pd AS (SELECT ad.regime, ad.sa, ad.sb, a.t, a.day, (a.l - hedge * b.l - icpt - mu) / sd AS z, a.r AS ra, b.r AS rb FROM ad JOIN tr a ON a.symbol = ad.sa AND a.t >= 104 AND (a.t - 104) // 52 = ad.regime JOIN tr b ON b.symbol = ad.sb AND b.t = a.t),
 g2 AS (SELECT * FROM pd CROSS JOIN (VALUES ('1.5/0.5', 1.5, 0.5), ('2.0/0.5', 2.0, 0.5), ('2.0/0.0', 2.0, 0.0)) v(book, zi, zo)),
 mk AS (SELECT *, CASE WHEN abs(z) <= zo OR abs(z) >= 4 THEN 0 WHEN abs(z) >= zi THEN -sign(z) END AS mark FROM g2),
 ps AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY book, regime, sa, sb ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS pos FROM mk),
 hd AS (SELECT *, coalesce(lag(pos) OVER q, 0) AS held, coalesce(lag(pos, 2) OVER q, 0) AS was FROM ps WINDOW q AS (PARTITION BY book, regime, sa, sb ORDER BY t))
SELECT book, CAST(day AS VARCHAR) AS day, R6(avg(held * coalesce(ra - rb, 0) - 0.0022 * abs(held - was)) / 2) AS ret, count(*) FILTER (WHERE pos <> 0) AS n_open FROM hd GROUP BY book, day"""))
def pairs_book_grid(spark, sf_dir):
    """Books of admitted pairs over a grid of entry and exit marks."""
    prices = shared(market.walk_wk(spark, sf_dir).select("symbol", "day", "close"))
    admitted = pairs.formed(_pair_stats(prices), ["regime"], alpha=0.10)
    return pairs.pairs_book(pairs.pair_days(prices, admitted, FORMATION, TRADING), [(1.5, 0.5), (2.0, 0.5), (2.0, 0.0)])


@query("asof_state", "J7 N9", over("walk_1d", """
SELECT symbol, CAST(max(day) AS VARCHAR) AS day, R6(max_by(close, day)) AS close, R6(max_by(volume, day)) AS volume FROM walk_1d WHERE day + INTERVAL 1 DAY <= DATE '1999-03-15' GROUP BY symbol"""))
def asof_state(spark, sf_dir):
    """What each symbol's newest bar was, counting a bar as known only once it has closed."""
    known = asof.known_at(market.walk_1d(spark, sf_dir), "1999-03-15")
    return asof.latest_state(known, ["close", "volume"])


@query("lookahead_check", "N9", over("walk_1d", """
WITH u AS (SELECT symbol, day, lead(day) OVER (PARTITION BY symbol ORDER BY day) AS next, row_number() OVER (PARTITION BY symbol ORDER BY day) AS rn FROM walk_1d),
 d AS (SELECT symbol, day AS src, CAST(day + INTERVAL 1 DAY AS DATE) AS as_of FROM u UNION ALL SELECT symbol, next, CAST(day + INTERVAL 1 DAY AS DATE) FROM u WHERE rn % 10 = 0 AND next IS NOT NULL)
SELECT symbol, count(*) AS uses, CAST(CAST(max(src) + INTERVAL 1 DAY AS DATE) AS VARCHAR) AS latest, count(*) FILTER (WHERE src + INTERVAL 1 DAY > as_of) AS violations FROM d GROUP BY symbol"""))
def lookahead_check(spark, sf_dir):
    """Decisions that read their own bar, and every tenth the next one too, which is looking ahead."""
    w = W.partitionBy("symbol").orderBy("day")
    bars = market.walk_1d(spark, sf_dir).select("symbol", "day", F.lead("day").over(w).alias("next"), F.row_number().over(w).alias("rn"))
    planted = (F.col("rn") % 10 == 0) & F.col("next").isNotNull()
    read = F.when(planted, F.array("day", "next")).otherwise(F.array("day"))
    uses = bars.select("symbol", F.date_add("day", 1).alias("as_of"), F.explode(read).alias("source_day"))
    return asof.lookahead(uses, "source_day", "as_of")


@query("asof_leader_price", "J6 J7", over("bars_1h", """
WITH e AS (SELECT event_id, event_type, ts FROM events WHERE event_type <> 'view'), b AS (SELECT ts AS bts, close FROM bars_1h WHERE symbol = 'view')
SELECT e.event_id, strftime(b.bts, '%Y-%m-%d %H:%M:%S') AS bar, R6(b.close) AS close FROM e ASOF LEFT JOIN b ON e.ts >= b.bts"""))
def asof_leader_price(spark, sf_dir):
    """Leader bar in force at every other event."""
    ev = market.table(spark, sf_dir, "events").where("event_type <> 'view'").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    bars = market.bars_1h(spark, sf_dir).where("symbol = 'view'").select(F.col("ts").cast("timestamp").alias("bar"), "close")
    out = asof.asof_join(ev, bars.withColumn("at", F.col("bar")), [], "ts", "at", ["bar", "close"])
    return out.select("event_id", "bar", "close")
