"""Venue, variance-premium, dominance, overlay and sizing studies; leads and episodes."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import features as X
from tickloom.functions import windows as V
from tickloom.operators import bars as B
from tickloom.operators import bootstrap as R
from tickloom.operators import episodes as N
from tickloom.operators import metrics
from tickloom.operators import signals as S
from tickloom.operators.cells import Cell, two_group_days
from tickloom.operators.skew import exact_percentiles
from tickloom.plans.oracle import hash_start, over, percentile_rank, rolling, two_group
from tickloom.plans.studies_daily import _case, _obs
from tickloom.registry import query
from tickloom.session import settled, shared, sided
from tickloom.sources import market

# --- incremental features inside momentum subsets ---------------------------------------------------


@query("study_incremental_features", "E23a-b F7 F17", over("walk_1d funding", two_group(f"""
WITH a AS (SELECT symbol, day, close, close / lag(close) OVER w - 1 AS ret, close / lag(close, 90) OVER w - 1 AS r90, lead(close, 7) OVER w / close - 1 AS fwd7 FROM walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 b0 AS (SELECT *, {rolling('stddev_samp', 'ret', 30, -1)} AS vol30 FROM a), b AS (SELECT *, ret / NULLIF(vol30, 0) AS z FROM b0 WHERE r90 IS NOT NULL AND vol30 IS NOT NULL AND fwd7 IS NOT NULL),
 f0 AS (SELECT symbol, day, round(sum(rate), 12) AS x FROM funding GROUP BY symbol, day), f AS (SELECT symbol, day, {percentile_rank('x', 90)} AS fp FROM f0),
 g AS (SELECT b.*, fp FROM b JOIN f ON b.symbol = f.symbol AND b.day = f.day WHERE r90 > 0 AND fp IS NOT NULL), """ + _obs(
    ("shock_when_flat", "b WHERE r90 <= 0", _case("z >= 2", "fwd7"), _case("z < 2", "fwd7")),
    ("funding_when_long", "g", _case("fp >= 0.9", "fwd7"), _case("fp > 0.1 AND fp < 0.9", "fwd7"))), seed=231)))
def study_incremental_features(spark, sf_dir):
    """Shocks inside the momentum-flat subset, funding inside the momentum-long subset."""
    p = X.panel(
        market.walk_1d(spark, sf_dir), [[X.momentum(90), X.vol_before(30, "vol30"), X.forward_return(7)]],
        base=("symbol", "day", "close", "ret"), drop_nulls=["r90", "vol30", "fwd7"],
    ).withColumn("z", F.try_divide("ret", "vol30"))
    fund = B.funding_by_day(market.funding(spark, sf_dir)).withColumn("funding", F.round("funding", 12))
    fund = fund.select("symbol", "day", V.trailing_percentile("funding", 90).alias("fp"))
    j = p.join(fund, ["symbol", "day"], "left")
    y, long = F.col("fwd7"), (F.col("r90") > 0) & F.col("fp").isNotNull()
    cells = [
        Cell("shock_when_flat", y, F.col("z") >= 2, F.col("z") < 2, F.col("r90") <= 0),
        Cell("funding_when_long", y, F.col("fp") >= 0.9, (F.col("fp") > 0.1) & (F.col("fp") < 0.9), long),
    ]
    return R.two_group_ci(two_group_days(j, cells), seed=231)


# --- cross-venue ----------------------------------------------------------------------------------------

SIGNALS = ("raw_premium", "adj_premium", "dispersion", "peg")
PCT, VENUE_H, GAP, FLOOR = 90, (1, 7, 30), 7, 1000.0


def venue_panel(spark, sf_dir):
    """Three venues and the peg on one row per symbol-day, signals, ranks inside segments.

    The three legs come from one aggregate pivoted by venue, so nothing is self-joined.
    """
    legs = market.venue_1d(spark, sf_dir).groupBy("symbol", "day").pivot("venue", ["A", "N", "R"]).agg(
        F.first("close").alias("close"), F.first("quote_volume").alias("qv")
    ).dropna()
    floor = legs.groupBy("symbol").agg(
        F.least(*(F.percentile(f"{v}_qv", F.lit(0.5)) for v in "ANR")).alias("floor")
    ).where(F.col("floor") >= FLOOR)
    df = legs.join(floor.select("symbol"), "symbol").join(
        market.peg_1d(spark, sf_dir).select("day", F.log("close").alias("g")), "day"
    )
    b, o, c, g = F.log("A_close"), F.log("N_close"), F.log("R_close"), F.col("g")
    trio = [c, b + g, o + g]
    mean = (trio[0] + trio[1] + trio[2]) / 3
    var = sum(((t - mean) * (t - mean) for t in trio[1:]), (trio[0] - mean) * (trio[0] - mean)) / 2
    df = df.select(
        "symbol", "day", F.col("A_close").alias("close"),
        F.round(c - b, 12).alias("raw_premium"), F.round(c - (b + g), 12).alias("adj_premium"),
        F.round(F.sqrt(var), 12).alias("dispersion"), F.round(g, 12).alias("peg"),
    )
    df = N.segments(df, GAP, PCT + max(VENUE_H))
    w = W.partitionBy("symbol", "segment").orderBy("day")
    df = df.withColumns({f"pct_{s}": V.trailing_percentile(s, PCT, w) for s in SIGNALS})
    feats = [X.forward_return(h, w=w) for h in VENUE_H]
    trail = {f"trail{k}": F.try_divide(F.col("close"), F.lag("close", k).over(w)) - 1 for k in (1, 7)}
    return df.withColumns({**{f.name: f.expr for f in feats}, **trail})


_VENUE = f"""WITH l AS (SELECT symbol, day, max(close) FILTER (WHERE venue = 'A') AS ca, max(close) FILTER (WHERE venue = 'N') AS cn, max(close) FILTER (WHERE venue = 'R') AS cr,
  max(quote_volume) FILTER (WHERE venue = 'A') AS qa, max(quote_volume) FILTER (WHERE venue = 'N') AS qn, max(quote_volume) FILTER (WHERE venue = 'R') AS qr FROM venue_1d GROUP BY symbol, day),
 l2 AS (SELECT * FROM l WHERE ca IS NOT NULL AND cn IS NOT NULL AND cr IS NOT NULL),
 fl AS (SELECT symbol FROM l2 GROUP BY symbol HAVING least(median(qa), median(qn), median(qr)) >= {FLOOR}),
 j AS (SELECT l2.symbol, l2.day, ca AS close, ln(ca) AS b, ln(cn) AS o, ln(cr) AS c, ln(p.close) AS g FROM l2 JOIN fl ON l2.symbol = fl.symbol JOIN peg_1d p ON l2.day = p.day),
 s AS (SELECT symbol, day, close, round(c - b, 12) AS raw_premium, round(c - (b + g), 12) AS adj_premium, round(list_stddev_samp([c, b + g, o + g]), 12) AS dispersion, round(g, 12) AS peg FROM j),
 br AS (SELECT *, CASE WHEN date_diff('day', lag(day) OVER w, day) > {GAP} THEN 1 ELSE 0 END AS nb FROM s WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 sg AS (SELECT *, sum(nb) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS seg FROM br),
 sz AS (SELECT *, count(*) OVER (PARTITION BY symbol, seg) AS sn FROM sg),
 v AS (SELECT *, {", ".join(f"lead(close, {h}) OVER w / close - 1 AS fwd{h}" for h in VENUE_H)}, close / lag(close, 1) OVER w - 1 AS trail1, close / lag(close, 7) OVER w - 1 AS trail7,
  {", ".join(f"{percentile_rank(s, PCT, by='symbol, seg')} AS pct_{s}" for s in SIGNALS)} FROM sz WHERE sn > {PCT + max(VENUE_H)} WINDOW w AS (PARTITION BY symbol, seg ORDER BY day))"""


def _venue_cells():
    return [
        Cell(f"{s}_{h}d", F.col(f"fwd{h}"), F.col(f"pct_{s}") >= 0.90, F.col(f"pct_{s}") <= 0.10,
             F.col(f"fwd{h}").isNotNull() & F.col(f"pct_{s}").isNotNull())
        for s in SIGNALS for h in VENUE_H
    ]


@query("study_cross_venue", "E68 F30 F31 S10 G1 J1", over("venue_1d peg_1d", two_group(_VENUE + ", " + _obs(*[
    (f"{s}_{h}d", f"v WHERE fwd{h} IS NOT NULL AND pct_{s} IS NOT NULL", _case(f"pct_{s} >= 0.90", f"fwd{h}"), _case(f"pct_{s} <= 0.10", f"fwd{h}"))
    for s in SIGNALS for h in VENUE_H]), n_boot=5000, seed=68)))
def study_cross_venue(spark, sf_dir):
    """Four signals by three horizons, high against low readings."""
    return R.two_group_ci(two_group_days(venue_panel(spark, sf_dir), _venue_cells()), n_boot=5000, seed=68)


@query("venue_breadth", "G8 E68", over("venue_1d peg_1d", _VENUE + ", e AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS signal, symbol, avg(CASE WHEN pct_{s} >= 0.90 THEN fwd7 END) - avg(CASE WHEN pct_{s} <= 0.10 THEN fwd7 END) AS d FROM v WHERE fwd7 IS NOT NULL AND pct_{s} IS NOT NULL GROUP BY symbol"
    for s in SIGNALS) + """),
 pl AS (""" + " UNION ALL ".join(
    f"SELECT '{s}' AS signal, avg(CASE WHEN pct_{s} >= 0.90 THEN fwd7 END) - avg(CASE WHEN pct_{s} <= 0.10 THEN fwd7 END) AS p FROM v WHERE fwd7 IS NOT NULL AND pct_{s} IS NOT NULL"
    for s in SIGNALS) + """)
SELECT e.signal, count(d) AS total, count(*) FILTER (WHERE d * (CASE WHEN p >= 0 THEN 1 ELSE -1 END) > 0) AS agree, R6(max(p)) AS pooled FROM e JOIN pl ON e.signal = pl.signal GROUP BY e.signal"""))
def venue_breadth(spark, sf_dir):
    """How many symbols share the pooled sign: sums by (signal, symbol), pooled by a window."""
    p = venue_panel(spark, sf_dir)
    rows = [F.struct(F.lit(s).alias("signal"), F.col(f"pct_{s}").alias("pct")) for s in SIGNALS]
    long = p.select("symbol", "fwd7", F.inline(F.array(*rows))).dropna(subset=["fwd7", "pct"])
    hi, lo = F.when(F.col("pct") >= 0.90, F.col("fwd7")), F.when(F.col("pct") <= 0.10, F.col("fwd7"))
    sums = long.groupBy("signal", "symbol").agg(
        F.sum(hi).alias("hs"), F.count(hi).alias("hn"), F.sum(lo).alias("ls"), F.count(lo).alias("ln")
    )
    d = F.try_divide("hs", "hn") - F.try_divide("ls", "ln")
    w = W.partitionBy("signal")
    tot = sums.withColumn("d", d).withColumn(
        "pooled", F.try_divide(F.sum("hs").over(w), F.sum("hn").over(w)) - F.try_divide(F.sum("ls").over(w), F.sum("ln").over(w))
    )
    return tot.groupBy("signal").agg(
        F.count("d").alias("total"),
        F.count_if(F.col("d") * F.when(F.col("pooled") >= 0, 1).otherwise(-1) > 0).alias("agree"),
        F.max("pooled").alias("pooled"),
    )


@query("venue_by_year", "G9 E68", over("venue_1d peg_1d", _VENUE + """
SELECT year(day) AS year, count(DISTINCT symbol) AS symbols, count(*) AS symbol_days, R6(avg(CASE WHEN pct_raw_premium >= 0.90 THEN fwd7 END) - avg(CASE WHEN pct_raw_premium <= 0.10 THEN fwd7 END)) AS diff
FROM v WHERE fwd7 IS NOT NULL AND pct_raw_premium IS NOT NULL GROUP BY 1"""))
def venue_by_year(spark, sf_dir):
    p = venue_panel(spark, sf_dir).dropna(subset=["fwd7", "pct_raw_premium"])
    pct, y = F.col("pct_raw_premium"), F.col("fwd7")
    return p.groupBy(F.year("day").alias("year")).agg(
        F.count_distinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("symbol_days"),
        (F.avg(F.when(pct >= 0.90, y)) - F.avg(F.when(pct <= 0.10, y))).alias("diff"),
    )


def leave_out(panel, signal: str, y: str, drop: int = 2):
    """Pooled effect with and without the ``drop`` symbols contributing most, from one aggregate."""
    pct = F.col(f"pct_{signal}")
    hi, lo = F.when(pct >= 0.90, F.col(y)), F.when(pct <= 0.10, F.col(y))
    per = panel.dropna(subset=[y, f"pct_{signal}"]).groupBy("symbol").agg(
        F.sum(hi).alias("hs"), F.count(hi).alias("hn"), F.sum(lo).alias("ls"), F.count(lo).alias("ln")
    )
    per = per.withColumn("d", F.try_divide("hs", "hn") - F.try_divide("ls", "ln"))
    # One row per symbol here, so ranking them in one window is bounded by the listing count.
    per = per.withColumn("rk", F.row_number().over(W.orderBy(F.col("d").desc_nulls_last(), F.col("symbol").desc())))

    def pooled(keep):
        s = {c: F.sum(F.when(keep, F.col(c))) for c in ("hs", "hn", "ls", "ln")}
        return F.try_divide(s["hs"], s["hn"]) - F.try_divide(s["ls"], s["ln"])

    return per.agg(
        pooled(F.lit(True)).alias("all_names"), pooled(F.col("rk") > drop).alias("without_top"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("rk") <= drop, F.col("symbol")))), ",").alias("dropped"),
    )


@query("venue_leave_out", "G9 K10", over("venue_1d peg_1d", _VENUE + """,
 q AS (SELECT * FROM v WHERE fwd7 IS NOT NULL AND pct_raw_premium IS NOT NULL),
 c AS (SELECT symbol, row_number() OVER (ORDER BY avg(CASE WHEN pct_raw_premium >= 0.90 THEN fwd7 END) - avg(CASE WHEN pct_raw_premium <= 0.10 THEN fwd7 END) DESC NULLS LAST, symbol DESC) AS rk FROM q GROUP BY symbol),
 t AS (SELECT q.*, rk FROM q JOIN c ON q.symbol = c.symbol)
SELECT R6(avg(CASE WHEN pct_raw_premium >= 0.90 THEN fwd7 END) - avg(CASE WHEN pct_raw_premium <= 0.10 THEN fwd7 END)) AS all_names,
 R6(avg(CASE WHEN rk > 2 AND pct_raw_premium >= 0.90 THEN fwd7 END) - avg(CASE WHEN rk > 2 AND pct_raw_premium <= 0.10 THEN fwd7 END)) AS without_top,
 (SELECT string_agg(symbol, ',' ORDER BY symbol) FROM c WHERE rk <= 2) AS dropped FROM t"""))
def venue_leave_out(spark, sf_dir):
    return leave_out(venue_panel(spark, sf_dir), "raw_premium", "fwd7")


@query("venue_momentum_overlap", "G2 G3 E68", over("venue_1d peg_1d", _VENUE + """,
 q AS (SELECT quantile_cont(trail7, 0.1) AS lo, quantile_cont(trail7, 0.9) AS hi FROM v),
 t AS (SELECT v.*, trail7 BETWEEN lo AND hi AS mid FROM v, q)
SELECT R6(corr(CASE WHEN trail7 IS NOT NULL THEN raw_premium END, trail1)) AS corr1, R6(corr(raw_premium, trail7)) AS corr7, count(*) FILTER (WHERE mid) AS kept,
 R6(avg(CASE WHEN mid AND pct_raw_premium >= 0.90 THEN fwd7 END) - avg(CASE WHEN mid AND pct_raw_premium <= 0.10 THEN fwd7 END)) AS trimmed_diff FROM t"""))
def venue_momentum_overlap(spark, sf_dir):
    """Correlation with trailing returns, and the effect with the extreme deciles removed."""
    p = shared(venue_panel(spark, sf_dir))
    cuts = exact_percentiles(p, [], "trail7", {"lo": 0.1, "hi": 0.9})
    t = p.withColumn("q", cuts.select(F.array("lo", "hi")).scalar())
    mid = F.coalesce(F.col("trail7").between(F.col("q")[0], F.col("q")[1]), F.lit(False))
    pct, y = F.col("pct_raw_premium"), F.col("fwd7")
    return t.agg(
        F.corr(F.when(F.col("trail7").isNotNull(), F.col("raw_premium")), F.col("trail1")).alias("corr1"),
        F.corr("raw_premium", "trail7").alias("corr7"), F.count_if(mid).alias("kept"),
        (F.avg(F.when(mid & (pct >= 0.90), y)) - F.avg(F.when(mid & (pct <= 0.10), y))).alias("trimmed_diff"),
    )


@query("venue_qualifiers", "K7 P15", over("venue_1d peg_1d", _VENUE + """,
 q AS (SELECT day, symbol FROM v WHERE pct_adj_premium >= 0.90),
 n AS (SELECT day, count(*) AS n FROM q GROUP BY day),
 leg AS (SELECT q.symbol, CAST(q.day + INTERVAL 1 DAY * a AS DATE) AS day, (1.0 / 7) / n AS w FROM q JOIN n ON q.day = n.day, (SELECT unnest(range(7)) AS a) r),
 lw AS (SELECT leg.day, leg.symbol, sum(w) AS weight FROM leg WHERE EXISTS (SELECT 1 FROM v WHERE v.day = leg.day AND v.symbol = leg.symbol) GROUP BY 1, 2),
 nm AS (SELECT day, string_agg(symbol, ',' ORDER BY symbol) AS names FROM q GROUP BY day)
SELECT CAST(lw.day AS VARCHAR) AS day, lw.symbol, R6(weight) AS weight, coalesce(names, '') AS qualified FROM lw LEFT JOIN nm ON lw.day = nm.day"""))
def venue_qualifiers(spark, sf_dir):
    """The premium ladder: qualifiers per entry day and the seven-tranche weights."""
    p = venue_panel(spark, sf_dir)
    q = p.where("pct_adj_premium >= 0.90").select("day", "symbol")
    names = q.groupBy("day").agg(F.array_join(F.sort_array(F.collect_list("symbol")), ",").alias("names"))
    ladder = S.tranche_ladder(q, p.select("day", "symbol"), 7)
    return ladder.join(names, "day", "left").select("day", "symbol", "weight", F.coalesce("names", F.lit("")).alias("qualified"))


# --- variance premium -------------------------------------------------------------------------------------

TENOR = 30
VEGA = 2 * (1 / math.sqrt(2 * math.pi)) * math.sqrt(TENOR / 365)


def variance_frame(spark, sf_dir):
    """(symbol, day, k, r, u): an implied-volatility level, log return, row position."""
    w = V.by_symbol()
    df = market.walk_1d(spark, sf_dir).select(
        "symbol", "day", (0.10 + 10 * (F.try_divide("high", "low") - 1)).alias("k"),
        F.log(F.try_divide(F.col("close"), F.lag("close").over(w))).alias("r"),
    ).dropna(subset=["r"])
    return df.withColumn("u", F.row_number().over(w) - 1)


def premium_cells(frame):
    """(cell, symbol, day, ret): short-variance accrual, overlapping ladder and single tranche.

    The ladder's sum over live strikes separates into windowed sums of K/2 and 1/(2K).
    """
    w = V.by_symbol()
    past = w.rowsBetween(-TENOR, -1)
    realized = 365 * F.col("r") * F.col("r")
    block = W.partitionBy("symbol", F.floor((F.col("u") - 1) / TENOR)).orderBy("day")
    rows = frame.withColumn("prev_k", F.lag("k").over(w)).withColumns(
        {
            "ladder": VEGA * (F.sum(F.col("k") / 2).over(past) - realized * F.sum(1 / (2 * F.col("k"))).over(past)) / TENOR**2,
            "strike": F.first("prev_k").over(block),
        }
    )
    single = VEGA * (F.col("strike") * F.col("strike") - realized) / (2 * F.col("strike")) / TENOR
    rows = rows.where(F.col("u") >= TENOR).withColumn("single", single)
    out = [
        F.struct(F.lit(f"{kind}_{h}").alias("cell"), (F.col(kind) - VEGA * h / TENOR).alias("ret"))
        for kind in ("ladder", "single") for h in (0.03, 0.06)
    ]
    return rows.select("symbol", "day", F.inline(F.array(*out)))


def common_book(rows, n_symbols: int):
    """(cell, day, ret): equal weight over the days every symbol has."""
    g = rows.groupBy("cell", "day").agg(F.avg("ret").alias("ret"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") == n_symbols).drop("n")


_VRP = f"""WITH f0 AS (SELECT symbol, day, 0.10 + 10 * (high / low - 1) AS k, ln(close / lag(close) OVER w) AS r FROM walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS u FROM f0 WHERE r IS NOT NULL),
 g AS (SELECT a.symbol, a.day, a.u, {VEGA!r} * (SELECT sum((b.k * b.k - 365 * a.r * a.r) / (2 * b.k)) FROM f b WHERE b.symbol = a.symbol AND b.u BETWEEN a.u - 30 AND a.u - 1) / 900 AS ladder,
   {VEGA!r} * (s.k * s.k - 365 * a.r * a.r) / (2 * s.k) / 30 AS single FROM f a JOIN f s ON s.symbol = a.symbol AND s.u = ((a.u - 1) // 30) * 30 WHERE a.u >= 30),
 c AS ({" UNION ALL ".join(f"SELECT '{kind}_{h}' AS cell, symbol, day, {kind} - {VEGA!r} * {h} / 30 AS ret FROM g" for kind in ("ladder", "single") for h in (0.03, 0.06))}),
 bk AS (SELECT cell, day, avg(ret) AS ret FROM c GROUP BY cell, day HAVING count(*) = 6)"""


@query("variance_premium_book", "E67 F32 J10", over("walk_1d", _VRP + """
SELECT cell, CAST(day AS VARCHAR) AS day, R6(ret) AS ret FROM bk"""))
def variance_premium_book(spark, sf_dir):
    return common_book(premium_cells(variance_frame(spark, sf_dir)), 6)


@query("implied_vs_realised", "F32", over("walk_1d", """
WITH f0 AS (SELECT symbol, day, 0.10 + 10 * (high / low - 1) AS k, ln(close / lag(close) OVER w) AS r FROM walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 f AS (SELECT * FROM f0 WHERE r IS NOT NULL),
 g AS (SELECT *, CASE WHEN count(r) OVER w = 30 THEN avg(r * r) OVER w * 365 END AS rv FROM f WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING))
SELECT symbol, count(*) AS days, R6(avg(k)) AS mean_iv, R6(avg(sqrt(rv))) AS mean_rv, R6(avg(CASE WHEN k > sqrt(rv) THEN 1.0 ELSE 0.0 END)) AS iv_above, R6(avg((k * k - rv) / (2 * k))) AS harvest FROM g WHERE rv IS NOT NULL GROUP BY symbol"""))
def implied_vs_realised(spark, sf_dir):
    """Implied level against the realised variance of the next thirty rows."""
    rv = V.forward(F.avg, F.col("r") * F.col("r"), 30) * 365
    g = variance_frame(spark, sf_dir).withColumn("rv", rv).dropna(subset=["rv"])
    return g.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"), F.avg("k").alias("mean_iv"), F.avg(F.sqrt("rv")).alias("mean_rv"),
        F.avg((F.col("k") > F.sqrt("rv")).cast("double")).alias("iv_above"),
        F.avg((F.col("k") * F.col("k") - F.col("rv")) / (2 * F.col("k"))).alias("harvest"),
    )


# --- a base book, its overlay and its tails ------------------------------------------------------------------


def base_book(bars):
    """(day, ret, exposure): equal-weight screen of the single-name momentum signal."""
    s = bars.select(
        "symbol", "day", S.ret().alias("ret"), S.ts_momentum(30).alias("target")
    )
    held = F.coalesce(F.lag("target").over(V.by_symbol()), F.lit(0.0))
    r = s.select("day", (held * F.coalesce("ret", F.lit(0.0))).alias("r"), F.col("target"))
    return r.groupBy("day").agg(F.avg("r").alias("ret"), F.avg("target").alias("exposure"))


_BASE = """WITH s0 AS (SELECT symbol, day, close / lag(close) OVER w - 1 AS ret, CASE WHEN coalesce(close > lag(close, 30) OVER w, FALSE) THEN 1.0 ELSE 0.0 END AS tg FROM walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 s1 AS (SELECT *, coalesce(lag(tg) OVER (PARTITION BY symbol ORDER BY day), 0) * coalesce(ret, 0) AS r FROM s0),
 base AS (SELECT day, avg(r) AS ret, avg(tg) AS exposure FROM s1 GROUP BY day)"""


def overlay_book(spark, sf_dir, cost: float = 0.0022, trigger: float = -0.01, vol: int = 20):
    """Base book with the idle-cash overlay on days after a leader fall.

    Day windows without a key run over one row per calendar day.
    """
    bars = shared(market.walk_1d(spark, sf_dir).select("symbol", "day", "close"))
    base = base_book(bars)
    r = bars.select("symbol", "day", S.ret().alias("ret"))
    lead = r.where("symbol = 'AF'").select("day", F.col("ret").alias("lead_ret"))
    rest = r.where("symbol <> 'AF' and ret is not null").groupBy("day").agg(F.avg("ret").alias("rest_ret"))
    w = W.orderBy("day")
    df = base.join(lead, "day", "left").join(rest, "day", "left").withColumns(
        {
            "hit": F.coalesce(F.lag("lead_ret").over(w) < trigger, F.lit(False)),
            "idle": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.lag("exposure").over(w))),
            "trail_vol": V.full(F.stddev_samp, "ret", vol, w, end=-1),
        }
    )
    over_ = F.when(F.col("hit"), F.coalesce(F.col("idle") * (F.col("rest_ret") - cost), F.lit(0.0))).otherwise(0.0)
    return df.withColumn("overlay", over_).withColumn("combined", F.col("ret") + F.col("overlay"))


_OVER = _BASE + """,
 ld AS (SELECT day, ret AS lr FROM s0 WHERE symbol = 'AF'), rs AS (SELECT day, avg(ret) AS rr FROM s0 WHERE symbol <> 'AF' GROUP BY day),
 ob0 AS (SELECT b.day, b.ret, coalesce(lag(lr) OVER w < -0.01, FALSE) AS hit, CASE WHEN lag(exposure) OVER w IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - lag(exposure) OVER w)) END AS idle, rr,
   CASE WHEN count(b.ret) OVER (ORDER BY b.day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN stddev_samp(b.ret) OVER (ORDER BY b.day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS tv
   FROM base b LEFT JOIN ld ON b.day = ld.day LEFT JOIN rs ON b.day = rs.day WINDOW w AS (ORDER BY b.day)),
 ob AS (SELECT *, CASE WHEN hit THEN coalesce(idle * (rr - 0.0022), 0) ELSE 0 END AS overlay, ret + CASE WHEN hit THEN coalesce(idle * (rr - 0.0022), 0) ELSE 0 END AS combined FROM ob0)"""

BREACH = -0.01


@query("overlay_census", "E43 J2 G3", over("walk_1d", _OVER + f""",
 h AS (SELECT *, row_number() OVER (ORDER BY tv, day) - 1 AS i, count(*) OVER () AS n FROM ob WHERE hit AND tv IS NOT NULL),
 q AS (SELECT *, (5 * (i + 1) - 1) // n AS quint FROM h)
SELECT CAST(quint + 1 AS INTEGER) AS quintile, count(*) AS days, R6(min(tv)) AS vol_lo, R6(max(tv)) AS vol_hi, count(*) FILTER (WHERE combined <= {BREACH}) AS breaches, R6(sum(overlay)) AS overlay_sum, R6(avg(idle)) AS mean_idle FROM q GROUP BY quint"""))
def overlay_census(spark, sf_dir):
    """Trigger days in position quintiles of trailing volatility.

    Bucket k holds positions floor(nk/5) .. floor(n(k+1)/5)-1, which is not ``ntile`` when the
    count is not a multiple of five.
    """
    h = overlay_book(spark, sf_dir).where("hit and trail_vol is not null")
    w = W.orderBy("trail_vol", "day")
    h = h.withColumns({"i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(W.partitionBy())})
    quint = F.floor((5 * (F.col("i") + 1) - 1) / F.col("n")).cast("int")
    return h.groupBy((quint + 1).alias("quintile")).agg(
        F.count(F.lit(1)).alias("days"), F.min("trail_vol").alias("vol_lo"), F.max("trail_vol").alias("vol_hi"),
        F.count_if(F.col("combined") <= BREACH).alias("breaches"), F.sum("overlay").alias("overlay_sum"), F.avg("idle").alias("mean_idle"),
    )


CUTS = (0, 5, 10, 20, 30, 40, 50, 75, 100)


@query("overlay_shrink_curve", "E43 S6", over("walk_1d", _OVER + f""",
 h AS (SELECT *, row_number() OVER (ORDER BY tv, day) - 1 AS i, count(*) OVER () AS n FROM ob WHERE hit AND tv IS NOT NULL),
 x AS (SELECT unnest({list(CUTS)}) AS x)
SELECT CAST(x AS INTEGER) AS x, R6(sum(CASE WHEN i < n - n * x // 100 THEN overlay ELSE 0 END)) AS kept_top, count(*) FILTER (WHERE CASE WHEN i < n - n * x // 100 THEN combined ELSE combined - overlay END <= {BREACH}) AS breaches_top,
 R6(sum(CASE WHEN i >= n * x // 100 THEN overlay ELSE 0 END)) AS kept_bottom, count(*) FILTER (WHERE CASE WHEN i >= n * x // 100 THEN combined ELSE combined - overlay END <= {BREACH}) AS breaches_bottom FROM h, x GROUP BY x"""))
def overlay_shrink_curve(spark, sf_dir):
    """What is kept when the overlay is switched off on the top or bottom share by volatility.

    No trigger days, no rows.
    """
    h = overlay_book(spark, sf_dir).where("hit and trail_vol is not null")
    h = h.withColumns({"i": F.row_number().over(W.orderBy("trail_vol", "day")) - 1, "n": F.count(F.lit(1)).over(W.partitionBy())})
    aggs = []
    for x in CUTS:
        cut = F.floor(F.col("n") * x / 100)
        for side, on in (("top", F.col("i") < F.col("n") - cut), ("bottom", F.col("i") >= cut)):
            aggs += [
                F.sum(F.when(on, F.col("overlay")).otherwise(0.0)).alias(f"k_{side}{x}"),
                F.count_if(F.when(on, F.col("combined")).otherwise(F.col("combined") - F.col("overlay")) <= BREACH).alias(f"b_{side}{x}"),
            ]
    rows = [
        F.struct(
            F.lit(x).alias("x"), F.col(f"k_top{x}").alias("kept_top"), F.col(f"b_top{x}").alias("breaches_top"),
            F.col(f"k_bottom{x}").alias("kept_bottom"), F.col(f"b_bottom{x}").alias("breaches_bottom"),
        )
        for x in CUTS
    ]
    return h.agg(F.count(F.lit(1)).alias("days"), *aggs).where("days > 0").select(F.inline(F.array(*rows)))


@query("tail_dependence", "G11 J11", over("walk_1d", _OVER + """,
 vr AS (SELECT day, avg(close / open - 1) AS v FROM walk_1d GROUP BY day), j AS (SELECT ob.day, ob.ret AS a, vr.v AS b FROM ob JOIN vr ON ob.day = vr.day),
 t AS (SELECT 0.10 AS q, quantile_cont(a, 0.10) AS th FROM j UNION ALL SELECT 0.05, quantile_cont(a, 0.05) FROM j UNION ALL SELECT 0.01, quantile_cont(a, 0.01) FROM j)
SELECT R6(t.q) AS q, count(*) FILTER (WHERE a <= th) AS n, R6(avg(b) FILTER (WHERE a <= th)) AS mean_b, R6(avg(b)) AS mean_all, R6(corr(a, b)) AS corr,
 R6(avg(CASE WHEN a < 0 AND b < 0 THEN 1.0 ELSE 0.0 END)) AS both_lose, R6(avg(CASE WHEN a < 0 THEN 1.0 ELSE 0.0 END) * avg(CASE WHEN b < 0 THEN 1.0 ELSE 0.0 END)) AS if_independent FROM j, t GROUP BY t.q, th"""))
def tail_dependence(spark, sf_dir):
    """A second stream on the base book's worst days, joined on the day and never on position."""
    base = overlay_book(spark, sf_dir).select("day", F.col("ret").alias("a"))
    other = market.walk_1d(spark, sf_dir).groupBy("day").agg(F.avg(F.try_divide("close", "open") - 1).alias("b"))
    j = shared(base.join(other, "day"))
    qs = (0.10, 0.05, 0.01)
    cuts = j.agg(F.percentile("a", F.array(*(F.lit(q) for q in qs))))
    rows = [F.struct(F.lit(q).alias("q"), F.col("th")[i].alias("cut")) for i, q in enumerate(qs)]
    t = j.withColumn("th", cuts.scalar()).select("a", "b", F.inline(F.array(*rows)))
    bad = F.col("a") <= F.col("cut")
    lose = lambda c: (F.col(c) < 0).cast("double")
    return t.groupBy("q").agg(
        F.count_if(bad).alias("n"), F.avg(F.when(bad, F.col("b"))).alias("mean_b"), F.avg("b").alias("mean_all"), F.corr("a", "b").alias("corr"),
        F.avg(lose("a") * lose("b")).alias("both_lose"), (F.avg(lose("a")) * F.avg(lose("b"))).alias("if_independent"),
    )


@query("leverage_table", "EOC R13", over("walk_1d", _OVER + """,
 k AS (SELECT unnest([1.0, 2.0, 3.0, 5.0]) AS k), l AS (SELECT k, day, k * combined - (k - 1) * 0.0005 AS r, row_number() OVER (PARTITION BY k ORDER BY day) - 1 AS i FROM ob, k),
 e AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY k ORDER BY day ROWS UNBOUNDED PRECEDING)) AS eq,
   CASE WHEN count(*) OVER f = 30 THEN exp(sum(ln(1 + r)) OVER f) - 1 END AS m30, count(*) OVER (PARTITION BY k) AS n FROM l WINDOW f AS (PARTITION BY k ORDER BY day ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
 d AS (SELECT *, eq / greatest(1.0, max(eq) OVER (PARTITION BY k ORDER BY day ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM e)
SELECT R6(k) AS k, count(*) AS days, R6(pow(max_by(eq, day), 365.0 / count(*)) - 1) AS cagr, R6(min(dd)) AS max_drawdown, R6(avg(m30) FILTER (WHERE i % 5 = 0 AND i < n - 30)) AS mean30,
 R6(avg(CASE WHEN m30 >= 0.02 THEN 1.0 ELSE 0.0 END) FILTER (WHERE i % 5 = 0 AND i < n - 30)) AS hit30, R6(avg(CASE WHEN m30 <= -0.02 THEN 1.0 ELSE 0.0 END) FILTER (WHERE i % 5 = 0 AND i < n - 30)) AS blow30,
 R6(min(m30) FILTER (WHERE i % 5 = 0 AND i < n - 30)) AS worst30 FROM d GROUP BY k"""))
def leverage_table(spark, sf_dir):
    """Financed leverage of the combined book: growth, drawdown, thirty-day windows stepped by five."""
    ks = F.array(*(F.lit(k) for k in (1.0, 2.0, 3.0, 5.0)))
    l = overlay_book(spark, sf_dir).select("day", "combined", F.explode(ks).alias("k"))
    w = W.partitionBy("k").orderBy("day")
    run, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, 29)
    r = F.col("k") * F.col("combined") - (F.col("k") - 1) * 0.0005
    d = l.withColumns({"lr": F.log1p(r), "i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(W.partitionBy("k"))})
    d = d.withColumns(
        {"eq": F.exp(F.sum("lr").over(run)), "m30": F.when(F.count("lr").over(ahead) == 30, F.exp(F.sum("lr").over(ahead)) - 1)}
    ).withColumn("dd", F.col("eq") / F.greatest(F.lit(1.0), F.max("eq").over(run)) - 1)
    m = F.when((F.col("i") % 5 == 0) & (F.col("i") < F.col("n") - 30), F.col("m30"))
    return d.groupBy("k").agg(
        F.count(F.lit(1)).alias("days"), (F.pow(F.max_by("eq", "day"), 365.0 / F.count(F.lit(1))) - 1).alias("cagr"), F.min("dd").alias("max_drawdown"),
        F.avg(m).alias("mean30"), F.avg((m >= 0.02).cast("double")).alias("hit30"), F.avg((m <= -0.02).cast("double")).alias("blow30"), F.min(m).alias("worst30"),
    )


def resampled_paths(days, k: int, block: int, n_boot: int, seed: int):
    """(draw, ret): compounded return of ``k``-day paths glued from resampled blocks.

    Only ceil(k / block) blocks are drawn; the last one is cut to length, so a path is a join of
    its (start, length) pieces with a table of block growths.
    """
    days, n = settled(days)
    w = W.orderBy("day")  # one row per calendar day
    n_blocks = -(-k // block)
    tail = k - (n_blocks - 1) * block
    pieces = days.select(
        (F.row_number().over(w) - 1).alias("start"),
        F.sum(F.log1p("ret")).over(w.rowsBetween(0, block - 1)).alias("g_full"),
        F.sum(F.log1p("ret")).over(w.rowsBetween(0, tail - 1)).alias("g_tail"),
    )
    spark = days.sparkSession
    draws = spark.range(n_boot).select(F.col("id").cast("int").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("blk"))
    picks = draws.select("draw", "blk", R.hashed_start(seed, F.col("draw"), F.col("blk"), F.lit(n - block + 1)).alias("start"))
    g = F.when(F.col("blk") == n_blocks - 1, F.col("g_tail")).otherwise(F.col("g_full"))
    return picks.join(sided(pieces, n), "start").groupBy("draw").agg((F.exp(F.sum(g)) - 1).alias("ret"))


LIVE_DAYS = 26


@query("live_window_consistency", "E59 R6 K10", over("walk_1d", _OVER + f""",
 d AS (SELECT day, ret, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM ob),
 live AS (SELECT exp(sum(ln(1 + ret))) - 1 AS live FROM d WHERE i >= n - {LIVE_DAYS}),
 h AS (SELECT day, ret, i, count(*) OVER () AS n FROM d WHERE i < n - {LIVE_DAYS}),
 o AS (SELECT exp(sum(ln(1 + ret)) OVER f) - 1 AS r, count(*) OVER f AS c FROM h WINDOW f AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND {LIVE_DAYS - 1} FOLLOWING)),
 p AS (SELECT draw, blk, {hash_start(59, '(SELECT max(n) FROM h)', 5)} AS s FROM (SELECT unnest(range(10000)) AS draw) a, (SELECT unnest(range(6)) AS blk) b),
 bs AS (SELECT draw, exp(sum(ln(1 + ret))) - 1 AS r FROM p JOIN h ON h.i BETWEEN p.s AND p.s + CASE WHEN blk = 5 THEN 0 ELSE 4 END GROUP BY draw)
SELECT R6((SELECT live FROM live)) AS live, (SELECT count(*) FROM o WHERE c = {LIVE_DAYS}) AS windows, R6((SELECT avg(CASE WHEN r <= live THEN 1.0 ELSE 0.0 END) FROM o, live WHERE c = {LIVE_DAYS})) AS overlap_share,
 R6((SELECT avg(CASE WHEN r <= live THEN 1.0 ELSE 0.0 END) FROM bs, live)) AS resampled_share,
 CASE WHEN (SELECT avg(CASE WHEN r <= live THEN 1.0 ELSE 0.0 END) FROM bs, live) >= 0.05 THEN 'CONSISTENT' WHEN (SELECT avg(CASE WHEN r <= live THEN 1.0 ELSE 0.0 END) FROM bs, live) >= 0.01 THEN 'WATCH' ELSE 'INCONSISTENT' END AS verdict"""))
def live_window_consistency(spark, sf_dir):
    """The newest stretch against overlapping and resampled windows of the book's own history."""
    w = W.orderBy("day")
    d = overlay_book(spark, sf_dir).select("day", "ret")
    d = shared(d.withColumn("left", F.count(F.lit(1)).over(w.rowsBetween(0, W.unboundedFollowing))))
    hist = d.where(F.col("left") > LIVE_DAYS).select("day", "ret")
    live = d.where(F.col("left") <= LIVE_DAYS).agg(F.exp(F.sum(F.log1p("ret"))) - 1)
    ahead = w.rowsBetween(0, LIVE_DAYS - 1)
    overlap = hist.select(F.when(F.count("ret").over(ahead) == LIVE_DAYS, F.exp(F.sum(F.log1p("ret")).over(ahead)) - 1).alias("r")).dropna()
    drawn = resampled_paths(hist, LIVE_DAYS, 5, 10_000, 59)
    both = overlap.select(F.lit("overlap").alias("kind"), "r").unionByName(drawn.select(F.lit("drawn").alias("kind"), F.col("ret").alias("r")))
    j = both.withColumn("live", live.scalar())
    at = lambda kind: F.avg(F.when(F.col("kind") == kind, (F.col("r") <= F.col("live")).cast("double")))
    out = j.agg(F.first("live").alias("live"), F.count_if(F.col("kind") == "overlap").alias("windows"), at("overlap").alias("overlap_share"), at("drawn").alias("resampled_share"))
    p = F.col("resampled_share")
    return out.withColumn("verdict", F.when(p >= 0.05, "CONSISTENT").when(p >= 0.01, "WATCH").otherwise("INCONSISTENT"))


# --- dominance ---------------------------------------------------------------------------------------------


def dominance_frame(spark, sf_dir):
    """(day, lead, rest, market, dominance): one row per day the leader trades."""
    bars = shared(market.walk_1d(spark, sf_dir).select("symbol", "day", "close"))
    level = lambda df, n: B.chained_index(df).select("day", F.col("level").alias(n))
    lead = bars.where("symbol = 'AF'").select("day", F.col("close").alias("lead"))
    df = lead.join(level(bars.where("symbol <> 'AF'"), "rest"), "day").join(level(bars, "market"), "day")
    return df.withColumn("dominance", F.try_divide("lead", "rest"))


def dominance_labels(df):
    w = W.orderBy("day")  # one row per calendar day
    rel = X.relative_forward_difference(30, "lead", "rest", "fwd_rel", w)
    return df.withColumns(
        {
            "fwd_rel": rel.expr, "lead_fwd": X.forward_return(30, "lead", w=w).expr, "rest_fwd": X.forward_return(30, "rest", w=w).expr,
            "trend_up": F.col("market") > F.lag("market", 90).over(w),
            **{f"rise{n}": F.col("dominance") > F.lag("dominance", n).over(w) for n in (7, 30, 90)},
        }
    )


def _idx(name: str, where: str) -> str:
    return f"""cal{name} AS (SELECT day, row_number() OVER (ORDER BY day) AS o FROM (SELECT DISTINCT day FROM walk_1d WHERE {where}) d),
 r{name} AS (SELECT a.day, a.close / b.close - 1 AS ret FROM (SELECT w.*, o FROM walk_1d w JOIN cal{name} c ON w.day = c.day WHERE {where}) a LEFT JOIN (SELECT w.*, o FROM walk_1d w JOIN cal{name} c ON w.day = c.day WHERE {where}) b ON a.symbol = b.symbol AND a.o = b.o + 1),
 x{name} AS (SELECT day, 100 * exp(sum(ln(1 + coalesce(m, 0))) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)) AS level FROM (SELECT day, avg(ret) AS m FROM r{name} GROUP BY day) q)"""


_DOM = f"""WITH {_idx('a', "symbol <> 'AF'")}, {_idx('b', "TRUE")},
 f AS (SELECT w.day, w.close AS lead, xa.level AS rest, xb.level AS market, w.close / xa.level AS dom FROM walk_1d w JOIN xa ON w.day = xa.day JOIN xb ON w.day = xb.day WHERE w.symbol = 'AF'),
 g AS (SELECT *, (lead(lead, 30) OVER w / lead - 1) - (lead(rest, 30) OVER w / rest - 1) AS fr, lead(lead, 30) OVER w / lead - 1 AS lf, lead(rest, 30) OVER w / rest - 1 AS rf, market > lag(market, 90) OVER w AS up,
   dom > lag(dom, 7) OVER w AS rise7, dom > lag(dom, 30) OVER w AS rise30, dom > lag(dom, 90) OVER w AS rise90 FROM f WINDOW w AS (ORDER BY day))"""


@query("study_dominance", "EV2 B3 B4 F6 R5", over("walk_1d", two_group(_DOM + ", " + _obs(*[
    (f"rise{n}", f"g WHERE fr IS NOT NULL AND rise{n} IS NOT NULL", _case(f"rise{n}", "fr"), _case(f"NOT rise{n}", "fr")) for n in (7, 30, 90)]), block=60, n_boot=5000, seed=2)))
def study_dominance(spark, sf_dir):
    """Relative forward return when dominance rises against when it falls."""
    df = dominance_labels(dominance_frame(spark, sf_dir))
    rows = [F.struct(F.lit(f"rise{n}").alias("cell"), F.col(f"rise{n}").alias("flag")) for n in (7, 30, 90)]
    obs = df.select("day", F.col("fwd_rel").alias("v"), F.inline(F.array(*rows))).dropna(subset=["v", "flag"])
    return R.flag_split_ci(obs, block=60, n_boot=5000, seed=2)


@query("dominance_quadrants", "G10 EV2", over("walk_1d", _DOM + """
SELECT up AS trend_up, rise30 AS rising, count(*) AS n, R6(avg(lf)) AS lead_fwd, R6(avg(rf)) AS rest_fwd FROM g WHERE lf IS NOT NULL AND rf IS NOT NULL AND up IS NOT NULL AND rise30 IS NOT NULL GROUP BY 1, 2"""))
def dominance_quadrants(spark, sf_dir):
    df = dominance_labels(dominance_frame(spark, sf_dir)).dropna(subset=["lead_fwd", "rest_fwd", "trend_up", "rise30"])
    return df.groupBy("trend_up", F.col("rise30").alias("rising")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("lead_fwd").alias("lead_fwd"), F.avg("rest_fwd").alias("rest_fwd")
    )


# --- leads, episodes, conditions ---------------------------------------------------------------------------

_Z = """{p}1 AS (SELECT *, CASE WHEN count(x) OVER w = 90 THEN median(x) OVER w END AS med FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)),
 {p}2 AS (SELECT *, abs(lag(x) OVER (PARTITION BY symbol ORDER BY day) - med) AS dv FROM {p}1),
 {p}3 AS (SELECT *, CASE WHEN count(dv) OVER w = 90 THEN median(dv) OVER w END AS mad FROM {p}2 WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)),
 {p}4 AS (SELECT *, (x - med) / NULLIF(mad * 1.4826, 0) AS z FROM {p}3)"""


@query("lead_scan", "N1 N2 N3 N4 F21 G14", over("walk_wk", """
WITH r AS (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM walk_wk),
 v0 AS (SELECT symbol, day, abs(ret) AS x FROM r),
 """ + _Z.format(p="v", src="v0") + """,
 d0 AS (SELECT 'cross-section' AS symbol, day, stddev_samp(ret) AS x FROM r WHERE ret IS NOT NULL GROUP BY day HAVING count(*) >= 5),
 """ + _Z.format(p="d", src="d0") + """,
 c0 AS (SELECT 'cross-section' AS symbol, day, abs(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) - 0.5) * 2 AS x FROM r WHERE ret IS NOT NULL GROUP BY day HAVING count(*) >= 5),
 """ + _Z.format(p="c", src="c0") + """
SELECT 'volatility' AS kind, CAST(day AS VARCHAR) AS day, symbol AS scope, R6(abs(z)) AS severity, R6(x) AS observed FROM v4 WHERE abs(z) > 2.5
UNION ALL SELECT 'dispersion', CAST(day AS VARCHAR), symbol, R6(abs(z)), R6(x) FROM d4 WHERE abs(z) > 2.5
UNION ALL SELECT 'comovement', CAST(day AS VARCHAR), symbol, R6(abs(z)), R6(x) FROM c4 WHERE z > 2.5"""))
def lead_scan(spark, sf_dir):
    """Leads of the three detectors over the weekly panel."""
    p = X.panel(market.walk_wk(spark, sf_dir), [], base=("symbol", "day", "ret"))
    return N.scan(p, window=90, threshold=2.5)


@query("drawdown_episodes", "N5 F30", over("walk_1d", """
WITH a AS (SELECT symbol, day, close / lag(close) OVER w - 1 AS ret, close / max(close) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 <= -0.05 AS c FROM walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) - row_number() OVER (PARTITION BY symbol, c ORDER BY day) AS g FROM a)
SELECT symbol, CAST(min(day) AS VARCHAR) AS start, CAST(max(day) AS VARCHAR) AS "end", count(*) AS days, R6(sum(coalesce(ret, 0)) / count(*)) AS mean FROM b WHERE c GROUP BY symbol, g"""))
def drawdown_episodes(spark, sf_dir):
    """Runs of days at least 5% below the running high."""
    p = X.panel(market.walk_1d(spark, sf_dir), [], base=("symbol", "day", "close", "ret"))
    run = V.by_symbol().rowsBetween(W.unboundedPreceding, 0)
    p = p.withColumn("dd", F.col("close") / F.max("close").over(run) - 1)
    return N.episodes(p, F.col("dd") <= -0.05, "ret")


@query("condition_matrix", "N6 N7", over("walk_1d", f"""
WITH a AS (SELECT symbol, day, close / lag(close) OVER w - 1 AS ret, close / lag(close, 30) OVER w - 1 AS r30 FROM walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 b AS (SELECT *, {rolling('stddev_samp', 'ret', 30)} AS vol FROM a),
 l AS (SELECT symbol, day, ret, 'uptrend' AS condition, coalesce(r30 > 0, FALSE) AS c FROM b UNION ALL SELECT symbol, day, ret, 'crash', coalesce(r30 <= -0.10, FALSE) FROM b UNION ALL SELECT symbol, day, ret, 'high_vol', coalesce(vol > 0.010, FALSE) FROM b),
 s AS (SELECT *, c AND NOT coalesce(lag(c) OVER (PARTITION BY symbol, condition ORDER BY day), FALSE) AS st FROM l)
SELECT symbol, condition, count(*) FILTER (WHERE st) AS episodes, count(*) FILTER (WHERE c) AS days, R6(coalesce(avg(ret) FILTER (WHERE c), 0)) AS mean_on, R6(coalesce(avg(ret) FILTER (WHERE NOT c), 0)) AS mean_off, count(*) FILTER (WHERE st) < 10 AS few FROM s GROUP BY 1, 2"""))
def condition_matrix(spark, sf_dir):
    p = X.panel(
        market.walk_1d(spark, sf_dir), [[X.momentum(30), X.vol_through(30, "vol")]], base=("symbol", "day", "close", "ret")
    )
    conds = {"uptrend": F.col("r30") > 0, "crash": F.col("r30") <= -0.10, "high_vol": F.col("vol") > 0.010}
    return N.condition_matrix(p, conds, "ret")


_GUARDED = """
WITH f AS (SELECT 'whole, no reference' AS frame, symbol, day, close FROM walk_1d UNION ALL SELECT 'whole, with reference', symbol, day, close FROM walk_1d
  UNION ALL SELECT 'before, no reference', symbol, day, close FROM walk_1d WHERE day < DATE '1999-07-01'),
 r AS (SELECT frame, frame LIKE '%no reference' AND min(day) <= DATE '1999-07-31' AND max(day) >= DATE '1999-07-01' AS refused FROM f GROUP BY frame)"""


def _guarded(spark, sf_dir):
    p = market.walk_1d(spark, sf_dir).select("symbol", "day", "close")
    guard = ("1999-07-01", "1999-07-31")
    return {
        "whole, no reference": (p, guard, None),
        "whole, with reference": (p, guard, "H68"),
        "before, no reference": (p.where("day < '1999-07-01'"), guard, None),
    }


@query("guarded_window", "N8", over("walk_1d", _GUARDED + """
SELECT f.frame, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, any_value(refused) AS refused FROM f JOIN r ON f.frame = r.frame GROUP BY f.frame"""))
def guarded_window(spark, sf_dir):
    """Whether a frame may be read: one that overlaps the guarded month needs a reference."""
    parts = [N.refuse_window(p, *guard, reference).withColumn("frame", F.lit(name)) for name, (p, guard, reference) in _guarded(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("guarded_rows", "N8", over("walk_1d", _GUARDED + """
SELECT f.frame, symbol, count(*) AS n, R6(sum(close)) AS total FROM f JOIN r ON f.frame = r.frame WHERE NOT refused GROUP BY f.frame, symbol"""))
def guarded_rows(spark, sf_dir):
    """What the same frames hand out: a refused one has no rows."""
    parts = [N.withheld(p, *guard, reference).withColumn("frame", F.lit(name)) for name, (p, guard, reference) in _guarded(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("frame", "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("total"))


# --- features: robust z, channels, barriers, pair correlation ------------------------------------------------


@query("feature_channels", "F26 F27 F28 F29", over("walk_1d", f"""
WITH a AS (SELECT *, ln(close / lag(close) OVER w) AS lr, lag(close) OVER w AS pc, ln(volume + 1) AS lv FROM walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 b AS (SELECT *, {rolling('stddev_samp', 'lr', 20, -1)} AS vol, {rolling('avg', 'lv', 60, -1)} AS vm, {rolling('stddev_samp', 'lv', 60, -1)} AS vs, row_number() OVER (PARTITION BY symbol ORDER BY day) AS rn FROM a),
 c AS (SELECT symbol, day, rn, lr / (vol + 1e-12) AS c1, ((high - low) / (pc + 1e-12)) / (vol + 1e-12) AS c2, (close - open) / (high - low + 1e-12) AS c3, 2 * (close - low) / (high - low + 1e-12) - 1 AS c4,
   ln(open / pc) / (vol + 1e-12) AS c5, CASE WHEN rn > 61 THEN (lv - vm) / (vs + 1e-12) END AS c6, close * exp(vol) AS ub, close * exp(-vol) AS lb,
   list({{'h': high, 'l': low}}) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS nx FROM b),
 d AS (SELECT *, CASE WHEN ub IS NULL OR len(nx) < 5 THEN 0 ELSE coalesce(list_filter(list_transform(nx, lambda x: CASE WHEN x.h >= ub AND x.l <= lb THEN 0 WHEN x.h >= ub THEN 1 WHEN x.l <= lb THEN -1 END), lambda v: v IS NOT NULL)[1], 0) END AS label FROM c),
 e AS (SELECT *, count(c1 + c2 + c3 + c4 + c5 + c6) OVER w AS ok, sum(c1) OVER w AS w1, sum(c4) OVER w AS w4, sum(c6) OVER w AS w6 FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 29 PRECEDING))
SELECT symbol, CAST(day AS VARCHAR) AS day, label, R6(c1) AS ret_scaled, R6(c2) AS range_scaled, R6(c3) AS body, R6(c4) AS close_loc, R6(c5) AS gap_scaled, R6(c6) AS volume_z, R6(w1) AS window_ret, R6(w4) AS window_loc, R6(w6) AS window_vol
FROM e WHERE ok = 30 AND len(nx) = 5"""))
def feature_channels(spark, sf_dir):
    """Samples: six causal channels, a thirty-row window of them, and the barrier label."""
    from tickloom.operators import samples

    s = samples.windows(samples.labelled(samples.channels(market.walk_1d(spark, sf_dir)), horizon=5), window=30, horizon=5)
    total = lambda c: F.aggregate(F.transform("block", lambda x: x[c]), F.lit(0.0), lambda a, v: a + v)
    return s.select(
        "symbol", "day", "label", *samples.CHANNELS, total("ret_scaled").alias("window_ret"),
        total("close_loc").alias("window_loc"), total("volume_z").alias("window_vol"),
    )
