"""Inference queries: families of tests, corrected Sharpe ratios, score cards, path tests."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import features as X
from tickloom.functions.normal import max_sharpe_factor, phi_sql, wilson
from tickloom.operators import bootstrap as R
from tickloom.operators import inference as I
from tickloom.operators import metrics
from tickloom.operators import signals as S
from tickloom.operators.cells import Cell, two_group_days
from tickloom.plans.oracle import hash_start, over, rolling, two_group
from tickloom.plans.studies_daily import _case, _obs
from tickloom.plans.studies_more import _OVER, overlay_book
from tickloom.registry import query
from tickloom.session import settled, shared
from tickloom.sources import market

# --- families of tests ---------------------------------------------------------------------------------


def relation_panel(spark, sf_dir):
    return X.panel(
        market.walk_1d(spark, sf_dir),
        [[X.momentum(30), X.vol_through(30, "vol30"), X.vol_through(90, "vol90"), X.forward_return(1), X.forward_return(7), X.forward_return(30)]],
        base=("symbol", "day", "close", "ret"),
    )


_REL = f"""WITH a AS (SELECT symbol, day, close / lag(close) OVER w - 1 AS ret, close / lag(close, 30) OVER w - 1 AS r30, lead(close, 1) OVER w / close - 1 AS fwd1, lead(close, 7) OVER w / close - 1 AS fwd7, lead(close, 30) OVER w / close - 1 AS fwd30 FROM walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 c AS (SELECT *, {rolling('stddev_samp', 'ret', 30)} AS vol30, {rolling('stddev_samp', 'ret', 90)} AS vol90 FROM a)"""
CONDS = {"uptrend": "r30 > 0", "calm": "vol30 < vol90"}
HZ = (1, 7, 30)


def _rel_obs():
    return ", " + _obs(*[
        (f"{n}_{h}d", f"c WHERE r30 IS NOT NULL AND vol90 IS NOT NULL AND fwd{h} IS NOT NULL", _case(c, f"fwd{h}"), _case(f"NOT ({c})", f"fwd{h}"))
        for n, c in CONDS.items() for h in HZ])


def relation_family(panel, seed: int, n_boot: int = 5000):
    """Every condition by horizon as one table of effects, intervals and p-values."""
    ready = F.col("r30").isNotNull() & F.col("vol90").isNotNull()
    cells = [
        Cell(f"{n}_{h}d", F.col(f"fwd{h}"), F.expr(c), None, ready & F.col(f"fwd{h}").isNotNull())
        for n, c in CONDS.items() for h in HZ
    ]
    return R.two_group_ci(two_group_days(panel, cells), n_boot=n_boot, seed=seed)


def _family_sql(tail: str) -> str:
    sql = two_group(_REL + _rel_obs(), n_boot=5000, seed=21)
    cut = sql.rindex("SELECT t.cell")
    return f"""{sql[:cut].rstrip()},
 fam AS (SELECT t.cell, t.point, b.low, b.high, b.p_value FROM totals t LEFT JOIN bounds b ON t.cell = b.cell),
 rk AS (SELECT *, row_number() OVER (ORDER BY p_value, cell) AS rk FROM fam),
 lim AS (SELECT max(rk) AS cut FROM rk WHERE p_value <= rk * 0.4 / 8)
{tail}"""


@query("relation_family_fdr", "R21 R7 R2 R9", over("walk_1d", _family_sql("""
SELECT cell, R6(point) AS point, R6(low) AS low, R6(high) AS high, R6(p_value) AS p_value, low > 0 OR high < 0 AS excludes_zero, rk AS rank, coalesce(rk <= cut, FALSE) AS discovery FROM rk, lim""")))
def relation_family_fdr(spark, sf_dir):
    """Effects with intervals, p-values and step-up discoveries; eight cells were declared."""
    fam, _ = settled(relation_family(relation_panel(spark, sf_dir), 21))
    t = fam.select(F.col("cell").alias("test_id"), "point", "low", "high", "p_value", F.lit(8).alias("declared"))
    out = I.step_up(t, 0.4, declared="declared")
    return out.select(
        F.col("test_id").alias("cell"), "point", "low", "high", "p_value", I.decide(F.col("low"), F.col("high")).alias("excludes_zero"), "rank", "discovery"
    )


_SPLIT = "1998-06-01"


@query("replication_outcomes", "R22 R21", over("walk_1d", (lambda s: s[: s.rindex("SELECT t.cell")].rstrip() + """,
 fam AS (SELECT t.cell, t.point, b.low, b.high FROM totals t LEFT JOIN bounds b ON t.cell = b.cell),
 v AS (SELECT f.cell, f.point, (f.low > 0 OR f.high < 0) AND sign(f.point) = sign(o.point) AS ok FROM fam f, (SELECT point FROM fam WHERE cell = 'base') o WHERE f.cell <> 'base')
SELECT cell, R6(point) AS point, ok AS survived FROM v""")(two_group(_REL + ", " + _obs(
    ("base", "c WHERE r30 IS NOT NULL AND fwd7 IS NOT NULL", _case("r30 > 0", "fwd7"), _case("r30 <= 0", "fwd7")),
    ("early", f"c WHERE r30 IS NOT NULL AND fwd7 IS NOT NULL AND day < DATE '{_SPLIT}'", _case("r30 > 0", "fwd7"), _case("r30 <= 0", "fwd7")),
    ("late", f"c WHERE r30 IS NOT NULL AND fwd7 IS NOT NULL AND day >= DATE '{_SPLIT}'", _case("r30 > 0", "fwd7"), _case("r30 <= 0", "fwd7")),
    ("long", "c WHERE r30 IS NOT NULL AND fwd30 IS NOT NULL", _case("r30 > 0", "fwd30"), _case("r30 <= 0", "fwd30")),
    ("no_leader", "c WHERE r30 IS NOT NULL AND fwd7 IS NOT NULL AND symbol <> 'AF'", _case("r30 > 0", "fwd7"), _case("r30 <= 0", "fwd7"))), n_boot=5000, seed=22))))
def replication_outcomes(spark, sf_dir):
    """Variations of one claim in period, horizon and universe, all from one pass."""
    up, base = F.col("r30") > 0, F.col("r30").isNotNull() & F.col("fwd7").isNotNull()
    y = F.col("fwd7")
    cells = [
        Cell("base", y, up, None, base), Cell("early", y, up, None, base & (F.col("day") < _SPLIT)),
        Cell("late", y, up, None, base & (F.col("day") >= _SPLIT)),
        Cell("long", F.col("fwd30"), up, None, F.col("r30").isNotNull() & F.col("fwd30").isNotNull()),
        Cell("no_leader", y, up, None, base & (F.col("symbol") != "AF")),
    ]
    r = shared(R.two_group_ci(two_group_days(relation_panel(spark, sf_dir), cells), n_boot=5000, seed=22))
    # The claim is what the base cell was run for; its variations carry its name.
    claim = F.when(F.col("n_days") > 0, "uptrend_7d").alias("claim")
    original = r.where("cell = 'base'").select(claim, "point")
    variants = r.where("cell <> 'base'").select(claim, F.col("cell").alias("variant"), "point", "low", "high")
    out = I.replication_outcomes(original, variants)
    return out.select(F.col("variant").alias("cell"), "point", "survived")


@query("maturity_moves", "R22 M6", over("trials", """
WITH r AS (SELECT family AS cell, CASE WHEN trial_id % 3 = 0 THEN 'stress' ELSE 'replication' END AS kind, CAST(trial_id % 5 AS VARCHAR) AS dim, verdict IN ('signal', 'candidate') AS ok, 4 AS cur FROM trials),
 g AS (SELECT cell, max(cur) AS current, count(*) FILTER (WHERE kind = 'stress') AS stresses, count(*) FILTER (WHERE kind = 'stress' AND NOT ok) AS broke, count(*) FILTER (WHERE kind = 'replication') AS replications,
  count(*) FILTER (WHERE kind = 'replication' AND ok) AS survived, count(DISTINCT CASE WHEN kind = 'replication' THEN dim END) AS dimensions FROM r GROUP BY cell)
SELECT *, CASE WHEN broke > 0 THEN least(CASE WHEN survived >= 1 AND dimensions >= 2 THEN greatest(current, 5) ELSE current END, 3) ELSE CASE WHEN survived >= 1 AND dimensions >= 2 THEN greatest(current, 5) ELSE current END END AS next FROM g"""))
def maturity_moves(spark, sf_dir):
    t = market.trials(spark, sf_dir)
    runs = t.select(
        F.col("family").alias("cell"), F.when(F.col("trial_id") % 3 == 0, "stress").otherwise("replication").alias("kind"),
        (F.col("trial_id") % 5).cast("string").alias("dimension"), F.col("verdict").isin("signal", "candidate").alias("survived"), F.lit(4).alias("current"),
    )
    return I.maturity_moves(runs)


@query("trial_step_up", "R7 R8", over("trials", """
WITH r AS (SELECT family, trial_id, p_value, row_number() OVER (PARTITION BY family ORDER BY p_value, trial_id) AS rk, count(*) OVER (PARTITION BY family) AS m FROM trials),
 h AS (SELECT family, m, (SELECT sum(1.0 / i) FROM (SELECT unnest(range(1, m + 1)) AS i) z) AS pen FROM (SELECT DISTINCT family, m FROM r) q),
 t AS (SELECT r.family, trial_id, p_value, rk, rk * 0.2 / r.m AS bh, rk * 0.9 / (r.m * pen) AS byl FROM r JOIN h ON r.family = h.family),
 c AS (SELECT family, max(rk) FILTER (WHERE p_value <= bh) AS cut, max(rk) FILTER (WHERE p_value <= byl) AS cuty FROM t GROUP BY family)
SELECT t.family, count(*) AS tests, count(*) FILTER (WHERE rk <= cut) AS discoveries, count(*) FILTER (WHERE rk <= cuty) AS dependent_discoveries, R6(1000 * min(bh)) AS first_line_permille FROM t JOIN c ON t.family = c.family GROUP BY t.family"""))
def trial_step_up(spark, sf_dir):
    """Discoveries per family at two levels: independent and under any dependence."""
    t = market.trials(spark, sf_dir).select("family", F.col("trial_id").alias("test_id"), "p_value")
    a = I.step_up(t, 0.2, ["family"])
    b = I.step_up(t, 0.9, ["family"], dependent=True).select("family", "test_id", F.col("discovery").alias("dep"))
    return a.join(b, ["family", "test_id"]).groupBy("family").agg(
        F.count(F.lit(1)).alias("tests"), F.count_if(F.col("discovery")).alias("discoveries"), F.count_if(F.col("dep")).alias("dependent_discoveries"),
        (F.min("threshold") * 1000).alias("first_line_permille"),
    )


@query("family_budgets", "R8 M7", over("trials", """
WITH f AS (SELECT family, count(*) AS cells FROM trials GROUP BY family)
SELECT family, cells, R6(0.05 * cells / (SELECT sum(cells) FROM f) * 1000) AS budget_permille, R6(0.05 / (SELECT sum(cells) FROM f) * 1000000) AS first_line_ppm, R6((SELECT sum(1.0 / i) FROM (SELECT unnest(range(1, cells + 1)) AS i) z)) AS by_factor FROM f"""))
def family_budgets(spark, sf_dir):
    fam = market.trials(spark, sf_dir).groupBy("family").agg(F.count(F.lit(1)).alias("cells"))
    b = I.family_budget(fam, 0.05)
    return b.select("family", "cells", (F.col("budget") * 1000).alias("budget_permille"), (F.col("first_line") * 1e6).alias("first_line_ppm"), "by_factor")


@query("verdict_share_intervals", "R12 M3", over("trials", """
WITH g AS (SELECT family, count(*) AS n, count(*) FILTER (WHERE verdict IN ('killed', 'rejected', 'noise')) AS k FROM trials GROUP BY family)
SELECT family, n, k AS dead, R6(greatest(0, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 / (1 + 1.96 * 1.96 / n) * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n)))) AS low,
 R6(least(1, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 / (1 + 1.96 * 1.96 / n) * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n)))) AS high FROM g"""))
def verdict_share_intervals(spark, sf_dir):
    dead = F.col("verdict").isin("killed", "rejected", "noise")
    g = market.trials(spark, sf_dir).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(dead).alias("dead"))
    low, high = wilson(F.col("dead"), F.col("n"))
    return g.withColumns({"low": low, "high": high})


# --- Sharpe corrections and books side by side ----------------------------------------------------------

_BOOKS = """WITH a AS (SELECT symbol, day, close, close / lag(close) OVER w - 1 AS ret, CASE WHEN coalesce(close > lag(close, 30) OVER w, FALSE) THEN 1.0 ELSE 0.0 END AS m30,
   CASE WHEN coalesce(close > lag(close, 90) OVER w, FALSE) THEN 1.0 ELSE 0.0 END AS m90 FROM walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 bk AS (SELECT symbol, day, 'hold' AS book, ret AS r FROM a UNION ALL SELECT symbol, day, 'm30', coalesce(lag(m30) OVER w, 0) * ret FROM a WINDOW w AS (PARTITION BY symbol ORDER BY day)
   UNION ALL SELECT symbol, day, 'm90', coalesce(lag(m90) OVER w, 0) * ret FROM a WINDOW w AS (PARTITION BY symbol ORDER BY day))"""


def symbol_books(spark, sf_dir):
    """(symbol, day, book, r): hold and two momentum screens per symbol."""
    s = market.walk_1d(spark, sf_dir).select(
        "symbol", "day", S.ret().alias("ret"), S.ts_momentum(30).alias("m30"), S.ts_momentum(90).alias("m90")
    )
    held = lambda c: F.coalesce(X.lag(c), F.lit(0.0)) * F.col("ret")
    wide = s.select("symbol", "day", F.col("ret").alias("hold"), held("m30").alias("m30"), held("m90").alias("m90"))
    rows = [F.struct(F.lit(b).alias("book"), F.col(b).alias("r")) for b in ("hold", "m30", "m90")]
    return wide.select("symbol", "day", F.inline(F.array(*rows)))


_MOM = """mo AS (SELECT {k}, count(r) AS n, avg(r) AS m, stddev_samp(r) AS sd, var_samp(r) AS vr, avg(r) / stddev_samp(r) AS s,
  (avg(r * r * r) - 3 * avg(r) * avg(r * r) + 2 * pow(avg(r), 3)) / pow(var_pop(r), 1.5) AS sk, kurtosis_pop(r) + 3 AS ku FROM {src} GROUP BY {k})"""


def _psr_sql(bench: str) -> str:
    return phi_sql(f"((s - {bench}) * sqrt(n - 1) / sqrt(1 - sk * s + (ku - 1) / 4 * s * s))")


@query("deflated_sharpe", "R10 R11 G2", over("walk_1d", _BOOKS + ", " + _MOM.format(k="symbol, book", src="bk WHERE r IS NOT NULL") + f"""
SELECT symbol, book, n, R6(m * 1000) AS mean_permille, R6(sd) AS sd, R6(s) AS sharpe, R6(sk) AS skew, R6(ku) AS kurt, R6({_psr_sql('0')}) AS psr,
 R6({_psr_sql(f'sqrt(vr) * {max_sharpe_factor(65)!r}')}) AS dsr65, R6({_psr_sql(f'sqrt(vr) * {max_sharpe_factor(104)!r}')}) AS dsr104 FROM mo"""))
def deflated_sharpe(spark, sf_dir):
    """Moments, probabilistic and deflated Sharpe, re-deflated at a second trial count."""
    m = metrics.return_moments(symbol_books(spark, sf_dir), ["symbol", "book"], "r")
    a = metrics.deflated(m, 65).withColumnRenamed("dsr", "dsr65").drop("hurdle")
    b = metrics.deflated(a.drop("psr"), 104).withColumnRenamed("dsr", "dsr104")
    return b.select("symbol", "book", "n", (F.col("mean") * 1000).alias("mean_permille"), "sd", "sharpe", "skew", "kurt", "psr", "dsr65", "dsr104")


@query("books_common_window", "R25 J10 R3", over("walk_1d", _BOOKS + """,
 dd AS (SELECT day, book, avg(r) AS r FROM bk WHERE r IS NOT NULL GROUP BY day, book), ok AS (SELECT day FROM dd GROUP BY day HAVING count(*) = 3),
 cw AS (SELECT dd.* FROM dd JOIN ok ON dd.day = ok.day), """ + _MOM.format(k="book", src="cw") + f""",
 v AS (SELECT var_samp(s) AS v FROM mo)
SELECT book, n, R6(m * 1000) AS mean_permille, R6(s) AS sharpe, R6({_psr_sql(f'sqrt((SELECT v FROM v)) * {max_sharpe_factor(3)!r}')}) AS dsr FROM mo"""))
def books_common_window(spark, sf_dir):
    """Books restated on their common days; the deflation variance is taken across the books."""
    d = symbol_books(spark, sf_dir).dropna(subset=["r"]).groupBy("day", "book").agg(F.avg("r").alias("r"))
    d = d.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("day"))).where("__n = 3")
    m = metrics.return_moments(d, ["book"], "r")
    across = F.var_samp("sharpe").over(W.partitionBy())  # one row per book
    out = metrics.deflated(m.withColumn("across", across), 3, "across")
    return out.select("book", "n", (F.col("mean") * 1000).alias("mean_permille"), "sharpe", "dsr")


@query("benchmark_comparison", "R26", over("walk_1d", _BOOKS + ", " + _MOM.format(k="symbol, book", src="bk WHERE r IS NOT NULL") + f""",
 w AS (SELECT *, max(CASE WHEN book = 'hold' THEN s END) OVER (PARTITION BY symbol) AS h FROM mo)
SELECT book, count(*) AS symbols, R6(avg(CASE WHEN s > h THEN 1.0 ELSE 0.0 END)) AS beat_share, R6(median({_psr_sql(f'sqrt(vr) * {max_sharpe_factor(65)!r}')})) AS median_dsr FROM w WHERE book <> 'hold' GROUP BY book"""))
def benchmark_comparison(spark, sf_dir):
    """Share of symbols whose book beats holding over the same span, and the median deflated ratio."""
    m = metrics.deflated(metrics.return_moments(symbol_books(spark, sf_dir), ["symbol", "book"], "r"), 65)
    hold = F.max(F.when(F.col("book") == "hold", F.col("sharpe"))).over(W.partitionBy("symbol"))
    t = m.withColumn("beat", (F.col("sharpe") > hold).cast("double")).where("book <> 'hold'")
    return t.groupBy("book").agg(
        F.count(F.lit(1)).alias("symbols"), F.avg("beat").alias("beat_share"), F.percentile("dsr", F.lit(0.5)).alias("median_dsr")
    )


# --- score cards ------------------------------------------------------------------------------------------

_SCORED = """WITH a AS (SELECT symbol, day, close / lag(close, 7) OVER w - 1 AS r7, lead(close, 5) OVER w / close - 1 AS fwd, ln(lead(open, 6) OVER w / lead(open, 1) OVER w) AS outcome FROM walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 sc AS (SELECT symbol, CAST(year(day) AS INTEGER) AS fold, round(1 / (1 + exp(-20 * r7)), 2) AS score, CASE WHEN fwd > 0 THEN 1 ELSE 0 END AS label, outcome FROM a WHERE r7 IS NOT NULL AND fwd IS NOT NULL AND outcome IS NOT NULL)"""


def scored_rows(spark, sf_dir, bars=market.walk_1d):
    """(symbol, fold, score, label, outcome): a momentum score against what came next."""
    d = bars(spark, sf_dir).select(
        "symbol", F.year("day").alias("fold"), X.momentum(7).expr.alias("r7"), X.forward_return(5).expr.alias("fwd"),
        F.log(F.try_divide(X.lead("open", 6), X.lead("open", 1))).alias("outcome"),
    ).dropna(subset=["r7", "fwd", "outcome"])
    return d.select("symbol", "fold", F.round(1 / (1 + F.exp(-20 * F.col("r7"))), 2).alias("score"), (F.col("fwd") > 0).cast("int").alias("label"), "outcome")


@query("score_auc", "R16", over("walk_1d", _SCORED + """,
 r AS (SELECT symbol, label, rank() OVER (PARTITION BY symbol ORDER BY score) + (count(*) OVER (PARTITION BY symbol, score) - 1) / 2.0 AS rk FROM sc),
 g AS (SELECT symbol, sum(label) AS p, count(*) - sum(label) AS n, sum(CASE WHEN label = 1 THEN rk ELSE 0 END) AS s FROM r GROUP BY symbol)
SELECT symbol, CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives, R6((s - p * (p + 1) / 2) / (CAST(p AS DOUBLE) * n)) AS auc FROM g"""))
def score_auc(spark, sf_dir):
    return I.roc_auc(scored_rows(spark, sf_dir), ["symbol"])


@query("score_classification", "R17", over("walk_1d", _SCORED + """
SELECT symbol, count(*) AS n, R6(avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END)) AS accuracy, R6(greatest(avg(label), 1 - avg(label))) AS base_rate,
 R6(avg(CASE WHEN score >= 0.55 OR score <= 1 - CAST(0.55 AS DOUBLE) THEN 1.0 ELSE 0.0 END)) AS coverage, R6(avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) FILTER (WHERE score >= 0.55 OR score <= 1 - CAST(0.55 AS DOUBLE))) AS precision FROM sc GROUP BY symbol"""))
def score_classification(spark, sf_dir):
    return I.classification(scored_rows(spark, sf_dir), ["symbol"])


_TRADE = """ t AS (SELECT *, CASE WHEN score >= 0.55 THEN outcome - 0.001 WHEN score <= 1 - CAST(0.55 AS DOUBLE) THEN -outcome - 0.001 END AS net FROM sc)"""


# Prices of nothing give no return, bars without a day come first, and t-statistics are exact sums of nets in whole 10^-12.
_EXACT_SCORED = """WITH a AS (SELECT symbol, day, close / NULLIF(lag(close, 7) OVER w, 0) - 1 AS r7, lead(close, 5) OVER w / NULLIF(close, 0) - 1 AS fwd, ln(NULLIF(lead(open, 6) OVER w / NULLIF(lead(open, 1) OVER w, 0), 0)) AS outcome FROM exact_walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day NULLS FIRST)),
 sc AS (SELECT symbol, round(1 / (1 + exp(-20 * r7)), 2) AS score, outcome FROM a WHERE r7 IS NOT NULL AND fwd IS NOT NULL AND outcome IS NOT NULL)"""


@query("score_trading", "R18", over("exact_walk_1d", _EXACT_SCORED + "," + _TRADE + """,
 u AS (SELECT *, CAST(floor(net * 1e12 + 0.5) AS HUGEINT) AS units FROM t),
 g AS (SELECT symbol, count(net) AS trades, avg(net) AS mean_net, sum(units) AS total, count(net) * sum(units * units) - sum(units) * sum(units) AS spread, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE net IS NOT NULL) AS hit_rate FROM u GROUP BY symbol)
SELECT symbol, trades, R6(mean_net * 1000) AS mean_net_permille, R6(CASE WHEN spread > 0 THEN CAST(total AS DOUBLE) * sqrt(trades - 1) / sqrt(CAST(spread AS DOUBLE)) END) AS t_stat, R6(hit_rate) AS hit_rate FROM g"""))
def score_trading(spark, sf_dir):
    s = I.trading_score(scored_rows(spark, sf_dir, market.exact_walk_1d), ["symbol"])
    return s.select("symbol", "trades", (F.col("mean_net") * 1000).alias("mean_net_permille"), "t_stat", "hit_rate")


@query("score_fold_summary", "R19", over("walk_1d", _SCORED + """,
 r AS (SELECT symbol, fold, label, rank() OVER (PARTITION BY symbol, fold ORDER BY score) + (count(*) OVER (PARTITION BY symbol, fold, score) - 1) / 2.0 AS rk FROM sc),
 g AS (SELECT symbol, fold, (sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2) / NULLIF(CAST(sum(label) AS DOUBLE) * (count(*) - sum(label)), 0) AS auc FROM r GROUP BY symbol, fold),
""" + _TRADE + """, n AS (SELECT symbol, fold, count(net) AS trades, avg(net) AS mean_net FROM t WHERE net IS NOT NULL GROUP BY symbol, fold)
SELECT g.symbol, count(*) AS folds, R6(avg(auc)) AS auc, CAST(sum(trades) AS BIGINT) AS trades, R6(sum(mean_net * trades) / sum(trades) * 1000) AS mean_net_permille FROM g JOIN n ON g.symbol = n.symbol AND g.fold = n.fold GROUP BY g.symbol"""))
def score_fold_summary(spark, sf_dir):
    rows = shared(scored_rows(spark, sf_dir))
    traded = I.trading_score(rows, ["symbol", "fold"]).where("trades > 0")
    folds = I.roc_auc(rows, ["symbol", "fold"]).join(traded, ["symbol", "fold"])
    p = I.pooled_summary(folds, ["symbol"])
    return p.select("symbol", "folds", "auc", "trades", (F.col("mean_net") * 1000).alias("mean_net_permille"))


@query("leak_alarm", "R20", over("walk_1d", _REL + """
SELECT f AS feature, count(*) FILTER (WHERE x IS NOT NULL AND fwd7 IS NOT NULL) AS n, R6(corr(x, fwd7)) AS corr, f LIKE 'fwd%' OR coalesce(abs(corr(x, fwd7)) > 0.95 AND count(*) FILTER (WHERE x IS NOT NULL AND fwd7 IS NOT NULL) >= 30, FALSE) AS alarm
FROM (SELECT fwd7, unnest([{'f': 'r30', 'x': r30}, {'f': 'vol30', 'x': vol30}, {'f': 'peek', 'x': fwd7 * 2 + 1}, {'f': 'fwd1', 'x': fwd1}], recursive := true) FROM c) z GROUP BY f"""))
def leak_alarm(spark, sf_dir):
    p = relation_panel(spark, sf_dir).withColumn("peek", F.col("fwd7") * 2 + 1)
    return I.leak_alarm(p, ["r30", "vol30", "peek", "fwd1"], "fwd7")


# --- path tests -------------------------------------------------------------------------------------------

PATHS, BLOCK, HORIZON, SCALES = 1000, 10, 120, (0.5, 1.0, 2.0)


def _paths_sql(seed: int) -> str:
    return f"""pp AS (SELECT path, blk, {hash_start(seed, '(SELECT count(*) FROM ob)', BLOCK).replace('draw', 'path')} AS s FROM (SELECT unnest(range({PATHS})) AS path) a, (SELECT unnest(range({HORIZON // BLOCK})) AS blk) b),
 ser AS (SELECT row_number() OVER (ORDER BY day) - 1 AS pos, ret FROM ob),
 pd AS (SELECT path, blk * {BLOCK} + j + 1 AS d, ret AS r FROM pp, (SELECT unnest(range({BLOCK})) AS j) q, ser WHERE ser.pos = pp.s + q.j)"""


_BAR = f""",
 sx AS (SELECT unnest({list(SCALES)}) AS scale),
 e AS (SELECT scale, path, d, 1 + r * scale AS st, exp(sum(ln(1 + r * scale)) OVER (PARTITION BY scale, path ORDER BY d ROWS UNBOUNDED PRECEDING)) AS eq FROM pd, sx),
 e2 AS (SELECT *, greatest(1, max(eq) OVER (PARTITION BY scale, path ORDER BY d ROWS UNBOUNDED PRECEDING)) AS pk FROM e),
 e3 AS (SELECT *, CASE WHEN st <= 1 - 0.02 OR eq <= pk * (1 - 0.06) OR eq <= 1 - 0.05 THEN 'bust' WHEN eq >= 1 + 0.04 THEN 'pass' END AS o FROM e2),
 oc AS (SELECT scale, path, coalesce(min_by(o, d) FILTER (WHERE o IS NOT NULL), 'timeout') AS outcome, coalesce(min(d) FILTER (WHERE o IS NOT NULL), max(d)) AS day FROM e3 GROUP BY scale, path)"""


def _evaluated(spark, sf_dir, seed=23):
    days = shared(overlay_book(spark, sf_dir).select("day", "ret"))
    paths = I.path_days(days, PATHS, BLOCK, HORIZON, seed)
    return I.barrier_outcomes(paths, SCALES, target=0.04, static=0.05, trailing=0.06, daily=0.02)


@query("path_test_outcomes", "R23", over("walk_1d", _OVER + ", " + _paths_sql(23) + _BAR + """
SELECT R6(scale) AS scale, outcome, count(*) AS paths, CAST(sum(day) AS BIGINT) AS days FROM oc GROUP BY 1, 2"""))
def path_test_outcomes(spark, sf_dir):
    """Resampled paths against a target, static and trailing floors and a daily loss."""
    return _evaluated(spark, sf_dir).groupBy("scale", "outcome").agg(F.count(F.lit(1)).alias("paths"), F.sum("day").alias("days"))


@query("sizing_table", "R24 R12 R23", over("walk_1d", _OVER + ", " + _paths_sql(23) + _BAR + """,
 g AS (SELECT scale, count(*) AS n, count(*) FILTER (WHERE outcome = 'pass') AS k, count(*) FILTER (WHERE outcome = 'bust') AS b, list_sort(list(day) FILTER (WHERE outcome = 'pass')) AS dl, avg(day) AS md FROM oc GROUP BY scale)
SELECT R6(scale) AS scale, k AS passes, b AS busts, R6(k / n) AS pass_rate, R6((n - k - b) / n) AS timeout_rate, CAST(coalesce(dl[len(dl) // 2 + 1], -1) AS INTEGER) AS median_days, R6(k / n * 1000 - 100) AS ev, R6((k / n * 1000 - 100) / md) AS ev_per_day FROM g"""))
def sizing_table(spark, sf_dir):
    """Rates, median days and expected value per attempt and per day by sizing."""
    t = I.evaluation_table(_evaluated(spark, sf_dir), ["scale"], fee=100.0, value=1000.0)
    return t.select("scale", "passes", "busts", "pass_rate", "timeout_rate", F.coalesce("median_days", F.lit(-1)).cast("int").alias("median_days"), "ev", "ev_per_day")


@query("best_sizing", "R24")
def best_sizing(spark, sf_dir):
    """The sizing with the best expected value per day."""
    t = I.evaluation_table(_evaluated(spark, sf_dir), ["scale"], fee=100.0, value=1000.0)
    return I.best_sizing(t, ["scale"])


@query("two_stage_path_test", "R23")
def two_stage_path_test(spark, sf_dir):
    """A second stage on a fresh account after the first passes; days add up."""
    days = shared(overlay_book(spark, sf_dir).select("day", "ret"))
    one = I.barrier_outcomes(I.path_days(days, PATHS, BLOCK, HORIZON, 23), SCALES, 0.04, static=0.05)
    two = I.barrier_outcomes(I.path_days(days, PATHS, BLOCK, HORIZON, 24), SCALES, 0.02, static=0.05)
    return I.two_stage(one, two).groupBy("scale", "outcome").agg(F.count(F.lit(1)).alias("paths"), F.sum("day").alias("days"))


@query("adaptive_path_test", "R23")
def adaptive_path_test(spark, sf_dir):
    """Smaller scale below the start, coasting after the target until the minimum days (fold, tested by brute force)."""
    days = shared(overlay_book(spark, sf_dir).select("day", "ret"))
    out = I.adaptive_outcomes(I.path_days(days, PATHS, BLOCK, HORIZON, 23), 1.0, 0.5, 0.04, 0.05, min_days=10)
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("paths"), F.sum("day").alias("days"))
