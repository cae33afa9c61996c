"""Learned-model queries over the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import features as X
from tickloom.operators import inference as I
from tickloom.operators import models as M
from tickloom.plans.oracle import over, rolling
from tickloom.registry import query
from tickloom.session import shared
from tickloom.sources import market

FEATURES = ["r4", "r12", "vol12"]
TRAIN, TEST, PURGE = 120, 40, 4


def model_panel(spark, sf_dir):
    p = X.panel(
        market.walk_wk(spark, sf_dir),
        [[X.momentum(4), X.momentum(12), X.vol_through(12, "vol12"), X.forward_return(4)]],
        base=("symbol", "day", "close", "ret"), drop_nulls=[*FEATURES, "fwd4"],
    )
    return p.withColumns({"label": (F.col("fwd4") > 0).cast("double"), "outcome": F.col("fwd4")})


_PANEL = f"""WITH a AS (SELECT symbol, day, close / lag(close) OVER w - 1 AS ret, close / lag(close, 4) OVER w - 1 AS r4, close / lag(close, 12) OVER w - 1 AS r12, lead(close, 4) OVER w / close - 1 AS fwd4 FROM walk_wk WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 b AS (SELECT *, {rolling('stddev_samp', 'ret', 12)} AS vol12 FROM a),
 p AS (SELECT * FROM b WHERE r4 IS NOT NULL AND r12 IS NOT NULL AND vol12 IS NOT NULL AND fwd4 IS NOT NULL),
 dp AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos FROM (SELECT DISTINCT day FROM p) d), nd AS (SELECT count(*) AS n FROM dp),
 wn AS (SELECT CAST(k AS INTEGER) AS win, k * {TEST} AS a0, k * {TEST} + {TRAIN} AS a1, k * {TEST} + {TRAIN + PURGE} AS b0, k * {TEST} + {TRAIN + PURGE + TEST} AS b1 FROM (SELECT unnest(range(0, 50)) AS k) q, nd WHERE k * {TEST} + {TRAIN + PURGE + TEST} <= n)"""


@query("purged_windows", "W1", over("walk_wk", _PANEL + """
SELECT win AS window, a0 AS train_start, a1 AS train_end, b0 AS test_start, b1 AS test_end FROM wn"""))
def purged_windows(spark, sf_dir):
    return M.purged_windows(model_panel(spark, sf_dir), TRAIN, TEST, PURGE)


@query("embargoed_folds", "W2", over("walk_wk", _PANEL + """,
 f AS (SELECT CAST(k AS INTEGER) AS fold, n, (n - 160) // 4 AS blk FROM (SELECT unnest(range(4)) AS k) q, nd),
 g AS (SELECT fold, 160 + fold * blk AS ts, CASE WHEN fold = 3 THEN n ELSE 160 + (fold + 1) * blk END AS te FROM f WHERE blk >= 1)
SELECT fold, ts - 10 - CAST(round_even((ts - 10) * CAST(0.15 AS DOUBLE), 0) AS INTEGER) - 10 AS fit_end, ts - 10 - CAST(round_even((ts - 10) * CAST(0.15 AS DOUBLE), 0) AS INTEGER) AS val_start, ts - 10 AS train_end, ts AS test_start, te AS test_end FROM g"""))
def embargoed_folds(spark, sf_dir):
    return M.embargoed_folds(model_panel(spark, sf_dir), 4, 10, 150)


@query("equal_weight_ensemble", "W3 W4", over("walk_wk", _PANEL + """,
 j AS (SELECT p.*, win, CASE WHEN pos >= a0 AND pos < a1 THEN 'train' WHEN pos >= b0 AND pos < b1 THEN 'test' END AS part FROM p JOIN dp ON p.day = dp.day JOIN wn ON pos >= a0 AND pos < b1),
 st AS (SELECT win, avg(r4) AS m1, stddev_pop(r4) AS s1, avg(r12) AS m2, stddev_pop(r12) AS s2, avg(vol12) AS m3, stddev_pop(vol12) AS s3 FROM j WHERE part = 'train' GROUP BY win),
 sc AS (SELECT j.win, j.symbol, fwd4, 1 / (1 + exp(-((r4 - m1) / s1 + (r12 - m2) / s2 + (vol12 - m3) / s3))) AS score FROM j JOIN st ON j.win = st.win WHERE part = 'test')
SELECT win AS window, count(*) AS n, R6(avg(CASE WHEN (score >= 0.5) = (fwd4 > 0) THEN 1.0 ELSE 0.0 END)) AS accuracy, R6(avg(score)) AS mean_score, R6(corr(score, fwd4)) AS ic FROM sc GROUP BY win"""))
def equal_weight_ensemble(spark, sf_dir):
    """The unfitted baseline: sum of train-standardised features, scored on purged test days."""
    s = M.equal_weight(M.place(model_panel(spark, sf_dir), TRAIN, TEST, PURGE), FEATURES)
    hit = ((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double")
    return s.groupBy("window").agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg("score").alias("mean_score"), F.corr("score", "outcome").alias("ic")
    )


def _solve(name: str, source: str, k: int, l1: float, sweeps: int = 80) -> str:
    """Recursive SQL: the minimum of a quadratic model by coordinates, one sweep a step."""
    ws = ", ".join(f"w{i}" for i in range(k))
    inner = f"SELECT q.*, c.it, " + ", ".join(f"c.v{i}" for i in range(k)) + f" FROM {name} c JOIN {source} q ON q.win = c.win WHERE c.it < {sweeps}"
    for i in range(k):
        h = [f"h{min(i, j)}_{max(i, j)}" for j in range(k)]
        move = " + ".join(f"{h[j]} * ({'n' if j < i else 'v'}{j} - w{j})" for j in range(k))
        raw = f"(v{i} - (g{i} + {move}) / h{i}_{i})"
        shrunk = f"sign({raw}) * greatest(abs({raw}) - {l1!r} / h{i}_{i}, 0.0)" if l1 and i < k - 1 else raw
        inner = f"SELECT *, {shrunk} AS n{i} FROM ({inner}) s{i}"
    return (
        f"{name}(win, it, {', '.join(f'v{i}' for i in range(k))}) AS (SELECT win, 0, {ws} FROM {source} UNION ALL "
        f"SELECT win, it + 1, {', '.join(f'n{i}' for i in range(k))} FROM ({inner}) s)"
    )


def _newton(source: str, k: int, l1: float, l2: float, steps: int, weight: str = "1.0") -> str:
    """Newton steps from zero over ``source`` (win, x0, ..., y, part), unrolled; ends in ``fit(win, w0, ...)``."""
    out = [f"w_0 AS (SELECT win, {', '.join(f'CAST(0 AS DOUBLE) AS w{i}' for i in range(k))} FROM {source} WHERE part = 'train' GROUP BY win)"]
    x = [*(f"x{i}" for i in range(k - 1)), "1.0"]
    z = " + ".join(f"w{i} * {x[i]}" for i in range(k))
    for s in range(1, steps + 1):
        g = [f"sum({weight} * (p - y) * {x[i]})" + (f" + {l2!r} * any_value(w{i})" if l2 and i < k - 1 else "") + f" AS g{i}" for i in range(k)]
        h = [f"sum({weight} * p * (1 - p) * {x[i]} * {x[j]})" + (f" + {l2!r}" if l2 and i == j and i < k - 1 else "") + f" AS h{i}_{j}" for i in range(k) for j in range(i, k)]
        out.append(
            f"q_{s} AS MATERIALIZED (SELECT win, {', '.join(f'any_value(w{i}) AS w{i}' for i in range(k))}, {', '.join(g + h)} FROM "
            f"(SELECT d.*, {', '.join(f'w{i}' for i in range(k))}, 1 / (1 + exp(-({z}))) AS p FROM {source} d JOIN w_{s - 1} w ON w.win = d.win WHERE part = 'train') r GROUP BY win)"
        )
        out.append(_solve(f"c_{s}", f"q_{s}", k, l1))
        out.append(f"w_{s} AS MATERIALIZED (SELECT win, {', '.join(f'max_by(v{i}, it) AS w{i}' for i in range(k))} FROM c_{s} GROUP BY win)")
    return ",\n ".join([*out, f"fit AS (SELECT * FROM w_{steps})"])


_PLACED = _PANEL + """,
 j AS (SELECT p.*, win, CASE WHEN pos >= a0 AND pos < a1 THEN 'train' WHEN pos >= b0 AND pos < b1 THEN 'test' END AS part FROM p JOIN dp ON p.day = dp.day JOIN wn ON pos >= a0 AND pos < b1),
 st AS (SELECT win, avg(r4) AS m1, stddev_pop(r4) AS s1, avg(r12) AS m2, stddev_pop(r12) AS s2, avg(vol12) AS m3, stddev_pop(vol12) AS s3 FROM j WHERE part = 'train' GROUP BY win),
 zd AS MATERIALIZED (SELECT j.win, part, (r4 - m1) / s1 AS x0, (r12 - m2) / s2 AS x1, (vol12 - m3) / s3 AS x2, CASE WHEN fwd4 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM j JOIN st ON j.win = st.win WHERE part IS NOT NULL),
 """
_RECURSIVE = "WITH RECURSIVE" + _PLACED[len("WITH"):]


@query("logistic_ensemble", "W3", over("walk_wk", _RECURSIVE + _newton("zd", 4, 0.0, 1.0, 7) + """,
 sc AS (SELECT zd.win, y, 1 / (1 + exp(-(w0 * x0 + w1 * x1 + w2 * x2 + w3))) AS score FROM zd JOIN fit ON fit.win = zd.win WHERE part = 'test')
SELECT win AS window, count(*) AS n, R6(avg(CASE WHEN (score >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)) AS accuracy, R6(greatest(avg(y), 1 - avg(y))) AS base_rate,
 R6(avg(CASE WHEN score >= 0.55 OR score <= 1 - CAST(0.55 AS DOUBLE) THEN 1.0 ELSE 0.0 END)) AS coverage, R6(avg(CASE WHEN (score >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) FILTER (WHERE score >= 0.55 OR score <= 1 - CAST(0.55 AS DOUBLE))) AS precision FROM sc GROUP BY win"""))
def logistic_ensemble(spark, sf_dir):
    """Fitted ensemble per window, all windows in one Newton iteration."""
    scored, _ = M.logistic(M.place(model_panel(spark, sf_dir), TRAIN, TEST, PURGE), FEATURES, "label")
    return I.classification(scored, ["window"])


_WEIGHTS = """,
 wt AS (SELECT win, unnest(['r4', 'r12', 'vol12']) AS feature, unnest([w0, w1, w2]) AS weight FROM fit)"""


@query("ensemble_fits", "W3 W4", over("walk_wk", _RECURSIVE + _newton("zd", 4, 0.0, 1.0, 7) + _WEIGHTS + """
SELECT win AS window, feature, R6(weight) AS weight FROM wt"""))
def ensemble_fits(spark, sf_dir):
    """Weights of every window under the L2 penalty."""
    _, weights = M.logistic(M.place(model_panel(spark, sf_dir), TRAIN, TEST, PURGE), FEATURES, "label")
    return M.weight_rows(spark, weights, FEATURES, ["window"], "window int")


@query("ensemble_weights", "W4", over("walk_wk", _RECURSIVE + _newton("zd", 4, 1.0, 0.0, 7) + _WEIGHTS + """
SELECT feature, count(*) AS windows, R6(avg(weight)) AS mean, R6(greatest(count(*) FILTER (weight > 0), count(*) - count(*) FILTER (weight > 0)) / count(*)) AS stability FROM wt GROUP BY feature"""))
def ensemble_weights(spark, sf_dir):
    """Mean weight and sign stability across windows of the ensemble fitted under the L1 penalty."""
    _, weights = M.logistic(M.place(model_panel(spark, sf_dir), TRAIN, TEST, PURGE), FEATURES, "label", penalty="l1")
    return M.weight_summary(M.weight_rows(spark, weights, FEATURES, ["window"], "window int"))


FOLDS, EMBARGO, MIN_TRAIN = 5, 10, 150


def _arms(spark, sf_dir):
    p = shared(model_panel(spark, sf_dir))
    return M.arms(p.join(M.day_positions(p), "day"), M.embargoed_folds(p, FOLDS, EMBARGO, MIN_TRAIN), FEATURES, "label")


@query("model_arms", "W5 R16 R17")
def model_arms(spark, sf_dir):
    """Majority, balanced logistic and boosted trees on embargoed folds (trees are checked by brute force in tests)."""
    rows = shared(_arms(spark, sf_dir))
    return I.roc_auc(rows, ["arm"]).join(I.classification(rows, ["arm"]), "arm")


_FOLDED = _PANEL + f""",
 fd AS (SELECT CAST(k AS INTEGER) AS win, {MIN_TRAIN + EMBARGO} + k * ((n - {MIN_TRAIN + EMBARGO}) // {FOLDS}) AS ts, CASE WHEN k = {FOLDS - 1} THEN n ELSE {MIN_TRAIN + EMBARGO} + (k + 1) * ((n - {MIN_TRAIN + EMBARGO}) // {FOLDS}) END AS te FROM (SELECT unnest(range({FOLDS})) AS k) q, nd WHERE n >= {MIN_TRAIN + EMBARGO + FOLDS}),
 fe AS (SELECT win, ts, te, ts - {EMBARGO} - CAST(round_even((ts - {EMBARGO}) * CAST(0.15 AS DOUBLE), 0) AS INTEGER) - {EMBARGO} AS fit_end FROM fd),
 zu AS (SELECT win, CASE WHEN pos < fit_end THEN 'train' ELSE 'test' END AS part, r4 AS x0, r12 AS x1, vol12 AS x2, CASE WHEN fwd4 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM p JOIN dp ON p.day = dp.day JOIN fe ON pos < fit_end OR (pos >= ts AND pos < te)),
 sh AS (SELECT win, avg(y) AS pr FROM zu WHERE part = 'train' GROUP BY win),
 zd AS MATERIALIZED (SELECT zu.*, pr, CASE WHEN y = 1 THEN 0.5 / pr ELSE 0.5 / (1 - pr) END AS wt FROM zu JOIN sh ON zu.win = sh.win),
 """


@query("linear_arms", "W5 R17", over("walk_wk", "WITH RECURSIVE" + _FOLDED[len("WITH"):] + _newton("zd", 4, 0.0, 10.0, 7, "wt") + """,
 sc AS (SELECT 'logistic' AS arm, zd.win, y, 1 / (1 + exp(-(w0 * x0 + w1 * x1 + w2 * x2 + w3))) AS score FROM zd JOIN fit ON fit.win = zd.win WHERE part = 'test'
  UNION ALL SELECT 'majority', win, y, pr FROM zd WHERE part = 'test')
SELECT arm, win AS fold, count(*) AS n, R6(avg(CASE WHEN (score >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)) AS accuracy, R6(greatest(avg(y), 1 - avg(y))) AS base_rate, R6(avg(score)) AS mean_score,
 R6(-avg(y * ln(score) + (1 - y) * ln(1 - score))) AS loss FROM sc GROUP BY arm, win"""))
def linear_arms(spark, sf_dir):
    """The majority and logistic arms fold by fold: accuracy, mean score and log loss."""
    rows = _arms(spark, sf_dir).where("arm != 'boosted'")
    s, y = F.col("score"), F.col("label").cast("double")
    right = ((s >= 0.5).cast("int") == F.col("label")).cast("double")
    return rows.groupBy("arm", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.greatest(F.avg(y), 1 - F.avg(y)).alias("base_rate"), F.avg(s).alias("mean_score"),
        (-F.avg(y * F.log(s) + (1 - y) * F.log(1 - s))).alias("loss"),
    )
