import datetime as dt
import math
import random
from statistics import NormalDist

import pytest
from conftest import DAY0
from pyspark.sql import functions as F

from tickloom.functions import normal
from tickloom.operators import bootstrap as R
from tickloom.operators import cells as C
from tickloom.operators import inference as I
from tickloom.operators import metrics


def days(spark, n=70, seed=3):
    rng = random.Random(seed)
    rows = [("c", DAY0 + dt.timedelta(days=i), rng.gauss(0.3, 1), rng.randint(0, 4), rng.gauss(0, 1), rng.randint(0, 3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "cell string, day date, a_sum double, a_n int, b_sum double, b_n int")


def test_twister_draws_follow_the_generator_in_call_order(spark):
    rows, df = days(spark)
    block, n_boot, n = 10, 200, len(rows)
    rng, drawn = random.Random(11), []
    for _ in range(n_boot):
        picked = [i for _ in range(n // block + 1) for s in [rng.randint(0, n - block)] for i in range(s, s + block)]
        sa, na, sb, nb = (sum(rows[i][k] for i in picked) for k in (2, 3, 4, 5))
        if na > 0 and nb > 0:
            drawn.append(sa / na - sb / nb)
    drawn.sort()
    got = R.two_group_ci(df, block, n_boot, 11, draws="mt").first()
    assert got["low"] == pytest.approx(drawn[int(0.025 * len(drawn))])
    assert got["high"] == pytest.approx(drawn[int(0.975 * len(drawn))])
    below = sum(d <= 0 for d in drawn)
    assert got["p_value"] == pytest.approx(max(2 * min(below, len(drawn) - below) / len(drawn), 1 / n_boot))


def test_hashed_draws_do_not_depend_on_partitioning(spark):
    _, df = days(spark)
    a = R.two_group_ci(df, 10, 300, 5).first()
    b = R.two_group_ci(df.repartition(7), 10, 300, 5).first()
    assert (a["low"], a["high"]) == pytest.approx((b["low"], b["high"]))


def test_daily_and_event_means_weigh_days_differently(spark):
    rows = [("c", DAY0 + dt.timedelta(days=i), 10.0 if i % 2 else 1.0, 10 if i % 2 else 1) for i in range(40)]
    ev = spark.createDataFrame(rows, "cell string, day date, v_sum double, v_n int")
    assert R.event_mean_ci(ev, 5, 50, 1).first()["point"] == pytest.approx(1.0)
    daily = ev.select("cell", "day", F.col("v_sum").alias("v"))
    assert R.daily_mean_ci(daily, 5, 50, 1).first()["point"] == pytest.approx(5.5)


def test_constant_series_has_a_point_interval(spark):
    df = spark.createDataFrame([("c", DAY0 + dt.timedelta(days=i), 2.0) for i in range(30)], "cell string, day date, v double")
    r = R.daily_mean_ci(df, 5, 100, 1).first()
    assert (r["low"], r["point"], r["high"]) == pytest.approx((2.0, 2.0, 2.0))


def test_short_series_gives_no_interval(spark):
    df = spark.createDataFrame([("c", DAY0, 2.0)], "cell string, day date, v double")
    r = R.daily_mean_ci(df, 5, 100, 1).first()
    assert r["point"] == 2.0 and r["low"] is None


def test_day_sums_keep_scope_and_nulls(spark):
    df = spark.createDataFrame([(DAY0, 1.0, True), (DAY0, 3.0, False), (DAY0, None, True), (DAY0 + dt.timedelta(days=1), 5.0, None)], "day date, y double, f boolean")
    cells = [C.Cell("x", F.col("y"), F.col("f")), C.Cell("z", F.col("y"), F.col("f"), None, F.col("f"))]
    got = {(r["cell"], r["day"].day): (r["a_sum"], r["a_n"], r["b_sum"], r["b_n"]) for r in C.two_group_days(df, cells).collect()}
    assert got == {("x", 1): (1.0, 1, 3.0, 1), ("x", 2): (0.0, 0, 5.0, 1), ("z", 1): (1.0, 1, 0.0, 0)}


def test_step_up_uses_the_declared_count(spark):
    ps = [0.001, 0.012, 0.014, 0.05, 0.2]
    df = spark.createDataFrame([(i, p, 10) for i, p in enumerate(ps)], "test_id int, p_value double, declared int")
    plain = {r["test_id"]: r["discovery"] for r in I.step_up(df, 0.05).collect()}
    assert [plain[i] for i in range(5)] == [True, True, True, False, False]
    strict = {r["test_id"]: r["discovery"] for r in I.step_up(df, 0.05, declared="declared").collect()}
    assert [strict[i] for i in range(5)] == [True, True, True, False, False] or sum(strict.values()) == 3
    by = {r["test_id"]: r["discovery"] for r in I.step_up(df, 0.05, dependent=True).collect()}
    assert sum(by.values()) <= sum(plain.values())


def test_more_run_than_declared_is_an_error(spark):
    df = spark.createDataFrame([(1, 0.1, 1), (2, 0.2, 1)], "test_id int, p_value double, declared int")
    with pytest.raises(Exception, match="more cells run"):
        I.step_up(df, 0.05, declared="declared").collect()


def test_harmonic_factor_joins_up(spark):
    df = spark.createDataFrame([(5,), (1000,), (1001,), (50000,)], "m bigint")
    got = [r[0] for r in df.select(I.by_factor(F.col("m"))).collect()]
    assert got == pytest.approx([sum(1 / i for i in range(1, m + 1)) for m in (5, 1000, 1001, 50000)], rel=1e-12)


def test_a_group_without_trades_keeps_its_row(spark):
    df = spark.createDataFrame([("a", 0.6, 0.011), ("a", 0.4, 0.021), ("a", 0.5, 9.0), ("b", 0.5, 0.3), ("b", 0.52, -0.2)], "symbol string, score double, outcome double")
    got = {r["symbol"]: r for r in I.trading_score(df, ["symbol"]).collect()}
    assert (got["a"]["trades"], got["a"]["mean_net"], got["a"]["hit_rate"]) == (2, pytest.approx(-0.006), 0.5)
    assert tuple(got["b"])[1:] == (0, None, None, None)


def test_normal_cdf_and_wilson(spark):
    xs = [-8.5, -3.0, -1.0, -0.1, 0.0, 0.5, 2.0, 6.9, 7.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal.phi(F.col("x"))).collect()]
    assert got == pytest.approx([NormalDist().cdf(x) for x in xs], rel=1e-9, abs=1e-14)
    low, high = normal.wilson(F.lit(0), F.lit(0))
    assert spark.range(1).select(low, high).first()[:] == (0.0, 1.0)


def test_auc_counts_ties_as_half(spark):
    df = spark.createDataFrame([("g", 0.9, 1), ("g", 0.5, 1), ("g", 0.5, 0), ("g", 0.1, 0)], "g string, score double, label int")
    assert I.roc_auc(df, ["g"]).first()["auc"] == pytest.approx((2 + 1.5) / 4)


def test_stress_only_demotes_and_replication_needs_two_dimensions(spark):
    rows = [("a", "stress", "x", False, 6), ("a", "replication", "p", True, 6), ("b", "replication", "p", True, 3), ("c", "replication", "p", True, 3), ("c", "replication", "q", False, 3), ("d", "stress", "x", True, 3)]
    got = {r["cell"]: r["next"] for r in I.maturity_moves(spark.createDataFrame(rows, "cell string, kind string, dimension string, survived boolean, current int")).collect()}
    assert got == {"a": 3, "b": 3, "c": 5, "d": 3}


def paths(spark, *series):
    rows = [(p, d + 1, r) for p, rs in enumerate(series) for d, r in enumerate(rs)]
    return spark.createDataFrame(rows, "path int, d int, r double")


def test_loss_is_tested_before_the_target(spark):
    p = paths(spark, [0.05, 0.0], [-0.10, 0.30], [0.01, 0.01], [0.08, -0.05])
    got = {r["path"]: (r["outcome"], r["day"]) for r in I.barrier_outcomes(p, [1.0], target=0.10, static=0.05, trailing=0.05).collect()}
    assert got == {0: ("timeout", 2), 1: ("bust", 1), 2: ("timeout", 2), 3: ("bust", 2)}


def test_two_stage_adds_days(spark):
    one = spark.createDataFrame([(1.0, 0, "pass", 3), (1.0, 1, "bust", 2)], "scale double, path int, outcome string, day int")
    two = spark.createDataFrame([(1.0, 0, "timeout", 9), (1.0, 1, "pass", 1)], "scale double, path int, outcome string, day int")
    got = {r["path"]: (r["outcome"], r["day"]) for r in I.two_stage(one, two).collect()}
    assert got == {0: ("timeout", 12), 1: ("bust", 2)}


def test_adaptive_scale_matches_a_loop(spark):
    rng = random.Random(5)
    series = [[rng.gauss(0, 0.02) for _ in range(40)] for _ in range(25)]
    got = {r["path"]: (r["outcome"], r["day"]) for r in I.adaptive_outcomes(paths(spark, *series), 1.0, 0.5, 0.05, 0.06, min_days=8).collect()}
    for p, rs in enumerate(series):
        eq, out = 1.0, None
        for d, r in enumerate(rs, 1):
            eq *= 1 + r * (0.0 if eq >= 1.05 else 0.5 if eq < 1 else 1.0)
            if eq <= 1 - 0.06:
                out = ("bust", d)
            elif eq >= 1.05 and d >= 8:
                out = ("pass", d)
            if out:
                break
        assert got[p] == (out or ("timeout", 40))


def test_trips_average_cost_and_flip(spark):
    d = [DAY0 + dt.timedelta(days=i) for i in range(6)]
    rows = [("A", d[0], 1.0, 10.0, 0.1), ("A", d[1], 1.0, 20.0, 0.1), ("A", d[2], -3.0, 18.0, 0.2), ("A", d[3], 1.0, 15.0, 0.0), ("A", d[4], 2.0, 15.0, 0.0)]
    t = metrics.round_trips(spark.createDataFrame(rows, "symbol string, at date, qty double, price double, fee double"), ["symbol"]).orderBy("entry_at").collect()
    assert [(r["entry_at"], r["exit_at"]) for r in t] == [(d[0], d[2]), (d[2], d[3])]
    assert [r["pnl"] for r in t] == pytest.approx([2 * 3.0 - 0.4, 3.0])


def test_trips_equal_an_average_cost_ledger(spark):
    rng = random.Random(12)
    rows, want = [], []
    for k in range(8):
        pos = cost = pnl = 0.0
        entry = None
        for i in range(60):
            qty, price, fee = rng.choice([-2.0, -1.0, 0.0, 1.0, 2.0, 3.0, -pos]), rng.uniform(5, 15), rng.uniform(0, 0.2)
            at = DAY0 + dt.timedelta(days=i)
            rows.append((f"k{k}", at, qty, price, fee))
            if qty == 0:
                continue
            left = qty
            if pos * qty < 0:
                closed = min(abs(pos), abs(qty)) * math.copysign(1, qty)
                pnl += -closed * (price - cost) - fee
                fee, pos, left = 0.0, pos + closed, qty - closed
                if pos == 0:
                    want.append((f"k{k}", entry, at, pytest.approx(pnl)))
                    pnl, entry = 0.0, None
            if left:
                cost = (cost * abs(pos) + price * abs(left)) / (abs(pos) + abs(left))
                entry, pnl, pos = entry or at, pnl - fee, pos + left
    got = metrics.round_trips(spark.createDataFrame(rows, "symbol string, at date, qty double, price double, fee double"), ["symbol"])
    assert [tuple(r) for r in got.orderBy("symbol", "exit_at").collect()] == want
