import statistics

import pytest
from conftest import by_day
from pyspark.sql import functions as F

from tickloom.functions import features as X
from tickloom.functions import windows as V
from tickloom.operators import samples

CLOSES = [100.0, 102.0, 101.0, 105.0, 107.0, 103.0, 108.0, 110.0, 109.0, 112.0]


def test_rolling_needs_a_full_window_and_conventions_differ(series):
    p = X.panel(series(A=CLOSES), [[X.vol_before(3, "before"), X.vol_through(3, "through")]], base=("symbol", "day", "close", "ret"))
    rets = [b / a - 1 for a, b in zip(CLOSES, CLOSES[1:])]
    before, through = by_day(p, "before"), by_day(p, "through")
    assert before[:4] == [None] * 4 and through[:3] == [None] * 3
    assert through[3] == pytest.approx(statistics.stdev(rets[0:3]))
    assert before[4] == pytest.approx(through[3])


def test_windows_never_cross_symbols(series):
    both = X.panel(series(A=CLOSES, B=[5.0] * 10), [[X.momentum(3)]], base=("symbol", "day", "close", "ret"))
    alone = X.panel(series(A=CLOSES), [[X.momentum(3)]], base=("symbol", "day", "close", "ret"))
    assert by_day(both, "r3", "A") == by_day(alone, "r3", "A")
    assert by_day(both, "ret", "B")[0] is None


def test_percentile_of_a_rising_series_is_one(series):
    df = series(A=[float(i) for i in range(1, 11)]).withColumn("pct", V.trailing_percentile("close", 4))
    assert by_day(df, "pct") == [None] * 4 + [1.0] * 6


def test_percentile_null_policies(spark, series):
    df = series(A=[3.0, 1.0, 2.0, 5.0, 4.0]).withColumn("x", F.when(F.col("close") != 1.0, F.col("close")))
    df = df.withColumns({"skip": V.trailing_percentile("x", 3, skip_nulls=True), "keep": V.trailing_percentile("x", 3)})
    assert by_day(df, "skip")[3:] == [1.0, 2 / 3]
    assert by_day(df, "keep")[3:] == [3 / 4, 2 / 4]


def test_true_range_of_the_first_bar_is_its_range(series):
    p = X.panel(series(A=[100.0, 90.0]), [[X.true_range()]], base=("symbol", "day", "close", "high", "low"))
    assert by_day(p, "tr") == pytest.approx([2.0, 100.0 - 89.1])


def test_relative_forms_differ(series):
    df = series(A=[1.0, 2.0]).withColumn("b", F.col("close") * F.when(F.col("close") == 2, 2).otherwise(1))
    p = df.select("symbol", "day", X.relative_forward_ratio(1, "close", "b", "r").expr.alias("r"), X.relative_forward_difference(1, "close", "b", "d").expr.alias("d"))
    row = p.orderBy("day").first()
    assert row["r"] == pytest.approx(2 / 4 - 1) and row["d"] == pytest.approx(1 - 3)


def test_features_do_not_see_the_future(series):
    stages = [[X.momentum(2), X.vol_through(3, "v"), X.rolling_max("close", 3, "hi"), X.Feature("pct", V.trailing_percentile("close", 3))]]
    base = ("symbol", "day", "close", "ret")
    clean = X.panel(series(A=CLOSES), stages, base).orderBy("day").collect()
    poisoned = X.panel(series(A=CLOSES[:-1] + [9e9]), stages, base).orderBy("day").collect()
    assert clean[:-1] == poisoned[:-1]


def test_robust_z_matches_a_loop(series):
    xs = [float((7 * i * i) % 23) for i in range(30)]
    z = by_day(V.robust_z(series(A=[x + 1 for x in xs]), "close", 5), "z")
    vals = [x + 1 for x in xs]
    med = [statistics.median(vals[i - 5 : i]) if i >= 5 else None for i in range(30)]
    dev = [abs(vals[i - 1] - med[i]) if med[i] is not None else None for i in range(30)]
    for i in range(30):
        if i < 9:
            assert z[i] is None
            continue
        mad = statistics.median(dev[i - 4 : i + 1])
        assert z[i] == (pytest.approx((vals[i] - med[i]) / (1.4826 * mad)) if mad else None)


def test_barrier_label_first_touch_and_ambiguity(spark, series):
    wiggle = [100.0 * (1.01 if i % 2 else 0.99) for i in range(25)]
    flat = samples.labelled(samples.channels(series(A=wiggle + [100.0] * 6)), horizon=3, k=5.0)
    assert set(by_day(flat, "label")) == {0}
    up = samples.labelled(samples.channels(series(A=wiggle + [150.0] * 6)), horizon=3)
    labels = by_day(up, "label")
    assert labels[24] == 1 and labels[-3:] == [0, 0, 0]
