import datetime as dt
import math
import random
import statistics

import pytest
from conftest import DAY0, by_day
from pyspark.sql import functions as F

from tickloom.operators import books, pairs
from tickloom.operators import signals as S


def walk(n, seed, start=100.0, sd=0.02):
    rng, out = random.Random(seed), [start]
    for _ in range(n - 1):
        out.append(out[-1] * math.exp(rng.gauss(0, sd)))
    return out


def test_breakout_enters_holds_and_leaves(series):
    closes = [100.0] * 6 + [120.0, 119.0, 118.0, 90.0, 90.0]
    assert by_day(S.with_breakout(series(A=closes), 4), "breakout") == [0.0] * 6 + [1.0, 1.0, 1.0, 0.0, 0.0]


def test_stop_fires_and_clears_on_a_new_high(series):
    closes = [100.0 + 0.1 * i for i in range(32)] + [80.0, 85.0, 120.0, 119.9]
    got = by_day(S.with_stop(series(A=closes)), "stopped")
    assert not any(got[:32]) and got[32:] == [True, True, False, False]


def test_signals_ignore_the_future(series):
    a = walk(120, 1)
    keep = ["ts_momentum", "vol_target", "blend", "breakout", "stopped", "bollinger"]
    one = S.single_name_signals(series(A=a)).orderBy("day").select(*keep).collect()
    two = S.single_name_signals(series(A=a[:-1] + [1.0])).orderBy("day").select(*keep).collect()
    assert one[:-1] == two[:-1]


def test_vol_target_steps(series):
    a = walk(60, 2)
    got = by_day(S.single_name_signals(series(A=a)), "vol_target")
    rets = [y / x - 1 for x, y in zip(a, a[1:])]
    for i in range(60):
        want = 0.0
        if i >= 30 and a[i] > a[i - 30]:
            want = round(min(1.0, 0.30 / (statistics.stdev(rets[i - 30 : i]) * math.sqrt(365))) * 20) / 20
        assert got[i] == pytest.approx(want)


def loop_ledger(bars, targets, cash=10_000.0):
    """Straight restatement of the ledger rules for one symbol."""
    pos, last, pending, out = 0.0, None, 0.0, []
    for (o, c, v), t in zip(bars, targets, strict=True):
        if pending:
            part = min(abs(pending) / v, 1.0) if v > 0 else 1.0
            price = o * (1 + math.copysign(1, pending) * (1 + 25 * part) * 1e-4)
            cash -= pending * price + abs(pending) * price * 10 * 1e-4
            pos += pending
            pending = 0.0
        t = max(0.0, min(1.0, t))
        if t != last:
            pending = t * (cash + pos * c) / c - pos
            last = t
        out.append(cash + pos * c)
    return out


def test_single_name_ledger_matches_a_loop(series, spark):
    a = walk(80, 3)
    rng = random.Random(4)
    targets = [rng.choice([0.0, 0.0, 0.5, 1.0, 1.5]) for _ in a]
    t = spark.createDataFrame([(DAY0 + dt.timedelta(days=i), x) for i, x in enumerate(targets)], "day date, target double")
    df = series(A=a).join(t, "day")
    got = by_day(books.ledger(df, ["symbol"]), "equity")
    want = loop_ledger([(c, c, 100.0 + i) for i, c in enumerate(a)], targets)
    assert got == pytest.approx(want)


def test_zero_cost_fills_charge_nothing(series):
    df = series(A=[100.0, 100.0, 100.0]).withColumn("target", F.lit(1.0))
    f = books.fills(df, ["symbol"], fee_bps=0.0, half_spread_bps=0.0, impact_bps=0.0).first()
    assert (f["qty"], f["price"], f["fee"]) == (100.0, 100.0, 0.0)


def test_last_bar_order_is_dropped(series):
    df = series(A=[100.0, 100.0]).withColumn("target", F.when(F.col("day") == DAY0, 0.0).otherwise(1.0))
    assert books.fills(df, ["symbol"]).count() == 0


def test_screened_book_matches_a_loop(series):
    px = {s: walk(40, i) for i, s in enumerate("ABC")}
    px["C"] = [None] * 10 + px["C"][10:]
    bars = series(**px).withColumn("ret", S.ret())
    w = S.rotation(bars, 5, 2)
    got = books.screened_book(books.book_bars(bars, {"r": w}), 1e-3).orderBy("day").collect()
    weights = {(r["day"], r["symbol"]): r["weight"] for r in w.collect()}
    want = [[0.0, 0.0] for _ in range(40)]
    for s, closes in px.items():
        first = next(i for i, c in enumerate(closes) if c is not None)
        chosen = [weights.get((DAY0 + dt.timedelta(days=i), s), 0.0) for i in range(40)]
        for i in range(first + 1, 40):
            was = chosen[i - 2] if i - 2 >= first else 0.0
            want[i][0] += chosen[i - 1] * (closes[i] / closes[i - 1] - 1) - 1e-3 * abs(chosen[i - 1] - was)
            want[i][1] += abs(chosen[i - 1] - was)
    assert [(r["ret"], r["turnover"]) for r in got] == [pytest.approx(tuple(x)) for x in want]


def test_rotation_keeps_positive_names_only(series):
    w = S.rotation(series(A=[1.0, 2.0], B=[2.0, 1.0], C=[1.0, 1.5]), 1, 2)
    assert {(r["symbol"], r["weight"]) for r in w.collect()} == {("A", 0.5), ("C", 0.5)}


def test_ladder_leaves_dead_names_in_cash(spark):
    d = [DAY0 + dt.timedelta(days=i) for i in range(4)]
    q = spark.createDataFrame([(d[0], "A"), (d[0], "B"), (d[1], "A")], "day date, symbol string")
    live = spark.createDataFrame([(x, "A") for x in d] + [(d[0], "B")], "day date, symbol string")
    got = {(r["day"], r["symbol"]): r["weight"] for r in S.tranche_ladder(q, live, 2).collect()}
    assert got == pytest.approx({(d[0], "A"): 0.25, (d[0], "B"): 0.25, (d[1], "A"): 0.75, (d[2], "A"): 0.5})


def test_drawdown_guard_latches_and_halt_rearms(spark):
    rows = [("x", i, DAY0 + dt.timedelta(days=i // 2), 1.0, e) for i, e in enumerate([100.0, 97.5, 97.0, 93.0, 89.9, 120.0])]
    df = spark.createDataFrame(rows, "k string, ts int, day date, target double, equity double")
    guard = [r["allowed"] for r in S.risk_caps(df, "k", soft=0.05, hard=0.10).orderBy("ts").collect()]
    assert guard == pytest.approx([1.0, 1.0, 1.0, 0.6, 0.0, 0.0])
    halt = [r["allowed"] for r in S.risk_caps(df, "k", daily_loss=0.02).orderBy("ts").collect()]
    assert halt == [1.0, 0.0, 1.0, 0.0, 1.0, 1.0]


def carry_rows(spark, seed=7):
    rng, rows = random.Random(seed), []
    for i in range(30):
        for s in "AB" if i < 15 else "ABC":
            if rng.random() > 0.1:
                rows.append((s, DAY0 + dt.timedelta(days=i), rng.gauss(0, 0.02), rng.gauss(0, 0.02), rng.gauss(1e-4, 1e-4), rng.random() > 0.4))
    return rows, spark.createDataFrame(rows, "symbol string, day date, r_spot double, r_perp double, funding double, hold boolean")


@pytest.mark.parametrize("over", ["present", "held"])
def test_carry_book_matches_a_loop(spark, over):
    rows, df = carry_rows(spark)
    got = books.carry_book(df.withColumn("book", F.lit("x")), cost_rate=1e-3, over=over).orderBy("day").collect()
    held, want = {}, []
    for day in sorted({r[1] for r in rows}):
        today = [r for r in rows if r[1] == day]
        n = sum(r[5] for r in today) if over == "held" else len(today)
        gain = cost = 0.0
        for s, _, rs, rp, f, hold in today:
            share = 0.5 / n if hold else 0.0
            gain += share * (rs - rp + f)
            cost += abs(share - held.get(s, 0.0)) * 2e-3
            held[s] = share
        want.append((gain - cost, -cost, len(today)))
    assert [(r["ret"], r["cost_ret"], r["n_symbols"]) for r in got] == [pytest.approx(w) for w in want]


def test_gross_parts_equal_the_book_without_costs(spark):
    _, df = carry_rows(spark)
    book = books.carry_book(df.withColumn("book", F.lit("x")), cost_rate=0.0).orderBy("day").collect()
    gross = books.carry_gross(df).orderBy("day").collect()
    assert [r["funding_ret"] for r in book] == pytest.approx([r["funding_ret"] for r in gross])
    assert [r["basis_ret"] for r in book] == pytest.approx([r["basis_ret"] for r in gross])


def test_positive_funding_pays_the_short(spark):
    d = [DAY0 + dt.timedelta(days=i) for i in range(3)]
    legs = spark.createDataFrame([("A", x, 100.0, 100.0) for x in d], "symbol string, day date, close double, perp_close double")
    rates = spark.createDataFrame([("A", x, 0.001) for x in d for _ in range(3)], "symbol string, day date, rate double")
    g = books.carry_gross(books.carry_frame(legs, rates)).collect()
    assert [r["funding_ret"] for r in g] == pytest.approx([0.5 * 0.003] * 2)


def test_walk_forward_matches_a_loop(series):
    grid = {2.0: "m2", 5.0: "m5"}
    walks = {"A": walk(140, 9), "B": walk(95, 10), "C": walk(79, 11)}
    df = series(**walks).select("symbol", "day", S.ret().alias("ret"), *(S.ts_momentum(int(p)).alias(c) for p, c in grid.items()))
    rows = books.walk_forward(df, grid, warmup=6, train=60, test=20, cost_rate=0.002).orderBy("symbol", "day").collect()
    for name, a in walks.items():
        got, n = [r for r in rows if r["symbol"] == name], len(a)
        daily = {}
        for p in (2, 5):
            target = [1.0 if i >= p and a[i] > a[i - p] else 0.0 for i in range(n)]
            held = [0.0, *target[:-1]]
            daily[p] = [(h * (a[i] / a[i - 1] - 1) if i else 0.0) - 0.002 * abs(h - (held[i - 1] if i else 0.0)) for i, h in enumerate(held)]
        level, want = 10_000.0, []
        for w in range((n - 80) // 20 + 1 if n >= 80 else 0):
            lo, best = w * 20, None
            for p in (2, 5):
                r = daily[p][lo + 6 : lo + 60]
                sd = statistics.stdev(r)
                sharpe = statistics.mean(r) / sd * math.sqrt(365) if sd > 0 else 0.0
                if best is None or sharpe > best[0] + 1e-12:
                    best = (sharpe, p)
            for x in daily[best[1]][lo + 60 : lo + 80]:
                level *= 1 + x
                want.append((w, best[1], pytest.approx(best[0]), pytest.approx(level)))
        assert [(r["window"], r["param"], r["train_sharpe"], r["equity"]) for r in got] == want
    with pytest.raises(ValueError):
        books.walk_forward(df, grid, warmup=60, train=60, test=20)


def test_cointegrated_pair_is_admitted_and_independent_walks_rarely(spark, series):
    rng = random.Random(1)
    b = walk(200, 21)
    a = [x**1.2 * math.exp(rng.gauss(0, 0.01)) for x in b]
    df = series(A=a, B=b, C=walk(200, 22), D=walk(200, 23)).withColumn("g", F.lit(0))
    stats = pairs.engle_granger(pairs.log_pairs(df, ["g"]), ["g"])
    got = {(r["sa"], r["sb"]): r for r in stats.collect()}
    assert len(got) == 6 and got[("A", "B")]["hedge"] == pytest.approx(1.2, abs=0.1)
    assert [(r["sa"], r["sb"]) for r in pairs.formed(stats, ["g"], 0.01).where("priority = 1").collect()] == [("A", "B")]


def test_adf_statistic_matches_least_squares(spark, series):
    import numpy as np

    a, b = walk(90, 31), walk(90, 32)
    df = series(A=a, B=b).withColumn("g", F.lit(0))
    got = pairs.engle_granger(pairs.log_pairs(df, ["g"]), ["g"]).first()
    la, lb = np.log(a), np.log(b)
    beta, alpha = np.polyfit(lb, la, 1)
    s = la - beta * lb - alpha
    y, x = s[2:] - s[1:-1], np.column_stack([np.ones(88), s[1:-1], s[1:-1] - s[:-2]])
    coef, *_ = np.linalg.lstsq(x, y, rcond=None)
    sigma2 = ((y - x @ coef) ** 2).sum() / (88 - 3)
    assert got["adf"] == pytest.approx(coef[1] / math.sqrt(sigma2 * np.linalg.inv(x.T @ x)[1, 1]), rel=1e-6)


def test_pairs_book_opens_marks_and_closes(spark):
    d = [DAY0 + dt.timedelta(days=i) for i in range(6)]
    zs, ra = [2.5, 1.0, 0.1, 0.0, 4.5, -2.2], [0.0, -0.02, -0.01, 0.0, 0.0, 0.0]
    rows = [(0, i, d[i], "A", "B", 1, zs[i], ra[i], 0.0) for i in range(6)]
    days = spark.createDataFrame(rows, "regime int, t int, day date, sa string, sb string, priority int, z double, ra double, rb double")
    got = pairs.pairs_book(days, [(2.0, 0.5)], cost_rate=1e-3).orderBy("day").collect()
    assert [r["n_open"] for r in got] == [1, 1, 0, 0, 0, 1]
    assert [r["ret"] for r in got] == pytest.approx([0.0, (0.02 - 2e-3) / 2, 0.01 / 2, -2e-3 / 2, 0.0, 0.0])
