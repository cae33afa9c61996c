import datetime as dt
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import asof
from tickloom.operators import cohorts as C
from tickloom.operators import crosssection as K
from tickloom.operators import episodes as N
from tickloom.operators import graph as G
from tickloom.operators import ledger as L
from tickloom.operators import skew
from tickloom.session import shared_folder

T0 = dt.datetime(2024, 1, 1)


def sightings(spark, rows):
    full = [(p, T0 + dt.timedelta(minutes=m), price, 1000.0, alive, i) for i, (p, m, price, alive) in enumerate(rows)]
    return spark.createDataFrame(full, "pool string, observed_at timestamp_ntz, price double, liquidity double, alive boolean, event_id int")


def outcome(spark, rows):
    s = sightings(spark, rows)
    return {r["pool"]: r for r in C.outcomes(s, C.first_sightings(s)).collect()}


def test_sighting_at_discovery_is_not_the_entry(spark):
    r = outcome(spark, [("U", 0, 1.0, True), ("U", 10, 2.0, True), ("U", 22, 3.0, True), ("U", 24, 1.0, True)])["U"]
    assert r["entry_price"] == 2.0 and r["entry_at"] == T0 + dt.timedelta(minutes=10)
    assert r["ret_15m"] == pytest.approx(-0.5) and r["mfe_15m"] == pytest.approx(0.5)
    assert r["ret_60m"] is None and r["minutes_to_peak"] == 12.0


def test_dead_pool_is_a_total_loss(spark):
    r = outcome(spark, [("U", 0, 1.0, True), ("U", 1, 1.0, True), ("U", 14, 9.0, False)])["U"]
    assert (r["ret_15m"], r["mae_15m"], r["delisted_at_min"]) == (-1.0, -1.0, 13.0)


def test_pools_without_an_entry_say_why(spark):
    r = outcome(spark, [("A", 0, 1.0, True), ("B", 0, 1.0, True), ("B", 5, None, True)])
    assert r["A"]["reason"] == "too few observations" and r["B"]["reason"] == "no priced observation after discovery"


def test_costs_and_viable_band(spark):
    low, high = C.viable_notionals(F.col("r"))
    row = spark.createDataFrame([(20_000.0,)], "r double").select(
        low.alias("low"), high.alias("high"), C.round_trip_frac(low, F.col("r")).alias("fl"), C.round_trip_frac(high, F.col("r")).alias("fh")
    ).first()
    assert row["low"] < row["high"] and row["fl"] == pytest.approx(0.15) and row["fh"] == pytest.approx(0.15)
    thin = spark.createDataFrame([(50.0,)], "r double").select(*C.viable_notionals(F.col("r"))).first()
    assert thin[0] is None and thin[1] == 0.0


def test_trimmed_mean_matches_sorting(spark):
    rng = random.Random(2)
    xs = [rng.choice([-1.0, rng.gauss(0, 2), 0.0]) for _ in range(500)]
    net = spark.createDataFrame([(15, f"U{i}", x) for i, x in enumerate(xs)], "horizon int, pool string, net double")
    xs.sort()
    assert C.trimmed_summary(net).first()["trimmed_mean"] == pytest.approx(sum(xs[5:-5]) / 490)


def test_salted_join_and_running_total_are_whole(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    facts = rows.select("k").distinct().withColumn("v", F.length("k"))
    assert skew.with_facts(rows, facts, "k").agg(F.sum("v")).first()[0] == 700 * 3 + 300 * 3
    total = skew.running_total(spark.range(100), F.col("id"), ["id"], F.floor(F.col("id") / 7), "before").orderBy("id").collect()
    assert [r["before"] for r in total] == [i * (i - 1) // 2 for i in range(100)]


def test_first_after_is_strict(spark):
    ev = spark.createDataFrame([("A", 5)], "k string, at int")
    obs = spark.createDataFrame([("A", 5, 1.0), ("A", 7, 2.0), ("A", 6, 3.0)], "k string, t int, v double")
    assert asof.first_after(ev, obs, "k", "at", "t", ["v"]).first()[:] == ("A", 5, 6, 3.0)


def test_asof_join_boundaries(spark):
    left = spark.createDataFrame([("A", 1), ("A", 2), ("A", 5)], "k string, t int")
    right = spark.createDataFrame([("A", 2, 20.0), ("A", 4, 40.0)], "k string, rt int, v double")
    at = [r["v"] for r in asof.asof_join(left, right, ["k"], "t", "rt", ["v"]).orderBy("t").collect()]
    assert at == [None, 20.0, 40.0]
    strict = [r["v"] for r in asof.asof_join(left, right, ["k"], "t", "rt", ["v"], strict=True).orderBy("t").collect()]
    assert strict == [None, None, 40.0]


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_splits_a_hot_key(spark, strict):
    """Half of all rows in one key, null keys and times, ties; buckets of a few rows against a scan."""
    rng = random.Random(6)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
    ls = [(key(), rng.choice([None, *range(0, 400)]), i) for i in range(300)]
    rs = [(key(), rng.choice([None, *range(50, 350, 3), *range(100, 104)]), float(i)) for i in range(200)]
    left, right = spark.createDataFrame(ls, "k string, t int, id int"), spark.createDataFrame(rs, "k string, rt int, v double")
    want = {}
    for k, t, i in ls:
        known = [(rt, v) for rk, rt, v in rs if rk == k and rt is not None and t is not None and (rt < t or rt == t and not strict)]
        want[i] = max(known) if known else (None, None)
    for rows in (7, 1_000_000):
        out = asof.asof_join(left, right, ["k"], "t", "rt", ["v"], strict=strict, bucket_rows=rows)
        assert {r["id"]: (r["asof_rt"], r["v"]) for r in out.collect()} == want
        largest = max(r["count"] for r in out.groupBy("k").count().collect())
    assert largest > 100


@pytest.mark.parametrize("ordered", [20, 50_000])
def test_percentiles_by_refined_selection(spark, ordered):
    """All values of a key within 1e-9, one key with half of all rows, ties, null keys and values."""
    import numpy as np

    rng = random.Random(7)
    rows = [("near", 1 + 1e-9 * rng.random()) for _ in range(2000)] + [("hot", rng.gauss(0, 1e6)) for _ in range(4000)] + [("tied", float(rng.randrange(3))) for _ in range(900)]
    rows += [(None, float(i)) for i in range(101)] + [("one", 5.0), ("none", None), ("none", None), ("hot", None)] + [(f"k{i}", rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = {"low": 0.01, "median": 0.5, "p90": 0.9, "top": 1.0}
    got = {r["k"]: [r[q] for q in qs] for r in skew.exact_percentiles(df, ["k"], "v", qs, ordered=ordered).collect()}
    per = {}
    for k, v in rows:
        if v is not None:
            per.setdefault(k, []).append(v)
    assert got == {k: pytest.approx(np.quantile(vs, list(qs.values())), rel=1e-15) for k, vs in per.items()}
    every = [v for _, v in rows if v is not None]
    assert skew.exact_percentiles(df, [], "v", {"m": 0.5}, ordered=ordered).first()["m"] == pytest.approx(np.median(every))
    assert skew.exact_percentiles(df.where("false"), ["k"], "v", qs).collect() == []


def test_a_bar_is_known_only_after_it_closes(series):
    known = asof.known_at(series(A=[1.0, 2.0, 3.0]), "2024-01-03")
    assert [r["close"] for r in asof.latest_state(known, ["close"]).collect()] == [2.0]


def test_universe_needs_history_and_never_looks_ahead(series):
    bars = series(A=[10.0] * 20, B=[None] * 8 + [99.0] * 12, C=[1.0] * 20).withColumn("quote_volume", F.col("close"))
    u = K.universes(bars, 1, 3, 5, 5, "2024-01-05", "2024-01-20")
    got = {str(r["effective"]): r["symbol"] for r in u.collect()}
    assert got == {"2024-01-05": "A", "2024-01-10": "A", "2024-01-15": "B", "2024-01-20": "B"}


def test_episodes_count_runs(series):
    ep = N.episodes(series(A=[1.0, 5.0, 6.0, 1.0, 7.0]), F.col("close") > 4, "close").orderBy("start").collect()
    assert [(r["days"], r["mean"]) for r in ep] == [(2, 5.5), (1, 7.0)]


def test_batches_expand_in_document_order(spark):
    e = spark.createDataFrame([(2, "H2", "f", "noise", 1, 1, 0.5), (1, "H1", "f", "killed", 3, 2, 0.9)], "doc int, hypothesis string, family string, verdict string, trial_count int, run_count int, dsr double")
    t = L.expand_batches(e, claimed=6).orderBy("trial_id").collect()
    assert [r["hypothesis"] for r in t] == ["H1#1", "H1#2", "H1#3", "H2", "UNALLOCATED#1", "UNALLOCATED#2"]
    assert [r["ran"] for r in t[:4]] == [True, True, False, True] and [r["dsr"] for r in t[:4]] == [0.9, None, None, 0.5]


def test_family_prefix_does_not_match_siblings(spark):
    t = spark.createDataFrame([("info",), ("info.a",), ("information",)], "family string")
    assert L.in_family(t, "info").count() == 2


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_reach_and_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "c")])
    starts = spark.createDataFrame([("a",), ("d",)], "start string")
    assert {(r["start"], r["node"], r["depth"]) for r in G.reach(e, starts).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 3)}
    assert {r["node"] for r in G.reach(e, starts, forward=False).where("start = 'd'").collect()} == {"a", "b", "c", "x"}
    assert G.cyclic_edges(e).count() == 0
    assert {(r["src"], r["dst"]) for r in G.cyclic_edges(edges(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "z")])).collect()} == {("a", "b"), ("b", "c"), ("c", "b")}


def test_deep_graphs_take_few_rounds(spark, monkeypatch):
    """Chains, a tail into a cycle and a ladder far longer than the plain rounds, against walks."""
    rounds = []
    real = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: rounds.append(1) or real(df))
    chain = [(f"c{i}", f"c{i + 1}") for i in range(1500)]
    got = {(r["start"], r["node"]): r["depth"] for r in G.reach(edges(spark, chain), spark.createDataFrame([("c0",), ("c1490",)], "start string")).collect()}
    assert got == {("c0", f"c{i}"): i for i in range(1, 1501)} | {("c1490", f"c{i}"): i - 1490 for i in range(1491, 1501)}
    assert len(rounds) < 35  # two tables a doubling
    rounds.clear()
    tail = [(f"t{i}", f"t{i + 1}") for i in range(700)] + [("t700", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "out"), ("out", "end")] + [(f"e{i}", f"e{i + 1}") for i in range(40)]
    assert {tuple(r) for r in G.cyclic_edges(edges(spark, tail)).collect()} == set(tail[:704])
    assert len(rounds) < 30
    ladder = [(f"{x}{i}", f"{y}{i + 1}") for i in range(40) for x in "lr" for y in "lr"]
    got = {(r["node"], r["depth"]) for r in G.reach(edges(spark, ladder), spark.createDataFrame([("l0",)], "start string"), plain=2).collect()}
    assert got == {(f"{x}{i}", i) for i in range(1, 41) for x in "lr"}
    assert G.cyclic_edges(edges(spark, ladder), plain=2).count() == 0


def test_reach_equals_breadth_first_search_whatever_the_plain_rounds(spark):
    rng = random.Random(4)
    pairs = sorted({(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)})
    starts = ["n0", "n7", "n9"]
    want = set()
    for s in starts:
        seen, level, depth = {s}, [s], 0
        while level:
            depth += 1
            level = sorted({b for a, b in pairs if a in level} - seen)
            seen |= set(level)
            want |= {(s, n, depth) for n in level}
    for plain in (0, 1, 3, 50):
        got = G.reach(edges(spark, pairs), spark.createDataFrame([(s,) for s in starts], "start string"), plain=plain).collect()
        assert {tuple(r) for r in got} == want


def test_independent_support_is_greedy_in_order(spark):
    rng = random.Random(8)
    names = [f"n{i}" for i in range(40)]
    corr = [(a, b, rng.choice([0.2, 0.3, 0.9])) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.3]
    claims = {"c": names, "d": names[5:30:2], "e": names[:1], "f": names[::-1]}
    sup = [(c, n, i) for c, ns in claims.items() for i, n in enumerate(ns)]
    chosen = G.independent_support(spark.createDataFrame(sup, "claim string, node string, ord int"), spark.createDataFrame(corr, "a string, b string, r double"))
    high = {frozenset(x[:2]) for x in corr if x[2] >= 0.7}
    want, counts = set(), set()
    for c, ns in claims.items():
        kept = []
        for i, n in enumerate(ns):
            apart = not any(frozenset((n, k)) in high for k in kept)
            kept += [n] * apart
            want.add((c, n, i, apart))
        counts.add((c, len(ns), len(kept), len(ns) - len(kept)))
    assert {tuple(r) for r in chosen.collect()} == want
    assert {tuple(r) for r in G.support_counts(chosen).collect()} == counts



def test_dense_support_is_chosen_in_blocks_not_from_all_collisions(spark, monkeypatch):
    """90 supporters with half of all pairs correlated: no list of collisions, ties in order, the same choice."""
    rng = random.Random(12)
    names = [f"n{i}" for i in range(90)]
    high = {frozenset((a, b)) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.5}
    corr = spark.createDataFrame([(*sorted(p), 0.9) for p in high], "a string, b string, r double")
    sup = [(c, n, i // 2) for c in "cd" for i, n in enumerate(names if c == "c" else names[::-1])]
    want = set()
    for c in "cd":
        kept = []
        for _, n, i in (s for s in sup if s[0] == c):
            apart = not any(frozenset((n, k)) in high and o < i for k, o in kept)
            kept += [(n, i)] * apart
            want.add((c, n, i, apart))
    monkeypatch.setattr(G, "_discounted", lambda *_: pytest.fail("all collisions were listed"))
    frame = spark.createDataFrame(sup, "claim string, node string, ord int")
    assert {tuple(r) for r in G.independent_support(frame, corr, sparse=0.0).collect()} == want
    assert {tuple(r) for r in G.independent_support(frame, corr).collect()} == want


@pytest.mark.parametrize("share", [0.04, 0.3])
def test_support_over_parts_equals_the_greedy_choice_and_leaves_no_files(spark, monkeypatch, share):
    """Thin and dense graphs over several parts and shares of claims; ties, repeated rows, nulls; scratch frames are deleted."""
    rng = random.Random(14)
    names = [f"n{i}" for i in range(90)]
    high = {frozenset((a, b)) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < share}
    corr = [(*rng.sample(sorted(p), 2), rng.choice([0.9, -0.7])) for p in high] + [("n0", "n0", 1.0), ("n1", "n2", 0.1), ("n3", None, 0.9)]
    sup = [(c, n, rng.randrange(60)) for c in "cdef" for n in rng.sample(names, 70)]
    sup += [(c, n, i + 3) for c, n, i in sup[:5]] + [(None, "n4", 1), (None, "n5", 2), ("c", "solo", 0), ("g", "n6", None), ("g", "n7", 1)]
    want = []
    for c, n, i in sup:
        least = {}
        for d, m, j in sup:
            if d == c and c is not None and j is not None:
                least[m] = min(j, least.get(m, j))
        kept = {}
        for m in sorted(least, key=lambda m: least[m]):
            kept[m] = not any(kept[k] and least[k] < least[m] and frozenset((k, m)) in high for k in kept)
        want.append((c, n, i, kept.get(n, True)))
    monkeypatch.setattr(G, "TILE", 400, raising=False)
    monkeypatch.setattr(G, "LISTS", 60, raising=False)
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = {p.parent for p in folder.rglob("part-*")}
    got = G.independent_support(spark.createDataFrame(sup, "claim string, node string, ord int"), spark.createDataFrame(corr, "a string, b string, r double"))
    assert len({p.parent for p in folder.rglob("part-*")} - before) <= 1
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_dense_graphs_with_cycles_are_never_squared(spark, monkeypatch):
    """Two dense parts, one acyclic, and a chain longer than the plain rounds that ends beside them."""
    pairs = [(f"a{i:02}", f"a{j:02}") for i in range(30) for j in range(i + 1, 30)] + [("a29", "a03")]
    dead = [(f"d{i:02}", f"d{j:02}") for i in range(25) for j in range(i + 1, 25)]
    chain = [(f"c{i}", f"c{i + 1}") for i in range(9)] + [("c9", "a07"), ("c4", "d00"), ("a29", "d03")]
    monkeypatch.setattr(G, "DOUBLED", 1)
    monkeypatch.setattr(G, "squared", lambda *_: pytest.fail("a dense graph was squared"))
    assert {tuple(r) for r in G.cyclic_edges(edges(spark, pairs + dead + chain)).collect()} == set(pairs) | {e for e in chain if not e[1].startswith("d")}


def test_impact_makes_its_edges_once(spark, monkeypatch):
    from tickloom.plans import ledger

    read = spark.sparkContext.accumulator(0)

    def counted(x):
        read.add(1)
        return x

    made = edges(spark, [(f"N{i}", f"N{i + 1}") for i in range(38, 44)]).select("src", F.udf(counted, "string")("dst").alias("dst"))
    monkeypatch.setattr(ledger.market, "edges", lambda *_: made)
    got = {r["node"] for r in ledger.graph_impact(spark, "").where("start = 'N40'").collect()}
    assert got == {"N38", "N39", "N41", "N42", "N43", "N44"} and read.value == 6


def test_exact_percentiles_match_a_sort(spark):
    rng = random.Random(6)
    xs = [rng.choice([0.0, 0.0, rng.gauss(0, 3), rng.gauss(50, 1)]) for _ in range(777)]
    df = spark.createDataFrame([("k", x) for x in xs], "k string, x double")
    got = skew.exact_percentiles(df, ["k"], "x", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}, buckets=16).first()
    xs.sort()

    def linear(q):
        h = q * (len(xs) - 1)
        lo = int(h)
        return xs[lo] + (h - lo) * (xs[min(lo + 1, len(xs) - 1)] - xs[lo])

    assert got[1:] == pytest.approx([linear(q) for q in (0.0, 0.25, 0.5, 0.99, 1.0)])
