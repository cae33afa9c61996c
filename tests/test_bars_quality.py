import datetime as dt

import pytest
from conftest import DAY0
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import quality as Q
from tickloom.sources import lake, landing


def hours(spark, n, skip=()):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("A", t0 + dt.timedelta(hours=i), 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, 10.0) for i in range(n) if i not in skip]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def test_resample_drops_incomplete_buckets(spark):
    assert B.resample(hours(spark, 5), "1h", "6h").count() == 0
    (bar,) = B.resample(hours(spark, 6), "1h", "6h").collect()
    assert (bar["open"], bar["high"], bar["low"], bar["close"], bar["volume"]) == (100.0, 106.0, 99.0, 105.5, 60.0)
    assert B.resample(hours(spark, 12, skip={3}), "1h", "6h").count() == 1
    with pytest.raises(ValueError):
        B.resample(hours(spark, 6), "6h", "1h")


def test_index_is_listing_aware_and_does_not_bridge_holes(series):
    idx = B.chained_index(series(A=[100.0, 110.0, 121.0, 121.0], B=[None, 50.0, 100.0, 100.0])).orderBy("day").collect()
    assert [r["n"] for r in idx] == [0, 1, 2, 2]
    assert [r["level"] for r in idx] == pytest.approx([100.0, 110.0, 110.0 * 1.55, 110.0 * 1.55])
    hole = B.chained_index(series(A=[100.0, None, 121.0], B=[10.0, 10.0, 10.0])).orderBy("day").collect()
    assert [r["n"] for r in hole] == [0, 1, 1]


def raw(spark, rows):
    full = [("A", DAY0 + dt.timedelta(days=d), o, h, lo, c, v, i) for i, (d, o, h, lo, c, v) in enumerate(rows)]
    return spark.createDataFrame(full, "symbol string, ts date, open double, high double, low double, close double, volume double, seq int")


GOOD = [(d, 10.0, 11.0, 9.0, 10.0 + 0.1 * (d % 3), 5.0) for d in range(12)]


def found(spark, rows):
    df = raw(spark, rows)
    uns = Q.unsorted_rows(df, F.col("seq"), F.floor(F.col("seq") / 4))
    return {r["check"]: r for r in Q.findings(Q.by_stamp(df, "seq"), 86_400, uns).collect()}


def test_clean_rows_have_no_errors(spark):
    assert not [c for c in found(spark, GOOD) if Q.SEVERITY[c] == "error"]


@pytest.mark.parametrize(
    ("check", "rows", "count"),
    [
        ("nulls", [*GOOD, (12, 10.0, 11.0, 9.0, None, 5.0)], 1),
        ("duplicates", [*GOOD, (11, 10.0, 11.0, 9.0, 10.0, 5.0)], 2),
        ("unsorted", [GOOD[1], GOOD[0], *GOOD[2:]], 1),
        ("incoherent", [*GOOD, (12, 10.0, 9.5, 9.0, 10.0, 5.0)], 1),
        ("incoherent", [*GOOD, (12, 10.0, 11.0, 9.0, 10.0, -1.0)], 1),
        ("gaps", [*GOOD, (15, 10.0, 11.0, 9.0, 10.0, 5.0)], 1),
        ("zero_volume", [*GOOD, (12, 10.0, 11.0, 9.0, 10.0, 0.0)], 1),
    ],
)
def test_each_fault_is_found(spark, check, rows, count):
    assert found(spark, rows)[check]["count"] == count


def test_gap_counts_missing_bars_and_names_the_bar_after(spark):
    gap = found(spark, [*GOOD, (15, 10.0, 11.0, 9.0, 10.0, 5.0)])["gaps"]
    assert gap["missing"] == 3 and gap["examples"] == [DAY0 + dt.timedelta(days=15)]


def test_outlier_return(spark):
    rows = [(d, 10.0, 2000.0, 1.0, 10.0 + 0.01 * ((d * d * 7) % 11), 5.0) for d in range(30)]
    rows[20] = (20, 10.0, 2000.0, 1.0, 100.0, 5.0)
    assert found(spark, rows)["outliers"]["count"] == 2


def test_lag_in_buckets_equals_a_plain_lag(spark):
    df = spark.range(200).select(F.lit("A").alias("k"), "id", (F.col("id") * 37 % 101).alias("v"))
    out = Q.lag_in_buckets(df, "k", F.col("id"), F.floor(F.col("id") / 17), "v", "prev").orderBy("id").collect()
    assert [r["prev"] for r in out] == [None] + [r["v"] for r in out[:-1]]


def test_rows_behind_the_stamps_are_read_once(spark):
    """The medians are refined in several jobs; each used to aggregate the raw rows anew."""
    read = spark.sparkContext.accumulator(0)

    def counted(x):
        read.add(1)
        return x

    rows = spark.range(400).select(F.concat(F.lit("S"), F.col("id") % 2).alias("symbol"), F.udf(counted, "bigint")("id").alias("id"))
    price = 100.0 + F.col("id") * 37 % 101
    stamped = rows.select("symbol", F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("id") / 2).cast("int")).alias("ts"), "id", *[price.alias(c) for c in ("open", "high", "low", "close", "volume")])
    found = Q.findings(Q.by_stamp(stamped, "id"), 86_400).collect()
    assert {r["check"] for r in found} == {"outliers"} and read.value == 400


def test_unsorted_rows_equal_a_plain_lag(spark):
    df = spark.range(300).select(F.concat(F.lit("S"), F.col("id") % 3).alias("symbol"), "id", (F.col("id") * 37 % 101).alias("ts"))
    plain = df.withColumn("p", F.lag("ts").over(W.partitionBy("symbol").orderBy("id"))).groupBy("symbol").agg(F.count_if(F.col("ts") < F.col("p")).alias("unsorted"))
    assert set(Q.unsorted_rows(df, F.col("id"), F.floor(F.col("id") / 17)).collect()) == set(plain.collect())


def lake_rows(spark, days, close):
    rows = [("A", "1d", dt.datetime(2023, 12, 30) + dt.timedelta(days=d), 1.0, 2.0, 0.5, close, 9.0) for d in days]
    return spark.createDataFrame(rows, "symbol string, interval string, timestamp timestamp, open double, high double, low double, close double, volume double")


def test_lake_merge_is_idempotent_and_new_rows_win(spark, tmp_path):
    path = str(tmp_path / "lake")
    lake.write_bars(lake_rows(spark, range(5), 1.0), path)
    lake.write_bars(lake_rows(spark, [3, 4, 5], 2.0), path)
    lake.write_bars(lake_rows(spark, [3, 4, 5], 2.0), path)
    got = lake.read_bars(spark, path, "A", "1d").collect()
    assert [r["close"] for r in got] == [1.0, 1.0, 1.0, 2.0, 2.0, 2.0]
    half_open = lake.read_bars(spark, path, "A", "1d", "2023-12-31", "2024-01-02")
    assert [r["timestamp"].day for r in half_open.collect()] == [31, 1]
    plan = half_open._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan.split("PartitionFilters")[1][:400]


def test_epoch_rows_become_bars(spark):
    r = spark.createDataFrame([(1704067200000, 1.0, 2.0, 0.5, 1.5, 7.0)], "epoch_ms long, o double, h double, l double, c double, v double")
    assert lake.bars_from_rows(r).first()["timestamp"] == dt.datetime(2024, 1, 1)


def test_series_schema_drift_is_refused(spark, tmp_path):
    p = f"{tmp_path}/kind=funding/key=A"
    spark.createDataFrame([(dt.datetime(2024, 1, 1), 0.1, 1)], "timestamp timestamp, rate double, extra int").write.parquet(p)
    with pytest.raises(ValueError, match="extra"):
        landing.read_series(spark, str(tmp_path), "funding", "A")
    assert landing.read_series(spark, str(tmp_path), "funding", "A", strict=False).columns == ["timestamp", "rate"]


def test_json_rows_skip_malformed_lines(spark, tmp_path):
    d = tmp_path / "dt=2024-01-02"
    d.mkdir(parents=True)
    (d / "a.json").write_text('{"pool":"U1","price":1.5,"alive":true}\nnot json\n{"pool":"U2","price":2.5,"alive":false}\n')
    assert sorted(r["pool"] for r in landing.read_json_rows(spark, str(tmp_path)).collect()) == ["U1", "U2"]
    assert landing.read_json_rows(spark, str(tmp_path), since="2024-01-03").count() == 0


def test_safe_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("n/a",), ("NaN",), ("inf",), (None,)], "x string")
    assert [r[0] for r in df.select(landing.safe_double(F.col("x"))).collect()] == [1.5, None, None, None, None]


def test_quote_split_prefers_the_longest(spark):
    df = spark.createDataFrame([("BTCUSDC",), ("BTC",), ("ETHBTC",), ("XFDUSD",)], "s string")
    b, q = landing.base_and_quote(F.col("s"))
    assert [tuple(r) for r in df.select(b, q).collect()] == [("BTC", "USDC"), (None, None), ("ETH", "BTC"), ("X", "FDUSD")]


def test_calendar_flags(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, d),) for d in (1, 3, 27, 28, 29)], "day date")
    got = [(r["turn_of_month"], r["weekend"]) for r in B.calendar_flags(df).orderBy("day").collect()]
    assert got == [(True, False), (False, True), (False, False), (True, False), (True, False)]




def test_ends_of_bars_are_found_without_sorting_ticks(spark, tmp_path):
    """Ticks that share stamp and order, at either end, are told apart by the rest of their key; raw ticks are not sorted."""
    import random

    from tickloom.sources import market

    draw, rows = random.Random(4), []
    for _ in range(600):
        at = dt.datetime(2024, 1, 1 + draw.randrange(3), draw.choice([0, 0, 9]))
        rows.append((draw.randrange(4), draw.randrange(3), draw.randrange(8), draw.randrange(2), float(draw.randrange(1, 50)), draw.random() * 100, 0.01, draw.choice([None, 0.02, 0.04]), draw.choice("ANR"), "O", at))
    rows.append((None, 1, 5, 1, 2.0, 7.0, 0.0, 0.0, "A", "O", dt.datetime(2024, 1, 1)))
    rows.append((9, 1, 5, 1, 2.0, 7.0, 0.0, 0.0, "A", "O", None))
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    ticks = market.ticks(spark, str(tmp_path))
    plain = ticks.groupBy("symbol", "day").agg(
        F.min_by("price", "seq"), F.max("price"), F.min("price"), F.max_by("price", "seq"), F.round(F.sum("qty"), 6), F.round(F.sum("notional"), 6)
    )
    found = market.bars_1d(spark, str(tmp_path))
    rounded = found.withColumns({c: F.round(c, 6) for c in ("volume", "quote_volume")})
    assert sorted(map(tuple, rounded.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    legs = ticks.groupBy("symbol", "day").agg(F.max_by("price", "seq").alias("c"), F.avg("l_tax").alias("t")).selectExpr("symbol", "day", "c", "round(c * (1 + (t - 0.04) / 10), 9)")
    perp = market.spot_perp_1d(spark, str(tmp_path)).withColumn("perp_close", F.round("perp_close", 9))
    assert sorted(map(tuple, perp.collect()), key=str) == sorted(map(tuple, legs.collect()), key=str)
    for made in (market.bars_1d, market.bars_wk, market.venue_1d, market.spot_perp_1d):
        plan = made(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
