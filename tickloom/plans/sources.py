"""Source and sink round trips through the shared folder, and the plain feature panel."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions import features as X
from tickloom.operators.bars import wide
from tickloom.plans.oracle import over, rolling
from tickloom.registry import query
from tickloom.session import shared_folder
from tickloom.sources import lake, landing, market


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query("series_round_trip", "A3 Q11", over("perp_1d", """
SELECT symbol, count(*) AS rows, CAST(0 AS BIGINT) AS null_times, CAST(0 AS BIGINT) AS repeated_times, R6(avg(perp_close)) AS mean FROM perp_1d GROUP BY symbol"""))
def series_round_trip(spark, sf_dir):
    """Typed series written by kind and key, read back strictly, integrity counted."""
    root = _scratch(spark)
    legs = market.spot_perp_1d(spark, sf_dir).select(F.lit("perp").alias("kind"), F.col("symbol").alias("key"), F.col("day").cast("timestamp").alias("day"), "perp_close")
    legs.repartition("kind", "key").write.partitionBy("kind", "key").parquet(root)
    out = None
    for (key,) in sorted(legs.select("key").distinct().collect()):  # one row a series, as the lake lists them
        s = landing.read_series(spark, root, "perp", key)
        part = landing.series_faults(s, "perp").withColumns({"symbol": F.lit(key), "mean": s.agg(F.avg("perp_close")).scalar()})
        out = part if out is None else out.unionByName(part)
    return out


@query("lake_round_trip", "A1 A2 A17 F1", over("bars_1d", """
SELECT symbol, CAST(day AS VARCHAR) AS day, R6(close) AS close, R6(close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1) AS ret FROM bars_1d WHERE symbol = 'RO' AND day >= DATE '1997-03-01' AND day < DATE '1998-02-01'"""))
def lake_round_trip(spark, sf_dir):
    """Bars into the partitioned lake in two overlapping batches, one pruned range read back."""
    root = _scratch(spark)
    bars = market.bars_1d(spark, sf_dir).select(
        "symbol", F.lit("1d").alias("interval"), F.col("day").cast("timestamp").alias("timestamp"), "open", "high", "low", "close", "volume"
    )
    lake.write_bars(bars.where("timestamp < timestamp'1998-01-01'").withColumn("close", F.lit(0.0)), root)
    lake.write_bars(bars, root)
    got = lake.read_bars(spark, root, "RO", "1d", "1997-03-01", "1998-02-01").select("symbol", F.to_date("timestamp").alias("day"), "close")
    return got.withColumn("ret", X.ret().expr)


@query("json_registry_round_trip", "A7 A8 A9", over("sightings", """
SELECT CAST(CAST(observed_at AS DATE) AS VARCHAR) AS dt, count(*) AS rows, count(DISTINCT pool) AS pools, R6(sum(price)) AS price FROM sightings WHERE observed_at >= TIMESTAMP '2024-01-10' GROUP BY 1"""))
def json_registry_round_trip(spark, sf_dir):
    """Sightings appended as JSON lines by UTC date and read back from a date on."""
    root = _scratch(spark)
    s = market.sightings(spark, sf_dir).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    landing.append_json_rows(s.drop("event_id"), root, "observed_at")
    rows = landing.read_json_rows(spark, root, since="2024-01-10")
    return rows.groupBy("dt").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("pool").alias("pools"), F.sum("price").alias("price"))


@query("csv_bars_round_trip", "A6", over("walk_1d", """
SELECT count(*) - count(DISTINCT (symbol, day)) AS repeated, count(*) FILTER (WHERE close IS NULL OR least(open, high, low, close) <= 0) AS bad_price, count(*) FILTER (WHERE low > least(open, close) OR high < greatest(open, close)) AS incoherent,
 count(*) FILTER (WHERE volume < 0) AS bad_volume, count(*) AS rows, R6(sum(close)) AS close FROM walk_1d"""))
def csv_bars_round_trip(spark, sf_dir):
    """All bars through CSV, a folder a symbol, with a stray column; faults counted."""
    root = _scratch(spark)
    market.walk_1d(spark, sf_dir).select(
        "symbol", F.col("day").alias("Date"), "open", "high", "low", "close", "volume", F.lit("x").alias("note")
    ).write.partitionBy("symbol").option("header", True).csv(root)
    bars = landing.read_csv_bars(spark, root)
    rows, close = bars.agg(F.count(F.lit(1))), bars.agg(F.sum("close"))
    return landing.csv_faults(bars).withColumns({"rows": rows.scalar(), "close": close.scalar()})


def horizontal_mean(*cols: str) -> Column:
    """Mean over columns, nulls skipped."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.try_divide(total, sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0)))


@query("horizontal_stats", "S3 B7 J3", over("walk_1d", """
SELECT CAST(day AS VARCHAR) AS day, R6(list_reduce(list(close ORDER BY symbol), lambda a, b: a + b) / count(*)) AS mean, R6(min(close)) AS low, R6(max(close)) AS high FROM walk_1d GROUP BY day"""))
def horizontal_stats(spark, sf_dir):
    """Mean, least and greatest over the columns of a wide close matrix."""
    bars = market.walk_1d(spark, sf_dir)
    names = sorted(r[0] for r in bars.select("symbol").distinct().collect())  # the columns of the matrix
    w = wide(bars, "close", names)
    return w.select("day", horizontal_mean(*names).alias("mean"), F.least(*names).alias("low"), F.greatest(*names).alias("high"))


@query("feature_panel", "F1 F2 F3 F4 F5 F6 F7 F8 F9 F10 F11 F12 F13 F14 F15 F16 F33 S1", over("walk_1d", f"""
WITH a AS (SELECT symbol, day, close, open, volume, close / lag(close) OVER w - 1 AS ret, close / lag(close, 30) OVER w - 1 AS r30, lag(close, 7) OVER w / lag(close, 30) OVER w - 1 AS r30skip7, lead(close, 7) OVER w / close - 1 AS fwd7,
  (lead(close, 7) OVER w / close) / (lead(open, 7) OVER w / open) - 1 AS rel_ratio, (lead(close, 7) OVER w / close - 1) - (lead(open, 7) OVER w / open - 1) AS rel_diff,
  greatest(high - low, abs(high - coalesce(lag(close) OVER w, high)), abs(low - coalesce(lag(close) OVER w, low))) AS tr FROM walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 b AS (SELECT *, {rolling('stddev_samp', 'ret', 20, -1)} AS vol_before, {rolling('stddev_samp', 'ret', 20)} AS vol_through, {rolling('avg', 'close', 20)} AS ma20, {rolling('max', 'close', 60)} AS hi60, {rolling('max', 'ret', 20)} AS maxret,
  {rolling('avg', 'tr', 14)} AS atr14, {rolling('avg', 'abs(ret) / (close * volume)', 20)} AS illiq, volume / {rolling('avg', 'volume', 20)} AS vshock, {rolling('avg', 'CASE WHEN ret > 0 THEN 1.0 WHEN ret <= 0 THEN 0.0 END', 20)} AS up FROM a)
SELECT symbol, CAST(day AS VARCHAR) AS day, R6(ret) AS ret, R6(r30) AS r30, R6(r30skip7) AS r30skip7, R6(fwd7) AS fwd7, R6(rel_ratio) AS rel_ratio, R6(rel_diff) AS rel_diff, R6(tr) AS tr, R6(vol_before) AS vol_before, R6(vol_through) AS vol_through,
 R6(ma20 / close) AS ma20, R6(hi60) AS hi60, R6(maxret) AS maxret, R6(atr14 / close) AS atr14, R6(illiq * 1000000000) AS illiq, R6(vshock) AS vshock, R6(up) AS up, R6(close / hi60) AS hi_ratio FROM b WHERE r30 IS NOT NULL"""))
def feature_panel(spark, sf_dir):
    """Every plain feature side by side, in two stages."""
    p = X.panel(
        market.walk_1d(spark, sf_dir),
        [
            [
                X.momentum(30), X.momentum(30, skip=7), X.forward_return(7), X.relative_forward_ratio(7, "close", "open", "rel_ratio"),
                X.relative_forward_difference(7, "close", "open", "rel_diff"), X.true_range(), X.vol_before(20, "vol_before"), X.vol_through(20, "vol_through"),
                X.rolling_mean("close", 20, "ma20"), X.rolling_max("close", 60, "hi60"), X.rolling_max("ret", 20, "maxret"),
                X.illiquidity(20, "illiq"), X.volume_shock(20, "vshock"), X.up_share(20, "up"),
            ],
            [X.rolling_mean("tr", 14, "atr14"), X.ratio("close", "hi60", "hi_ratio")],
        ],
        base=("symbol", "day", "open", "high", "low", "close", "volume", "ret"), drop_nulls=["r30"],
    )
    close = F.col("close")
    return p.withColumns({"illiq": F.col("illiq") * 1e9, "ma20": F.col("ma20") / close, "atr14": F.col("atr14") / close}).drop("open", "high", "low", "close", "volume")
