"""Streaming queries, run over the event files and checked against their batch meaning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.plans.oracle import over
from tickloom.registry import query
from tickloom.session import shared_folder
from tickloom.sources import market
from tickloom.streaming import streams as T

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark, sf_dir):
    e = T.events(spark, f"{sf_dir}/events*.parquet", EVENTS)
    return e.withColumns({"ts": F.col("ts").cast("timestamp"), "size": F.regexp_extract("props", "([0-9]+)", 1).cast("double")})


#: Days of events that arrive together, and arrivals that every 40th event is behind.
ARRIVAL_DAYS, BEHIND = 5, 2

_ARRIVALS = f"""
WITH RECURSIVE e AS (SELECT concat('U', user_id) AS pool, ts, event_id, date_diff('day', (SELECT min(ts) FROM events)::DATE, ts::DATE) // {ARRIVAL_DAYS} + CASE WHEN event_id % 40 = 0 THEN {BEHIND} ELSE 0 END AS arrival FROM events),
 bn AS (SELECT arrival, row_number() OVER (ORDER BY arrival) - 1 AS b, max(ts) AS seen FROM e GROUP BY arrival),
 ck AS (SELECT arrival, b, max(seen) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM bn),
 k AS (SELECT e.*, b, clock IS NOT NULL AND ts < clock - INTERVAL 3 DAY AS late FROM e JOIN ck ON e.arrival = ck.arrival),
 c AS (SELECT b, pool, min({{'t': ts, 'e': event_id}}) AS f FROM k WHERE NOT late GROUP BY b, pool),
 st(b, pool, last, got, id) AS (SELECT CAST(-1 AS BIGINT), pool, NULL::TIMESTAMP, NULL::TIMESTAMP, NULL::BIGINT FROM (SELECT DISTINCT pool FROM e)
  UNION ALL SELECT s.b + 1, s.pool, CASE WHEN f IS NOT NULL AND (s.last IS NULL OR s.last <= f.t - INTERVAL 3 DAY) THEN f.t ELSE s.last END,
   CASE WHEN f IS NOT NULL AND (s.last IS NULL OR s.last <= f.t - INTERVAL 3 DAY) THEN f.t END, CASE WHEN f IS NOT NULL AND (s.last IS NULL OR s.last <= f.t - INTERVAL 3 DAY) THEN f.e END
  FROM st s LEFT JOIN c ON c.b = s.b + 1 AND c.pool = s.pool WHERE s.b < (SELECT max(b) FROM bn))"""


def _registered(spark, sf_dir):
    """The registry after all arrivals, one batch each; the third batch is handed over twice."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    e = market.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    start = F.to_date(e.agg(F.min("ts")).scalar())
    arrival = F.floor(F.datediff("ts", start) / ARRIVAL_DAYS).cast("int") + F.when(F.col("event_id") % 40 == 0, BEHIND).otherwise(0)
    e = e.withColumn("arrival", arrival)
    write = T.replayed(T.register_batches(f"{root}/out"), 2)
    # The stream stops when it has read what is there and goes on from its state when more has come.
    for at in sorted(r[0] for r in e.select("arrival").distinct().collect()):
        e.where(F.col("arrival") == at).drop("arrival").write.parquet(f"{root}/in/{at:04d}")
        stream = T.events(spark, f"{root}/in/*", "event_id bigint, user_id bigint, ts timestamp")
        stream = stream.select(F.concat(F.lit("U"), "user_id").alias("pool"), F.col("ts").alias("observed_at"), "event_id")
        T.settle_batches(stream, write, f"{root}/state")
    return f"{root}/out"


@query("stream_first_sightings", "T1 T7", over("sightings", _ARRIVALS + """
SELECT pool, strftime(got, '%Y-%m-%d %H:%M:%S') AS observed_at, id AS event_id, CAST(b AS INTEGER) AS batch FROM st WHERE got IS NOT NULL"""))
def stream_first_sightings(spark, sf_dir):
    """What every batch registered: the kept stamp and event of each pool."""
    out = spark.read.schema("pool string, observed_at timestamp, event_id bigint, batch int").parquet(f"{_registered(spark, sf_dir)}/registry")
    return out.select("pool", "observed_at", "event_id", "batch")


@query("stream_late_rows", "T7", over("sightings", _ARRIVALS + """
SELECT CAST(b AS INTEGER) AS batch, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS seen, count(*) FILTER (late) AS late FROM k GROUP BY b"""))
def stream_late_rows(spark, sf_dir):
    """Latest time and late rows of every batch."""
    return spark.read.schema("seen timestamp, late bigint, batch int").parquet(f"{_registered(spark, sf_dir)}/clock").select("batch", "seen", "late")


@query("stream_resample_6h", "T4 B2", over("bars_1h", """
WITH r AS (SELECT symbol, date_trunc('day', ts) + INTERVAL 6 HOUR * CAST(floor(hour(ts) / 6) AS INTEGER) AS b, min_by(open, ts) AS open, max(high) AS high, min(low) AS low, max_by(close, ts) AS close, sum(volume) AS volume, count(*) AS n FROM bars_1h GROUP BY 1, 2)
SELECT symbol, strftime(b, '%Y-%m-%d %H:%M:%S') AS ts, R6(open) AS open, R6(high) AS high, R6(low) AS low, R6(close) AS close, R6(volume) AS volume FROM r WHERE n = 6 AND b + INTERVAL 6 HOUR <= (SELECT max(ts) FROM bars_1h) - INTERVAL 1 HOUR"""))
def stream_resample_6h(spark, sf_dir):
    """Hourly bars, written once to the shared folder, streamed into complete six-hour bars."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}/bars"
    market.bars_1h(spark, sf_dir).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume").write.parquet(root)
    bars = T.events(spark, root, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    return T.settle(T.resample(bars, "1h", "6h"))


@query("stream_sliding_activity", "T8 T7", """
WITH e AS (SELECT event_type AS symbol, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS size FROM events),
 w AS (SELECT symbol, date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS s, size FROM e, (SELECT unnest(range(4)) AS k) q)
SELECT symbol, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n, R6(sum(size)) AS volume FROM w WHERE s + INTERVAL 4 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 2 HOUR GROUP BY symbol, s""")
def stream_sliding_activity(spark, sf_dir):
    e = event_stream(spark, sf_dir).withColumnRenamed("event_type", "symbol")
    return T.settle(T.sliding_activity(e, "4 hours", "1 hour", "2 hours"))


@query("stream_sessions", "T8 F30", """
WITH e AS (SELECT concat('U', user_id) AS pool, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 g AS (SELECT *, sum(nw) OVER (PARTITION BY pool ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT pool, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM g GROUP BY pool, k HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, sf_dir):
    e = event_stream(spark, sf_dir).withColumn("pool", F.concat(F.lit("U"), "user_id"))
    return T.settle(T.sessions(e, "2 hours", "1 hour"))


@query("stream_equity_guard", "T5", """
WITH e AS (SELECT event_type AS account, ts, event_id, 1000 + value AS equity FROM events),
 h AS (SELECT account, date_trunc('hour', ts) AS ts, max_by(equity, event_id) AS equity FROM e GROUP BY 1, 2),
 d AS (SELECT *, first_value(equity) OVER (PARTITION BY account, CAST(ts AS DATE) ORDER BY ts) AS day_start FROM h)
SELECT account, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, R6(equity) AS equity, R6(day_start) AS day_start, max(CASE WHEN equity <= day_start * (1 - CAST(0.005 AS DOUBLE)) THEN 1 ELSE 0 END) OVER (PARTITION BY account, CAST(ts AS DATE) ORDER BY ts) = 1 AS tripped,
 max(CASE WHEN equity <= 1000.05 THEN 1 ELSE 0 END) OVER (PARTITION BY account ORDER BY ts) = 1 AS killed FROM d""")
def stream_equity_guard(spark, sf_dir):
    """Stateful guard over hourly account marks streamed from the shared folder."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}/marks"
    e = market.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("account"), F.date_trunc("hour", "ts").alias("ts")).agg(
        F.max_by(1000 + F.col("value"), "event_id").alias("equity")
    )
    e.write.parquet(root)
    marks = T.events(spark, root, "account string, ts timestamp, equity double")
    return T.settle(T.equity_guard(marks, daily_limit=0.005, floor=1000.05))


@query("stream_quality_gate", "T6 Q12", """
WITH t AS (SELECT l_returnflag || l_linestatus AS symbol, l_extendedprice / l_quantity AS p, l_tax, l_discount, l_quantity, CAST(l_shipdate AS DATE) AS ts, l_linenumber FROM lineitem),
 g AS (SELECT symbol || l_linenumber AS symbol, ts, count(*) AS n FROM t GROUP BY 1, 2), bad AS (SELECT DISTINCT symbol FROM g WHERE n > 1)
SELECT symbol || l_linenumber AS symbol, count(*) AS rows, (symbol || l_linenumber) IN (SELECT symbol FROM bad) AS quarantined FROM t GROUP BY 1""")
def stream_quality_gate(spark, sf_dir):
    """Rows per symbol that reached the lake or the quarantine; repeated stamps are the error here."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    price = F.col("l_extendedprice") / F.col("l_quantity")
    s = T.events(spark, f"{sf_dir}/lineitem*.parquet", schema).select(
        F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("symbol"), F.col("l_shipdate").cast("date").alias("ts"),
        price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"), F.col("l_quantity").alias("volume"),
        F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
    )
    T.settle_batches(s, T.gate(f"{root}/good", f"{root}/bad", 86_400))
    row = "symbol string"
    good = spark.read.schema(row).parquet(f"{root}/good/*").withColumn("quarantined", F.lit(False))
    bad = spark.read.schema(row).parquet(f"{root}/bad/*/rows").withColumn("quarantined", F.lit(True))
    return good.unionByName(bad).groupBy("symbol", "quarantined").agg(F.count(F.lit(1)).alias("rows"))


@query("stream_panel_pass", "T2", over("sightings", """
WITH f AS (SELECT DISTINCT pool FROM sightings), lt AS (SELECT pool, max_by({'p': price, 'a': alive}, observed_at) AS s FROM sightings GROUP BY pool)
SELECT u.pool, R6(s.p) AS price, coalesce(s.a, FALSE) AS alive FROM (SELECT pool FROM f UNION SELECT 'G' || s_suppkey FROM supplier) u LEFT JOIN lt ON u.pool = lt.pool"""))
def stream_panel_pass(spark, sf_dir):
    """One pass over a tracked cohort: the newest state of every pool, dead ones too; pools without one are written as gone."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}/panel"
    cohort = market.sightings(spark, sf_dir).select("pool").unionByName(
        market.table(spark, sf_dir, "supplier").select(F.concat(F.lit("G"), F.col("s_suppkey")).alias("pool"))
    ).distinct()
    s = event_stream(spark, sf_dir).select(
        F.concat(F.lit("U"), "user_id").alias("pool"), F.col("ts").alias("observed_at"), F.col("value").alias("price"),
        (100 * F.col("size")).alias("liquidity"), (F.col("event_type") != "error").alias("alive"),
    )
    T.settle_batches(s, T.append_panel(cohort, root, lambda batch: "2024-02-01"))
    return spark.read.parquet(f"{root}/pass=*").select("pool", "price", "alive")


@query("stream_bar_upsert", "T3 A2", over("bars_1h", """
SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, R6(close) AS close, R6(volume) AS volume FROM bars_1h WHERE ts < TIMESTAMP '2024-01-20'"""))
def stream_bar_upsert(spark, sf_dir):
    """Hourly bars merged into a lake, stopping at the last complete bar of the stated time."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    market.bars_1h(spark, sf_dir).select("symbol", F.col("ts").cast("timestamp").alias("timestamp"), "open", "high", "low", "close", "volume").write.parquet(f"{root}/in")
    s = T.events(spark, f"{root}/in", "symbol string, timestamp timestamp, open double, high double, low double, close double, volume double")
    T.settle_batches(s, T.upsert_bars(f"{root}/lake", "1h", lambda batch: "2024-01-20 00:30:00"))
    from tickloom.sources import lake

    out = spark.read.schema(lake.LAKE_SCHEMA).parquet(f"{root}/lake").where("timestamp < timestamp'2024-01-20'")
    return out.select("symbol", "timestamp", "close", "volume")
