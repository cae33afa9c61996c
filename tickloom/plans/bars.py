"""Bars, lake and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import features as X
from tickloom.operators import bars as B
from tickloom.operators import quality as Q
from tickloom.plans.oracle import over
from tickloom.registry import query
from tickloom.session import shared
from tickloom.sources import landing, lake, market

SYMBOLS = ["AF", "AO", "NF", "NO", "RF", "RO"]


@query("bars_range_scan", "A1 K1", over("bars_1d", """
SELECT symbol, CAST(day AS VARCHAR) AS day, R6(open) AS open, R6(high) AS high, R6(low) AS low, R6(close) AS close, R6(volume) AS volume
FROM bars_1d WHERE day >= DATE '1996-01-01' AND day < DATE '1997-01-01'"""))
def bars_range_scan(spark, sf_dir):
    """Half-open range read; the bound reaches the parquet scan through the ship date."""
    bars = market.bars_1d(spark, sf_dir, "day >= date'1996-01-01' and day < date'1997-01-01'")
    return bars.select("symbol", "day", "open", "high", "low", "close", "volume")


@query("bars_upsert", "A2 G13 K8", over("bars_1d perp_1d", """
WITH u AS (SELECT symbol, day, close, volume, 0 AS batch FROM bars_1d
  UNION ALL SELECT symbol, day, perp_close AS close, 0.0 AS volume, 1 AS batch FROM perp_1d WHERE day >= DATE '2000-01-01')
SELECT symbol, CAST(day AS VARCHAR) AS day, R6(close) AS close, R6(volume) AS volume
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY batch DESC) AS rn FROM u) x WHERE rn = 1"""))
def bars_upsert(spark, sf_dir):
    """Merge a revised batch into daily bars: new rows win, old rows stay."""
    old = market.bars_1d(spark, sf_dir).select("symbol", "day", "close", "volume")
    new = market.spot_perp_1d(spark, sf_dir).where("day >= date'2000-01-01'").select(
        "symbol", "day", F.col("perp_close").alias("close"), F.lit(0.0).alias("volume")
    )
    return lake.upsert(old, new, ["symbol", "day"])


@query("bars_from_epochs", "A5", over("bars_1h", """
SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", R6(open) AS open, R6(high) AS high, R6(low) AS low, R6(close) AS close, R6(volume) AS volume FROM bars_1h"""))
def bars_from_epochs(spark, sf_dir):
    """Rows of epoch milliseconds and text prices, as a venue sends them, to typed bars."""
    sent = market.bars_1h(spark, sf_dir).select(
        "symbol", F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("epoch_ms"),
        *(F.col(name).cast("string").alias(name[0]) for name in ("open", "high", "low", "close", "volume")),
    )
    return lake.bars_from_rows(sent, keep=["symbol"])


@query("bars_resample_6h", "B1 B2", over("bars_1h", """
SELECT symbol, strftime(b, '%Y-%m-%d %H:%M:%S') AS ts, R6(open) AS open, R6(high) AS high, R6(low) AS low, R6(close) AS close, R6(volume) AS volume FROM
 (SELECT symbol, date_trunc('day', ts) + INTERVAL 6 HOUR * CAST(floor(hour(ts) / 6) AS INTEGER) AS b, min_by(open, ts) AS open, max(high) AS high,
  min(low) AS low, max_by(close, ts) AS close, sum(volume) AS volume, count(*) AS n FROM bars_1h GROUP BY 1, 2) x WHERE n = 6"""))
def bars_resample_6h(spark, sf_dir):
    return B.resample(market.bars_1h(spark, sf_dir), "1h", "6h")


_INDEX_SQL = """
WITH cal AS (SELECT day, row_number() OVER (ORDER BY day) AS o FROM (SELECT DISTINCT day FROM walk_1d) d),
 p AS (SELECT w.symbol, w.day, w.close, c.o FROM walk_1d w JOIN cal c ON w.day = c.day),
 r AS (SELECT a.symbol, a.day, a.close / b.close - 1 AS ret FROM p a LEFT JOIN p b ON a.symbol = b.symbol AND a.o = b.o + 1),
 d AS (SELECT day, avg(ret) AS ret, count(ret) AS n FROM r GROUP BY day),
 idx AS (SELECT day, ret, n, 100.0 * exp(sum(ln(1 + coalesce(ret, 0))) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)) AS level FROM d)"""


@query("index_chained", "B3 J3 S6", over("walk_1d", _INDEX_SQL + """
SELECT CAST(day AS VARCHAR) AS day, n, R6(ret) AS ret, R6(level) AS level FROM idx"""))
def index_chained(spark, sf_dir):
    return B.chained_index(market.walk_1d(spark, sf_dir))


@query("index_dominance", "B4", over("walk_1d", _INDEX_SQL + """
SELECT CAST(w.day AS VARCHAR) AS day, R6(w.close / i.level) AS dominance FROM walk_1d w JOIN idx i ON w.day = i.day WHERE w.symbol = 'AF'"""))
def index_dominance(spark, sf_dir):
    bars = market.walk_1d(spark, sf_dir)
    return B.dominance(bars, B.chained_index(bars), "AF")


@query("basket_return", "B5", over("walk_1d", """
WITH r AS (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM walk_1d)
SELECT CAST(day AS VARCHAR) AS day, R6(avg(ret)) AS basket FROM r WHERE symbol <> 'AF' GROUP BY day"""))
def basket_return(spark, sf_dir):
    return B.basket_return(X.panel(market.walk_1d(spark, sf_dir), [], base=("symbol", "day", "ret")), "AF")


@query("stream_end_of_day", "B6", over("bars_1h", """
WITH d AS (SELECT symbol, CAST(ts AS DATE) AS day, max_by(close, ts) AS close FROM bars_1h GROUP BY 1, 2)
SELECT symbol, CAST(day AS VARCHAR) AS day, R6(close) AS close, R6(close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1) AS ret FROM d"""))
def stream_end_of_day(spark, sf_dir):
    return B.end_of_day(market.bars_1h(spark, sf_dir), "close")


@query("wide_closes", "B7 J3", over("walk_1d", "SELECT CAST(day AS VARCHAR) AS day, " + ", ".join(
    f"R6(max(CASE WHEN symbol = '{s}' THEN close END)) AS {s}" for s in SYMBOLS) + " FROM walk_1d GROUP BY day"))
def wide_closes(spark, sf_dir):
    bars = market.walk_1d(spark, sf_dir)
    names = sorted(r[0] for r in bars.select("symbol").distinct().collect())  # the columns of the matrix
    return B.wide(bars, "close", names)


@query("funding_daily", "B8", over("funding", """
SELECT symbol, CAST(day AS VARCHAR) AS day, R6(1000 * sum(rate)) AS funding_permille, count(*) AS stamps FROM funding GROUP BY symbol, day"""))
def funding_daily(spark, sf_dir):
    return B.funding_by_day(market.funding(spark, sf_dir)).select(
        "symbol", "day", (F.col("funding") * 1000).alias("funding_permille"), "stamps"
    )


@query("calendar_flag_counts", "B9 S4", over("bars_1d", """
SELECT symbol, (day(day) <= 2 OR day(day) >= day(last_day(day)) - 1) AS turn_of_month, isodow(day) >= 6 AS weekend, count(*) AS bars
FROM bars_1d GROUP BY 1, 2, 3"""))
def calendar_flag_counts(spark, sf_dir):
    days = market.ticks(spark, sf_dir).select("symbol", "day").distinct()
    return B.calendar_flags(days).groupBy("symbol", "turn_of_month", "weekend").agg(F.count(F.lit(1)).alias("bars"))


@query("intraday_sessions", "A4 B9", over("bars_1h", """
SELECT symbol, CAST(hour(ts) AS INTEGER) // 8 AS session, hour(ts) AS hh, minute(ts) AS mm, count(*) AS bars, R6(sum(volume)) AS volume
FROM bars_1h GROUP BY 1, 2, 3, 4"""))
def intraday_sessions(spark, sf_dir):
    return B.intraday(market.bars_1h(spark, sf_dir)).groupBy("symbol", "session", "hh", "mm").agg(
        F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume")
    )


def raw_rows(spark, sf_dir):
    """Trades as raw bar rows with the faults real feeds show, and their ingest order."""
    t = market.table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return t.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("ts"),
        price.alias("open"),
        (price * (1 + F.col("l_tax") - 0.02)).alias("high"),
        (price * (1 - F.col("l_discount"))).alias("low"),
        F.when((F.col("l_tax") != 0) | (F.col("l_discount") != 0), price * (1 - F.col("l_discount") / 2)).alias("close"),
        (F.col("l_quantity") - 1).alias("volume"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("seq"),
        F.floor(F.col("l_orderkey") / 4096).alias("bucket"),
    )


_RAW_SQL = """
WITH raw AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS ts, p AS open, p * (1 + l_tax - 0.02) AS high, p * (1 - l_discount) AS low,
  CASE WHEN l_tax <> 0 OR l_discount <> 0 THEN p * (1 - l_discount / 2) END AS close, l_quantity - 1 AS volume,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seq
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) z),
 st AS (SELECT symbol, ts, count(*) AS n, count(*) FILTER (WHERE close IS NULL) AS nn,
  count(*) FILTER (WHERE low > least(open, close) OR high < greatest(open, close) OR least(open, high, low, close) <= 0 OR volume < 0) AS nb,
  count(*) FILTER (WHERE volume = 0) AS nz, arg_max_null(close, seq) AS close FROM raw GROUP BY symbol, ts),
 g AS (SELECT *, greatest(date_diff('day', lag(ts) OVER w, ts) - 1, 0) AS hole, close / lag(close) OVER w - 1 AS ret FROM st WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 m AS (SELECT symbol, median(ret) AS med FROM g GROUP BY symbol),
 dv AS (SELECT g.*, abs(ret - med) AS dev FROM g JOIN m ON g.symbol = m.symbol),
 md AS (SELECT symbol, median(dev) AS mad FROM dv GROUP BY symbol),
 o AS (SELECT dv.*, coalesce(mad > 0 AND 0.6745 * dev > 10 * mad, FALSE) AS outl FROM dv JOIN md ON dv.symbol = md.symbol),
 flags AS (SELECT symbol, ts, 'nulls' AS "check", 'error' AS severity, nn AS c, 0 AS miss FROM o WHERE nn > 0
  UNION ALL SELECT symbol, ts, 'duplicates', 'error', n, 0 FROM o WHERE n > 1
  UNION ALL SELECT symbol, ts, 'incoherent', 'error', nb, 0 FROM o WHERE nb > 0
  UNION ALL SELECT symbol, ts, 'gaps', 'warning', 1, hole FROM o WHERE hole > 0
  UNION ALL SELECT symbol, ts, 'zero_volume', 'warning', nz, 0 FROM o WHERE nz > 0
  UNION ALL SELECT symbol, ts, 'outliers', 'warning', 1, 0 FROM o WHERE outl),
 uns AS (SELECT symbol, count(*) AS c FROM (SELECT symbol, ts < lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS u FROM raw) x WHERE u GROUP BY symbol),
 found AS (SELECT symbol, "check", severity, CAST(sum(c) AS BIGINT) AS "count", CAST(sum(miss) AS BIGINT) AS missing,
   array_to_string(list_transform(list_sort(list(ts))[1:5], lambda d: CAST(d AS VARCHAR)), ',') AS examples FROM flags GROUP BY 1, 2, 3
  UNION ALL SELECT symbol, 'unsorted', 'error', c, 0, '' FROM uns)"""
# A later null close must win over an earlier number: keep the row, not the last non-null.
_RAW_SQL = _RAW_SQL.replace("arg_max_null(close, seq)", "max_by({'c': close}, seq).c")


def _found(spark, sf_dir, stamps=None):
    raw = raw_rows(spark, sf_dir)
    stamps = Q.by_stamp(raw, "seq") if stamps is None else stamps
    return Q.findings(stamps, 86_400, Q.unsorted_rows(raw, F.col("seq"), F.col("bucket")))


@query("quality_findings", "Q3 Q4 Q5 Q6 Q7 Q8 Q9 T6", over("ticks_1d", _RAW_SQL + """
SELECT symbol, "check", severity, "count", missing, examples FROM found"""))
def quality_findings(spark, sf_dir):
    """Every quality finding over the raw rows."""
    found = _found(spark, sf_dir)
    return found.withColumn("examples", F.array_join(F.transform("examples", lambda d: d.cast("string")), ","))


@query("quality_report", "Q12", over("ticks_1d", _RAW_SQL + """
SELECT symbol, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings,
 count(*) FILTER (WHERE severity = 'error') = 0 AS storable FROM found GROUP BY symbol"""))
def quality_report(spark, sf_dir):
    return Q.report(_found(spark, sf_dir))


@query("quality_sets", "Q1 Q2", """
WITH k AS (SELECT concat('C', c_custkey) AS symbol FROM customer),
 gone AS (SELECT symbol FROM k WHERE symbol NOT IN (SELECT concat('C', o_custkey) FROM orders WHERE o_totalprice > 400000))
SELECT 'whole' AS "set", symbol, 'empty' AS "check", 'error' AS severity, 'no rows' AS detail, CAST(1 AS BIGINT) AS "count" FROM gone
UNION ALL SELECT 'drifted', symbol, 'schema', 'error', unnest(['missing open', 'extra opened', 'retyped close']), CAST(1 AS BIGINT) FROM k""")
def quality_sets(spark, sf_dir):
    """One series of large orders a customer: those without one are empty; a copy with other columns has drifted."""
    orders, customers = (market.table(spark, sf_dir, n) for n in ("orders", "customer"))
    rows = orders.where("o_totalprice > 400000").select(F.concat(F.lit("C"), "o_custkey").alias("symbol"), F.col("o_orderdate").alias("open"), F.col("o_totalprice").cast("double").alias("close"))
    drifted = rows.select("symbol", F.col("open").alias("opened"), F.col("close").cast("string").alias("close"))
    expected = customers.select(F.concat(F.lit("C"), "c_custkey").alias("symbol"))
    whole = Q.set_findings(rows, rows.schema, expected).withColumn("set", F.lit("whole"))
    return whole.unionByName(Q.set_findings(drifted, rows.schema, expected).withColumn("set", F.lit("drifted")))


@query("quality_coverage", "Q10 A11", over("bars_1d", """
SELECT symbol, count(*) AS rows, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last,
 R6(count(*) * 100.0 / (date_diff('day', min(day), max(day)) + 1)) AS complete_pct,
 greatest(date_diff('day', DATE '1995-01-01', min(day)), 0) AS late_start, greatest(date_diff('day', max(day), DATE '2002-12-31'), 0) AS early_end
FROM bars_1d GROUP BY symbol"""))
def quality_coverage(spark, sf_dir):
    return Q.coverage(market.ticks(spark, sf_dir).select("symbol", "day").distinct(), "1995-01-01", "2002-12-31")


@query("lake_catalog", "A10 A13 G13", over("ticks_1d", _RAW_SQL + """,
 spans AS (SELECT symbol, count(*) AS rows, min(ts) AS s, max(ts) AS e FROM raw GROUP BY symbol)
SELECT sp.symbol, '1d' AS "interval", sp.rows, CAST(sp.s AS VARCHAR) AS start, CAST(sp.e AS VARCHAR) AS "end",
 (SELECT count(*) FROM found f WHERE f.symbol = sp.symbol AND f.severity = 'error') AS errors,
 (SELECT count(*) FROM found f WHERE f.symbol = sp.symbol AND f.severity = 'warning') AS warnings,
 R6(date_diff('day', sp.e, DATE '2003-01-01')) AS stale_days FROM spans sp"""))
def lake_catalog(spark, sf_dir):
    """One row per symbol and interval: rows, span, findings, staleness."""
    stamps = shared(Q.by_stamp(raw_rows(spark, sf_dir), "seq"))
    days = stamps.withColumns({"timestamp": F.col("ts"), "interval": F.lit("1d")})
    cat = lake.catalog(days, Q.report(_found(spark, sf_dir, stamps)), F.sum("rows"))
    return cat.join(lake.staleness_days(days, "2003-01-01", "ts").select("symbol", "stale_days"), "symbol")


_CONTENT = ["open", "close", "volume"]
_DIGEST = """,
 tx AS (SELECT symbol, day, md5(concat_ws('|', strftime(day, '%Y-%m-%d'), CAST(floor(open * 1000000.0 + 0.5) AS BIGINT), CAST(floor(close * 1000000.0 + 0.5) AS BIGINT), CAST(floor(volume * 1000000.0 + 0.5) AS BIGINT))) AS h FROM now)
SELECT symbol, count(*) AS rows, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last,
 concat(CAST(sum(('0x' || substr(h, 1, 15))::BIGINT) AS VARCHAR), '-', CAST(sum(('0x' || substr(h, 16, 15))::BIGINT) AS VARCHAR)) AS digest FROM tx GROUP BY symbol"""


@query("series_manifest", "A12 M9", over("bars_1d", "WITH now AS (SELECT * FROM bars_1d)" + _DIGEST))
def series_manifest(spark, sf_dir):
    """Rows, span and an additive content digest per symbol, stable across rebuilds."""
    return Q.manifest(Q.manifest_parts(market.bars_1d(spark, sf_dir), ["symbol"], "day", _CONTENT), ["symbol"])


@query("manifest_after_upsert", "A12 M9 A2", over("bars_1d", """
WITH new AS (SELECT symbol, day, open, close * 1.01 AS close, volume FROM bars_1d WHERE day BETWEEN DATE '1999-03-01' AND DATE '1999-04-15' AND symbol >= 'N'),
 now AS (SELECT symbol, day, open, close, volume FROM bars_1d b WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.symbol = b.symbol AND n.day = b.day) UNION ALL SELECT * FROM new)""" + _DIGEST))
def manifest_after_upsert(spark, sf_dir):
    """The manifest after some bars were replaced: only the touched years are summed again."""
    cols = ["symbol", "day", *_CONTENT]
    before = market.bars_1d(spark, sf_dir).select(*cols)
    new = before.where("day between '1999-03-01' and '1999-04-15' and symbol >= 'N'").withColumn("close", F.col("close") * 1.01)
    parts = Q.manifest_parts(before, ["symbol"], "day", _CONTENT)
    after = Q.renewed(parts, lake.upsert(before, new, ["symbol", "day"]), new, ["symbol"], "day", _CONTENT)
    return Q.manifest(after, ["symbol"])


@query("panel_signature", "Q13", over("walk_1d", """
WITH f AS (SELECT symbol, day, close, close / lag(close) OVER w - 1 AS ret, close / lag(close, 30) OVER w - 1 AS r30, lead(close, 7) OVER w / close - 1 AS fwd7
  FROM walk_1d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 t AS (SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last,
  count(*) - count(ret) AS n1, count(*) - count(r30) AS n2, count(*) - count(fwd7) AS n3 FROM f)
SELECT rows, symbols, first, last, c AS "column", ty AS type, n AS nulls FROM t, LATERAL (VALUES ('symbol', 'string', 0), ('day', 'date', 0), ('close', 'double', 0),
 ('ret', 'double', n1), ('r30', 'double', n2), ('fwd7', 'double', n3)) v(c, ty, n)"""))
def panel_signature(spark, sf_dir):
    p = X.panel(market.walk_1d(spark, sf_dir), [[X.momentum(30), X.forward_return(7)]], base=("symbol", "day", "close", "ret"))
    return Q.signature(p)


@query("panel_diff", "Q14 A15", over("bars_1d perp_1d", """
WITH a AS (SELECT symbol, day, close, volume FROM bars_1d),
 b AS (SELECT p.symbol, p.day, p.perp_close AS close, r.volume + 1 AS volume FROM perp_1d p JOIN bars_1d r ON p.symbol = r.symbol AND p.day = r.day WHERE p.day < DATE '2000-01-01'),
 j AS (SELECT a.close AS ac, b.close AS bc, a.volume AS av, b.volume AS bv, a.day AS ad, b.day AS bd FROM a FULL JOIN b ON a.symbol = b.symbol AND a.day = b.day)
SELECT (SELECT count(*) FROM j WHERE bd IS NULL) AS only_a, (SELECT count(*) FROM j WHERE ad IS NULL) AS only_b, 'close' AS "column", R6(max(abs(ac - bc))) AS max_abs FROM j
UNION ALL SELECT (SELECT count(*) FROM j WHERE bd IS NULL), (SELECT count(*) FROM j WHERE ad IS NULL), 'volume', R6(max(abs(av - bv))) FROM j"""))
def panel_diff(spark, sf_dir):
    a = market.bars_1d(spark, sf_dir).select("symbol", "day", "close", "volume")
    p = market.spot_perp_1d(spark, sf_dir).select("symbol", "day", "perp_close")
    b = a.join(p, ["symbol", "day"]).where("day < date'2000-01-01'").select(
        "symbol", "day", F.col("perp_close").alias("close"), (F.col("volume") + 1).alias("volume")
    )
    return Q.panel_diff(a, b, ["symbol", "day"])


@query("lake_reconcile", "A15 Q11", over("bars_1d perp_1d", """
SELECT b.symbol, count(*) AS common, R6(max(abs(b.close - p.perp_close))) AS max_close FROM bars_1d b JOIN perp_1d p ON b.symbol = p.symbol AND b.day = p.day GROUP BY b.symbol"""))
def lake_reconcile(spark, sf_dir):
    a = market.bars_1d(spark, sf_dir).select("symbol", "day", "close")
    b = market.spot_perp_1d(spark, sf_dir).select("symbol", "day", F.col("perp_close").alias("close"))
    return lake.reconcile(a, b, ["symbol", "day"], ["close"])


@query("candidate_symbols", "A16 S7", """
WITH m AS (SELECT upper(replace(p_name, ' ', '')) || upper(substr(p_type, 1, 1)) || CASE p_size % 5 WHEN 0 THEN 'UP' WHEN 1 THEN '3L' ELSE 'X' END
  || CASE p_size % 4 WHEN 0 THEN 'USDT' WHEN 1 THEN 'BTC' WHEN 2 THEN 'FDUSD' ELSE 'GBP' END AS name FROM part),
 s AS (SELECT name, NULLIF(regexp_extract(name, '^(.+)(FDUSD|USDT|USDC|BUSD|TUSD|EUR|TRY|BTC|ETH|BNB)$', 1), '') AS base,
  NULLIF(regexp_extract(name, '^(.+)(FDUSD|USDT|USDC|BUSD|TUSD|EUR|TRY|BTC|ETH|BNB)$', 2), '') AS quote FROM m)
SELECT base, quote, count(*) AS listings FROM s WHERE base IS NOT NULL AND base NOT IN ('REDBOLTSX', 'BLUENUTPX') AND NOT regexp_matches(base, '(UP|DOWN|BULL|BEAR|3L|3S|5L|5S)$') GROUP BY 1, 2""")
def candidate_symbols(spark, sf_dir):
    """Split listing names at the quote suffix and drop stables and leveraged tokens."""
    size = F.col("p_size")
    name = F.concat(
        F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit(""))),
        F.upper(F.substring("p_type", 1, 1)),
        F.when(size % 5 == 0, "UP").when(size % 5 == 1, "3L").otherwise("X"),
        F.when(size % 4 == 0, "USDT").when(size % 4 == 1, "BTC").when(size % 4 == 2, "FDUSD").otherwise("GBP"),
    )
    base, quote = landing.base_and_quote(F.col("name"))
    split = market.table(spark, sf_dir, "part").select(name.alias("name")).select(base.alias("base"), quote.alias("quote"))
    kept = landing.tradable_candidates(split, ["REDBOLTSX", "BLUENUTPX"])
    return kept.groupBy("base", "quote").agg(F.count(F.lit(1)).alias("listings"))


@query("payload_rows", "A7 A8 S9", """
SELECT event_type, count(*) AS rows, count(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS numbers,
 R6(sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE))) AS total, count(json_extract_string(props, '$.none')) AS none FROM events GROUP BY event_type""")
def payload_rows(spark, sf_dir):
    """Typed fields out of JSON payloads, unusable values as null."""
    rows = landing.parse_payload(
        market.table(spark, sf_dir, "events").select("event_type", "props"), "props", {"k": "double", "none": "string"}
    )
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count("k").alias("numbers"), F.sum("k").alias("total"), F.count("none").alias("none")
    )


@query("venue_pool", "A14 J1", over("venue_1d peg_1d", """
SELECT v.venue, v.symbol, count(*) AS days, R6(avg(v.close / p.close)) AS avg_adj_close, R6(median(v.quote_volume)) AS median_quote
FROM venue_1d v JOIN peg_1d p ON v.day = p.day GROUP BY 1, 2"""))
def venue_pool(spark, sf_dir):
    """Venue closes on the peg: the multi-venue pool as one table."""
    v = market.venue_1d(spark, sf_dir).join(
        market.peg_1d(spark, sf_dir).withColumnRenamed("close", "peg"), "day"
    )
    return v.groupBy("venue", "symbol").agg(
        F.count(F.lit(1)).alias("days"),
        F.avg(F.col("close") / F.col("peg")).alias("avg_adj_close"),
        F.percentile("quote_volume", F.lit(0.5)).alias("median_quote"),
    )
