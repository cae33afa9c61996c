"""SQL text for the cross-check: the driver tables recast as market data, as CTEs."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ticks_1d": ((), """
SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS day, l_returnflag AS venue,
 l_suppkey, l_linenumber, l_discount, l_tax, l_quantity AS qty, l_extendedprice AS notional, l_extendedprice / l_quantity AS price,
 row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq
FROM lineitem"""),
    "bars_1d": (("ticks_1d",), """
SELECT symbol, day, min_by(price, seq) AS open, max(price) AS high, min(price) AS low, max_by(price, seq) AS close,
 sum(qty) AS volume, sum(notional) AS quote_volume FROM ticks_1d GROUP BY symbol, day"""),
    "bars_1h": ((), """
SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, min_by(value, event_id) AS open, max(value) AS high, min(value) AS low,
 max_by(value, event_id) AS close, sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)) AS volume,
 sum(CASE WHEN user_id % 2 = 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) ELSE 0.0 END) AS taker_buy
FROM events GROUP BY event_type, date_trunc('hour', ts)"""),
    "bars_wk": (("ticks_1d",), """
SELECT symbol, CAST(date_trunc('week', day) AS DATE) AS day, min_by(price, seq) AS open, max(price) AS high, min(price) AS low, max_by(price, seq) AS close,
 sum(qty) AS volume, sum(notional) AS quote_volume FROM (SELECT concat('P', l_suppkey * 7 % 40) AS symbol, day, price, qty, notional, seq FROM ticks_1d) x
GROUP BY symbol, CAST(date_trunc('week', day) AS DATE)"""),
    "funding": (("ticks_1d",), """
SELECT symbol, day, l_linenumber % 3 AS slot, (avg(l_discount) - 0.05) / 100 AS rate FROM ticks_1d GROUP BY symbol, day, l_linenumber % 3"""),
    "perp_1d": (("ticks_1d", "bars_1d"), """
SELECT b.symbol, b.day, b.close * (1 + (t.tax - 0.04) / 10) AS perp_close FROM bars_1d b
 JOIN (SELECT symbol, day, avg(l_tax) AS tax FROM ticks_1d GROUP BY symbol, day) t ON b.symbol = t.symbol AND b.day = t.day"""),
    "venue_1d": (("ticks_1d",), """
SELECT venue, concat('S', l_suppkey % 4) AS symbol, day, max_by(price, seq) AS close, sum(notional) AS quote_volume
FROM ticks_1d GROUP BY venue, concat('S', l_suppkey % 4), day"""),
    "peg_1d": (("ticks_1d",), """
SELECT day, 1 + (avg(l_tax) - 0.04) / 100 AS close FROM ticks_1d GROUP BY day"""),
    "sightings": ((), """
SELECT concat('U', user_id) AS pool, ts AS observed_at, value AS price, 100.0 * CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS liquidity,
 event_type <> 'error' AS alive, event_id FROM events"""),
    "trials": ((), """
SELECT p_partkey AS trial_id, concat('H', p_partkey) AS hypothesis, concat(CASE WHEN p_size % 2 = 0 THEN 'info.' ELSE 'strategy.' END, lower(p_type)) AS family,
 CASE p_size % 6 WHEN 0 THEN 'killed' WHEN 1 THEN 'noise' WHEN 2 THEN 'signal' WHEN 3 THEN 'rejected' WHEN 4 THEN 'candidate' ELSE 'inconclusive' END AS verdict,
 p_retailprice / 10000 AS p_value, p_name AS evidence FROM part"""),
    "edges": ((), """
SELECT DISTINCT concat('N', a.l_suppkey) AS src, concat('N', b.l_suppkey) AS dst FROM lineitem a JOIN lineitem b
 ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey AND abs(a.l_linenumber - b.l_linenumber) = 1"""),
}

_WALK = """
SELECT symbol, day, open, round(greatest(open, close) * (1 + rng), 6) AS high, round(least(open, close) * (1 - rng), 6) AS low, close,
 volume, volume * close AS quote_volume FROM
 (SELECT symbol, day, rng, volume, round(100 * exp(lv - 0.7 * r), 6) AS open, round(100 * exp(lv), 6) AS close FROM
  (SELECT symbol, day, r, rng, volume, sum(r) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS lv FROM
   (SELECT symbol, day, avg(l_discount) - 0.05 AS r, avg(l_tax) / 20 AS rng, 1000 * sum(qty) AS volume FROM ({src}) x GROUP BY symbol, day) r0) c0) p0"""
VIEWS["walk_1d"] = (("ticks_1d",), _WALK.format(src="SELECT symbol, day, l_discount, l_tax, qty FROM ticks_1d"))
VIEWS["walk_wk"] = (("ticks_1d",), _WALK.format(
    src="SELECT concat('P', l_suppkey * 7 % 40) AS symbol, CAST(date_trunc('week', day) AS DATE) AS day, l_discount, l_tax, qty FROM ticks_1d"))
# The opens and closes of walk_1d from sums of whole numbers: no price hangs on the order in which rows are added up.
VIEWS["exact_walk_1d"] = (("ticks_1d",), """
SELECT symbol, day, floor(100 * exp(lv - 0.7 * r) * 1e6 + 0.5) / 1e6 AS open, floor(100 * exp(lv) * 1e6 + 0.5) / 1e6 AS close FROM
 (SELECT symbol, day, r, CAST(sum(CAST(floor(r * 1e15 + 0.5) AS BIGINT)) OVER (PARTITION BY symbol ORDER BY day NULLS FIRST ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 1e15 AS lv FROM
  (SELECT symbol, day, CAST(sum(CAST(floor(l_discount * 1e9 + 0.5) AS BIGINT)) AS DOUBLE) / count(l_discount) / 1e9 - 0.05 AS r FROM ticks_1d GROUP BY symbol, day) r0) c0""")


def _needed(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in seen:
            seen.append(name)

    for name in names:
        visit(name)
    return seen


def over(views: str, body: str) -> str:
    """``body`` (a SELECT, or ``WITH a AS (...) SELECT``) with the named views in front."""
    body = body.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if recursive:
        body = ", " + body[15:]
    elif body.upper().startswith("WITH "):
        body = ", " + body[5:]
    ctes = ",\n".join(f"{v} AS ({VIEWS[v][1].strip()})" for v in _needed(views.split()))
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{ctes}\n{body}"


def hash_start(seed: int, n: str, block: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || draw || '|' || blk), 1, 8) AS BIGINT) % ({n} - {block} + 1)"


def resampled(sums: list[str], block: int, n_boot: int, seed: int) -> str:
    """CTEs from ``days`` to ``drawn``: one row per cell and draw with block-resampled sums."""
    ahead = ", ".join(f"sum({c}) OVER f AS {c}" for c in sums)
    total = ", ".join(f"sum(k.{c}) AS {c}" for c in sums)
    return f"""counted AS (SELECT cell, count(*) AS n FROM days GROUP BY cell HAVING count(*) >= {block}),
 blocks AS (SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY day) - 1 AS start, {ahead} FROM days
  WINDOW f AS (PARTITION BY cell ORDER BY day ROWS BETWEEN CURRENT ROW AND {block - 1} FOLLOWING)),
 draws0 AS (SELECT cell, n, unnest(range({n_boot})) AS draw FROM counted),
 picks0 AS (SELECT cell, n, draw, unnest(range(n // {block} + 1)) AS blk FROM draws0),
 picks AS (SELECT cell, draw, {hash_start(seed, 'n', block)} AS start FROM picks0),
 drawn AS (SELECT p.cell, p.draw, count(*) AS nblk, {total} FROM picks p JOIN blocks k ON p.cell = k.cell AND p.start = k.start GROUP BY p.cell, p.draw)"""


def _bounds(stat: str, where: str, n_boot: int) -> str:
    return f"""stats AS (SELECT cell, list_sort(list(d)) AS s, count(*) AS m, count(*) FILTER (WHERE d <= 0) AS below
  FROM (SELECT cell, {stat} AS d FROM drawn WHERE {where}) x GROUP BY cell),
 bounds AS (SELECT cell, s[CAST(floor(0.025 * m) AS BIGINT) + 1] AS low, s[CAST(floor(0.975 * m) AS BIGINT) + 1] AS high,
  greatest(2.0 * least(below, m - below) / m, 1.0 / {n_boot}) AS p_value FROM stats)"""


def two_group(body: str, block: int = 30, n_boot: int = 5000, seed: int = 7) -> str:
    """``body`` ends in CTE ``obs(cell, day, a, b)``; adds the interval query."""
    return f"""{body},
 days AS (SELECT cell, day, coalesce(sum(a), 0.0) AS a_sum, count(a) AS a_n, coalesce(sum(b), 0.0) AS b_sum, count(b) AS b_n FROM obs GROUP BY cell, day),
 {resampled(['a_sum', 'a_n', 'b_sum', 'b_n'], block, n_boot, seed)},
 {_bounds('a_sum / a_n - b_sum / b_n', 'a_n > 0 AND b_n > 0', n_boot)},
 totals AS (SELECT cell, count(*) AS n_days, CAST(sum(a_n) AS BIGINT) AS n_a, CAST(sum(b_n) AS BIGINT) AS n_b,
  sum(a_sum) / greatest(sum(a_n), 1) - sum(b_sum) / greatest(sum(b_n), 1) AS point FROM days GROUP BY cell)
 SELECT t.cell, t.n_days, t.n_a, t.n_b, R6(t.point) AS point, R6(b.low) AS low, R6(b.high) AS high, R6(b.p_value) AS p_value
 FROM totals t LEFT JOIN bounds b ON t.cell = b.cell"""


def event_mean(body: str, block: int = 30, n_boot: int = 5000, seed: int = 7) -> str:
    """``body`` ends in CTE ``ev(cell, day, v)``; adds the count-weighted interval query."""
    return f"""{body},
 days AS (SELECT cell, day, sum(v) AS v_sum, count(v) AS v_n FROM ev WHERE v IS NOT NULL GROUP BY cell, day),
 {resampled(['v_sum', 'v_n'], block, n_boot, seed)},
 {_bounds('v_sum / v_n', 'v_n > 0', n_boot)},
 totals AS (SELECT cell, count(*) AS n_days, CAST(sum(v_n) AS BIGINT) AS n, sum(v_sum) / greatest(sum(v_n), 1) AS point FROM days GROUP BY cell)
 SELECT t.cell, t.n_days, t.n, R6(t.point) AS point, R6(b.low) AS low, R6(b.high) AS high, R6(b.p_value) AS p_value
 FROM totals t LEFT JOIN bounds b ON t.cell = b.cell"""


def daily_mean(body: str, block: int = 30, n_boot: int = 5000, seed: int = 7) -> str:
    """``body`` ends in CTE ``days(cell, day, v)``; adds the unweighted interval query."""
    return f"""{body},
 {resampled(['v'], block, n_boot, seed)},
 {_bounds(f'v / (nblk * {block})', 'v IS NOT NULL', n_boot)},
 totals AS (SELECT cell, count(*) AS n, avg(v) AS point FROM days GROUP BY cell)
 SELECT t.cell, t.n, R6(t.point) AS point, R6(b.low) AS low, R6(b.high) AS high, R6(b.p_value) AS p_value
 FROM totals t LEFT JOIN bounds b ON t.cell = b.cell"""


def rolling(agg: str, x: str, n: int, end: int = 0, by: str = "symbol", order: str = "day") -> str:
    """Trailing aggregate of ``n`` rows ending ``-end`` rows back, null unless all are non-null."""
    hi = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    over_ = f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n - 1 - end} PRECEDING AND {hi})"
    return f"CASE WHEN count({x}) {over_} = {n} THEN {agg}({x}) {over_} END"


def percentile_rank(x: str, n: int, by: str = "symbol", order: str = "day") -> str:
    """Share of the last ``n + 1`` values at or below the current one (series without nulls)."""
    o = f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
    return (
        f"CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY {order}) > {n} THEN "
        f"CAST(len(list_filter(list({x}) {o}, lambda v: v <= {x})) AS DOUBLE) / {n + 1} END"
    )
