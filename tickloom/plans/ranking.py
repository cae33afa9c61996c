"""Cross-sectional ranking studies over the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import features as X
from tickloom.operators import bootstrap, crosssection
from tickloom.plans.oracle import daily_mean, over
from tickloom.registry import query
from tickloom.sources import market

LEADER = "P0"


def spread_by_momentum(spark, sf_dir, min_symbols: int = 10):
    """The flagship: top-2 minus bottom-2 forward return by 4-bar momentum, per day."""
    panel = X.panel(
        market.walk_wk(spark, sf_dir),
        [[X.momentum(4), X.forward_return(1)]],
        base=("symbol", "day", "close", "ret"),
    )
    return crosssection.ranking_spread(panel, "r4", "fwd1", k=2, min_symbols=min_symbols)


_SPREAD_SQL = """
WITH f AS (SELECT symbol, day, close / lag(close, 4) OVER w - 1 AS x, lead(close, 1) OVER w / close - 1 AS y
  FROM walk_wk WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 r AS (SELECT day, y, row_number() OVER (PARTITION BY day ORDER BY x, symbol) AS lo,
  row_number() OVER (PARTITION BY day ORDER BY x DESC, symbol DESC) AS hi, count(*) OVER (PARTITION BY day) AS n
  FROM f WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT CAST(day AS VARCHAR) AS day, R6(sum(CASE WHEN hi <= 2 THEN y END) / 2 - sum(CASE WHEN lo <= 2 THEN y END) / 2) AS v
FROM r WHERE n >= 10 AND (lo <= 2 OR hi <= 2) GROUP BY day"""


@query("ranking_spread_momentum", "K2 F2 F4 F33 S1 S6", over("walk_wk", _SPREAD_SQL))
def ranking_spread_momentum(spark, sf_dir):
    return spread_by_momentum(spark, sf_dir)


def ranking_panel(spark, sf_dir):
    """Weekly panel with every ranking feature of the nine-spread family."""
    return X.panel(
        market.walk_wk(spark, sf_dir),
        [
            [
                X.momentum(30),
                X.momentum(90),
                X.momentum(90, skip=7),
                X.vol_through(90, "vol90"),
                X.rolling_max("close", 52, "max52"),
                X.rolling_max("ret", 30, "maxret30"),
                X.illiquidity(30, "illiq30"),
                X.volume_shock(30, "vshock"),
                X.up_share(90, "upshare90"),
                X.forward_return(7),
            ]
        ],
        base=("symbol", "day", "close", "volume", "ret"),
        hook=lambda df: X.with_market_beta(df, LEADER, 90).withColumns(
            {
                "hi52": F.try_divide("close", "max52"),
                "riskadj": F.try_divide("r90", "vol90"),
                "resmom_ex": F.when(F.col("symbol") != LEADER, F.col("resmom90")),
            }
        ),
    )


SPREADS = {
    "r30": {"by": "r30"},
    "r90": {"by": "r90"},
    "riskadj": {"by": "riskadj"},
    "hi52": {"by": "hi52"},
    "resmom90": {"by": "resmom_ex"},
    "vol90": {"by": "vol90"},
    "maxret30": {"by": "maxret30"},
    "illiq30": {"by": "illiq30"},
    "vshock": {"by": "vshock"},
    "upshare90": {"by": "upshare90", "min_symbols": 6},
    "r90skip7": {"by": "r90skip7"},
}
SPREADS["upshare90"]["gate"] = "r90 > 0"


def _specs():
    return {n: {**s, "gate": F.expr(s["gate"])} if "gate" in s else s for n, s in SPREADS.items()}


_PANEL_SQL = """
WITH a AS (SELECT symbol, day, close, volume, close / lag(close) OVER w - 1 AS ret, close / lag(close, 30) OVER w - 1 AS r30,
  close / lag(close, 90) OVER w - 1 AS r90, lag(close, 7) OVER w / lag(close, 90) OVER w - 1 AS r90skip7,
  lead(close, 7) OVER w / close - 1 AS fwd7, CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY day ROWS 51 PRECEDING) = 52 THEN max(close) OVER (PARTITION BY symbol ORDER BY day ROWS 51 PRECEDING) END AS max52,
  volume / CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY day ROWS 29 PRECEDING) = 30 THEN avg(volume) OVER (PARTITION BY symbol ORDER BY day ROWS 29 PRECEDING) END AS vshock
  FROM walk_wk WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 m AS (SELECT day, ret AS mkt FROM a WHERE symbol = 'P0'),
 b AS (SELECT a.*, m.mkt,
  CASE WHEN count(ret) OVER w90 = 90 THEN stddev_samp(ret) OVER w90 END AS vol90,
  CASE WHEN count(ret) OVER w30 = 30 THEN max(ret) OVER w30 END AS maxret30,
  CASE WHEN count(ret) OVER w30 = 30 THEN avg(abs(ret) / (close * volume)) OVER w30 END AS illiq30,
  CASE WHEN count(ret) OVER w90 = 90 THEN avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) OVER w90 END AS upshare90,
  CASE WHEN count(ret * mkt) OVER w90 = 90 AND count(ret) OVER w90 = 90 AND count(mkt) OVER w90 = 90 THEN
   (avg(ret * mkt) OVER w90 - avg(ret) OVER w90 * avg(mkt) OVER w90) / NULLIF(avg(mkt * mkt) OVER w90 - pow(avg(mkt) OVER w90, 2), 0) END AS beta
  FROM a LEFT JOIN m ON a.day = m.day
  WINDOW w90 AS (PARTITION BY symbol ORDER BY a.day ROWS 89 PRECEDING), w30 AS (PARTITION BY symbol ORDER BY a.day ROWS 29 PRECEDING)),
 c AS (SELECT *, CASE WHEN count(ret - beta * mkt) OVER w90 = 90 THEN sum(ret - beta * mkt) OVER w90 END AS resmom90,
  close / max52 AS hi52, r90 / NULLIF(vol90, 0) AS riskadj FROM b WINDOW w90 AS (PARTITION BY symbol ORDER BY day ROWS 89 PRECEDING))"""

_LONG_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS cell, day, symbol, {'resmom90' if name == 'resmom90' else spec['by']} AS x, fwd7 AS y, {spec.get('min_symbols', 10)} AS need FROM c"
    + (" WHERE symbol <> 'P0'" if name == "resmom90" else " WHERE r90 > 0" if name == "upshare90" else "")
    for name, spec in SPREADS.items()
)
_DAYS_SQL = f"""{_PANEL_SQL},
 lng AS ({_LONG_SQL}),
 rk AS (SELECT cell, day, y, need, row_number() OVER (PARTITION BY cell, day ORDER BY x, symbol) AS lo,
  row_number() OVER (PARTITION BY cell, day ORDER BY x DESC, symbol DESC) AS hi, count(*) OVER (PARTITION BY cell, day) AS n
  FROM lng WHERE x IS NOT NULL AND y IS NOT NULL),
 days AS (SELECT cell, day, sum(CASE WHEN hi <= 2 THEN y END) / 2 - sum(CASE WHEN lo <= 2 THEN y END) / 2 AS v
  FROM rk WHERE n >= need GROUP BY cell, day)"""


@query("study_ranking_spreads", "E24-E32 F3 F8 F10 F13 F14 F15 F16 F18 J2 K2 R3", over("walk_wk", daily_mean(_DAYS_SQL, seed=2410)))
def study_ranking_spreads(spark, sf_dir):
    """Eleven rankings of one panel, each with its resampled interval."""
    days = crosssection.ranking_spreads(ranking_panel(spark, sf_dir), _specs())
    return bootstrap.daily_mean_ci(days, seed=2410)
