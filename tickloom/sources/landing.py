"""Landed files: JSON-lines registries and panels, CSV bars, typed series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.quality import schema_drift

OBSERVATION_SCHEMA = "pool string, observed_at timestamp, price double, liquidity double, alive boolean"


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])


_TS, _D = T.TimestampType(), T.DoubleType()

# Side-series kinds, their time column and their schema.
SERIES: dict[str, tuple[str, T.StructType]] = {
    "funding": ("timestamp", _fields(("timestamp", _TS), ("rate", _D))),
    "perp": ("day", _fields(("day", _TS), ("perp_close", _D))),
    "intraday_15m": (
        "ts",
        _fields(("ts", _TS), ("open", _D), ("high", _D), ("low", _D), ("close", _D), ("volume", _D)),
    ),
    "intraday_taker": ("ts", _fields(("ts", _TS), ("close", _D), ("volume", _D), ("taker_buy", _D))),
    "intraday_oi": ("ts", _fields(("ts", _TS), ("oi", _D))),
    "equity_stream": ("timestamp", _fields(("timestamp", _TS), ("equity", _D), ("exposure", _D))),
    "return_stream": ("timestamp", _fields(("timestamp", _TS), ("ret", _D))),
}


def read_series(spark: SparkSession, root: str, kind: str, key: str, strict: bool = True) -> DataFrame:
    """One series of a kind, partitioned ``kind=/key=`` under ``root``.

    ``strict`` refuses columns that are missing, extra or of another type; otherwise absent
    columns are read as null.
    """
    _, schema = SERIES[kind]
    path = f"{root}/kind={kind}/key={key}"
    if strict:
        drift = schema_drift(spark.read.parquet(path), schema)
        if drift:
            raise ValueError(f"{kind}/{key}: {'; '.join(drift)}")
    return spark.read.schema(schema).parquet(path)


def series_faults(df: DataFrame, kind: str) -> DataFrame:
    """(rows, null_times, repeated_times): integrity of a series; gaps are not judged."""
    time, _ = SERIES[kind]
    per_stamp = df.groupBy(time).count()
    return per_stamp.agg(
        F.sum("count").alias("rows"),
        F.coalesce(F.sum(F.when(F.col(time).isNull(), F.col("count"))), F.lit(0)).alias("null_times"),
        F.count_if((F.col("count") > 1) & F.col(time).isNotNull()).alias("repeated_times"),
    )


def read_json_rows(
    spark: SparkSession, path: str, schema: str = OBSERVATION_SCHEMA, since: str | None = None
) -> DataFrame:
    """JSON-lines under ``dt=`` folders; malformed lines are skipped, ``since`` prunes folders."""
    df = spark.read.schema(schema + ", dt date").option("mode", "DROPMALFORMED").json(path)
    return df if since is None else df.where(F.col("dt") >= F.lit(since).cast("date"))


def append_json_rows(df: DataFrame, path: str, at: str) -> None:
    """Append rows as JSON lines partitioned by the UTC date of ``at``."""
    df.withColumn("dt", F.to_date(at)).write.mode("append").partitionBy("dt").json(path)


def safe_double(c: Column) -> Column:
    """Number or null; text such as 'n/a', infinities and NaN become null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def parse_payload(df: DataFrame, payload: str, fields: dict[str, str]) -> DataFrame:
    """Lift JSON fields to columns: ``fields`` maps a column name to its type."""
    out = df
    for name, kind in fields.items():
        raw = F.get_json_object(payload, f"$.{name}")
        out = out.withColumn(name, safe_double(raw) if kind == "double" else raw.try_cast(kind))
    return out


CSV_BARS = "day string, open string, high string, low string, close string, volume string"


def read_csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars from CSV with a header; columns other than symbol, day and OHLCV are ignored."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.strip().lower(): c for c in raw.columns}
    return raw.select(
        *(F.col(names[c]).alias(c) for c in ("symbol",) if c in names),
        F.to_date(F.col(names.get("date", names.get("day")))).alias("day"),
        *(F.col(names[c]).try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")),
    )


def csv_faults(bars: DataFrame) -> DataFrame:
    """(repeated, bad_price, incoherent, bad_volume): counts that must all be zero to accept a file."""
    per_day = bars.groupBy(*(c for c in ("symbol", "day") if c in bars.columns)).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(
            F.coalesce(F.least("open", "high", "low", "close") <= 0, F.lit(True))
        ).alias("bad_price"),
        F.count_if(
            (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close"))
        ).alias("incoherent"),
        F.count_if(F.coalesce(F.col("volume") < 0, F.lit(True))).alias("bad_volume"),
    )
    return per_day.agg(
        F.sum(F.col("n") - 1).alias("repeated"),
        F.sum("bad_price").alias("bad_price"),
        F.sum("incoherent").alias("incoherent"),
        F.sum("bad_volume").alias("bad_volume"),
    )


# Quote suffixes longest first, stable bases, leveraged-token suffixes.
QUOTES = ("FDUSD", "USDT", "USDC", "BUSD", "TUSD", "EUR", "TRY", "BTC", "ETH", "BNB")
LEVERAGED = ("UP", "DOWN", "BULL", "BEAR", "3L", "3S", "5L", "5S")


def base_and_quote(symbol: Column) -> tuple[Column, Column]:
    """Split a joined symbol at its known quote suffix; both null when none fits."""
    pattern = f"^(.+)({'|'.join(QUOTES)})$"
    base, quote = F.regexp_extract(symbol, pattern, 1), F.regexp_extract(symbol, pattern, 2)
    return F.nullif(base, F.lit("")), F.nullif(quote, F.lit(""))


def tradable_candidates(markets: DataFrame, stables: list[str], base: str = "base") -> DataFrame:
    """Drop stable coins and leveraged tokens by base name."""
    b = F.col(base)
    return markets.where(~b.isin(stables) & ~b.rlike(f"({'|'.join(LEVERAGED)})$"))
