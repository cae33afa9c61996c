"""The bar lake: Hive-partitioned parquet by symbol, interval and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)
_PARTITIONS = [
    T.StructField("symbol", T.StringType()),
    T.StructField("interval", T.StringType()),
    T.StructField("year", T.IntegerType()),
]
LAKE_SCHEMA = T.StructType([*BAR_SCHEMA.fields, *_PARTITIONS])


def bars_from_rows(rows: DataFrame, keep: list[str] = ()) -> DataFrame:
    """``epoch_ms, o, h, l, c, v`` columns to typed bars, beside the columns to keep."""
    names = ("open", "high", "low", "close", "volume")
    return rows.select(
        *keep,
        F.timestamp_millis(F.col("epoch_ms").cast("long")).alias("timestamp"),
        *(F.col(short).cast("double").alias(name) for short, name in zip("ohlcv", names, strict=True)),
    )


def read_bars(
    spark: SparkSession, lake: str, symbol: str, interval: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Bars of one symbol and interval in ``[start, end)``, sorted by time.

    The bounds also prune the year partitions they imply.
    """
    df = spark.read.schema(LAKE_SCHEMA).parquet(lake).where((F.col("symbol") == symbol) & (F.col("interval") == interval))
    if start is not None:
        df = df.where((F.col("timestamp") >= F.lit(start).cast("timestamp")) & (F.col("year") >= int(start[:4])))
    if end is not None:
        df = df.where((F.col("timestamp") < F.lit(end).cast("timestamp")) & (F.col("year") <= int(end[:4])))
    return df.orderBy("timestamp")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union of both with the new row winning per key; repeated keys in ``new`` keep one row.

    A grouped ``max_by`` combines map-side; the row itself breaks ties, so the result does not
    depend on task order.
    """
    rest = [c for c in existing.columns if c not in keys]
    both = existing.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)))
    packed = F.struct(*rest)
    picked = both.groupBy(*keys).agg(F.max_by(packed, F.struct("__batch", packed)).alias("row"))
    return picked.select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest)).select(*existing.columns)


def write_bars(new: DataFrame, lake: str) -> None:
    """Idempotent merge of ``symbol, interval, timestamp, ohlcv`` rows into the lake.

    Only the (symbol, interval, year) partitions the batch touches are read back and
    replaced, through dynamic partition overwrite.
    """
    spark = new.sparkSession
    incoming = new.withColumn("year", F.year("timestamp")).select(*LAKE_SCHEMA.fieldNames())
    parts = ["symbol", "interval", "year"]
    merged = incoming
    if _has_data(spark, lake):
        touched = incoming.select(*parts).distinct()
        old = spark.read.schema(LAKE_SCHEMA).parquet(lake).join(touched, parts, "left_semi")
        merged = upsert(old, incoming, ["symbol", "interval", "timestamp"])
    else:
        merged = upsert(incoming.limit(0), incoming, ["symbol", "interval", "timestamp"])
    # The merge reads the files it replaces, so it is settled before the overwrite starts.
    from tickloom.session import cut_lineage

    settled = cut_lineage(merged)
    (
        settled.repartition(*parts)
        .sortWithinPartitions(*parts, "timestamp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(lake)
    )


def _has_data(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def catalog(bars: DataFrame, findings_report: DataFrame, rows: Column | None = None) -> DataFrame:
    """One row per (symbol, interval): rows, span, error and warning counts.

    ``rows`` is the aggregate that counts rows where ``bars`` holds them summed already.
    """
    spans = bars.groupBy("symbol", "interval").agg(
        (F.count(F.lit(1)) if rows is None else rows).alias("rows"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end")
    )
    return spans.join(findings_report.select("symbol", "errors", "warnings"), "symbol", "left").fillna(
        0, ["errors", "warnings"]
    )


def staleness_days(df: DataFrame, now: str, ts: str = "day") -> DataFrame:
    """(symbol, newest, stale_days) against a stated instant."""
    newest = F.max(F.col(ts).cast("timestamp"))
    return df.groupBy("symbol").agg(
        F.max(ts).alias("newest"),
        ((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(newest)) / 86400.0).alias("stale_days"),
    )


def reconcile(frozen: DataFrame, current: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows in common and the largest absolute difference per value column."""
    a = frozen.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values))
    b = current.select(*keys, *(F.col(v).alias(f"b_{v}") for v in values))
    return a.join(b, keys).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("common"),
        *(F.max(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}"))).alias(f"max_{v}") for v in values),
    )
