"""The given tables recast as market data: ticks, bars, legs, funding, sightings, trials, edges.

Every frame is a plain projection or a map-side-combined aggregate of the source table.
First/last prices of ticks come from the ticks at the ends of each bar, found by aggregates
over numbers (:func:`_barred`), so a symbol holding a third of all ticks is reduced before
anything is shuffled and raw ticks are never sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.session import settled, sided


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trade, with ``seq``: the struct that totally orders ticks."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.col("l_returnflag").alias("venue"),
        "l_suppkey",
        "l_linenumber",
        "l_discount",
        "l_tax",
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("notional"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.struct(
            "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
        ).alias("seq"),
    )


def _week(c: str):
    return F.date_trunc("week", c).cast("date")


def _barred(rows: DataFrame, by: Sequence[str], made: dict[str, tuple[Callable, Column | str]]) -> DataFrame:
    """``by``, ``open``, ``close`` and what ``made`` names of every bar: sums, least and largest values.

    An aggregate that compares structs sorts all the rows it reads. So the stamp and order of the
    ends of a bar are found first, by aggregates over numbers, and ``seq`` is compared only between
    the ticks that share them. The ticks are read twice; what is looked up is one row a bar.
    """
    at = F.coalesce(F.col("seq.l_shipdate").cast("timestamp_ntz"), F.expr("timestamp_ntz'0001-01-01 00:00:00'"))
    rows = rows.withColumns({"__at": at, "__order": F.coalesce("seq.l_orderkey", F.lit(-(2**63)))})
    stamps = rows.groupBy(*by, "__at").agg(F.min("__order").alias("lo"), F.max("__order").alias("hi"), *[f(c).alias(k) for k, (f, c) in made.items()])
    ends = [F.min("__at").alias("first"), F.min_by("lo", "__at").alias("lo"), F.max("__at").alias("last"), F.max_by("hi", "__at").alias("hi")]
    bars, n = settled(stamps.groupBy(*by).agg(*ends, *[f(k).alias(k) for k, (f, _) in made.items()]))
    bars = bars.withColumnsRenamed({c: f"__{c}" for c in by})
    ticked = rows.select(*by, "price", "seq", "__at", "__order")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    tips = ticked.join(sided(bars, n), same).where("(__at = first AND __order = lo) OR (__at = last AND __order = hi)")
    return tips.groupBy(*by).agg(F.min_by("price", "seq").alias("open"), F.max_by("price", "seq").alias("close"), *[F.first(k).alias(k) for k in made])


def _ohlcv(rows: DataFrame) -> DataFrame:
    made = {"high": (F.max, "price"), "low": (F.min, "price"), "volume": (F.sum, "qty"), "quote_volume": (F.sum, "notional")}
    return _barred(rows, ["symbol", "day"], made).select("symbol", "day", "open", "high", "low", "close", "volume", "quote_volume")


def bars_1d(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Daily bars of the ticks that ``where`` keeps; it reaches the scan."""
    return _ohlcv(ticks(spark, sf_dir).where(where))


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).withColumns(
        {"symbol": F.concat(F.lit("P"), F.col("l_suppkey") * 7 % 40), "day": _week("day")}
    )


def bars_wk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ohlcv(_weekly(spark, sf_dir))


def _props_number():
    return F.regexp_extract("props", "([0-9]+)", 1).cast("double")


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse hourly bars with taker-buy volume from the event log."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.date_trunc("hour", "ts").alias("ts"),
        "event_id",
        "value",
        _props_number().alias("size"),
        (F.col("user_id") % 2 == 0).alias("taker"),
    )
    return events.groupBy("symbol", "ts").agg(
        F.min_by("value", "event_id").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "event_id").alias("close"),
        F.sum("size").alias("volume"),
        F.sum(F.when(F.col("taker"), F.col("size")).otherwise(0.0)).alias("taker_buy"),
    )


def _walk(src: DataFrame) -> DataFrame:
    w = W.partitionBy("symbol").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    daily = src.groupBy("symbol", "day").agg(
        (F.avg("l_discount") - 0.05).alias("r"),
        (F.avg("l_tax") / 20).alias("rng"),
        (1000 * F.sum("qty")).alias("volume"),
    )
    priced = daily.withColumn("lv", F.sum("r").over(w)).select(
        "symbol",
        "day",
        "rng",
        "volume",
        F.round(100 * F.exp(F.col("lv") - 0.7 * F.col("r")), 6).alias("open"),
        F.round(100 * F.exp("lv"), 6).alias("close"),
    )
    return priced.select(
        "symbol",
        "day",
        "open",
        F.round(F.greatest("open", "close") * (1 + F.col("rng")), 6).alias("high"),
        F.round(F.least("open", "close") * (1 - F.col("rng")), 6).alias("low"),
        "close",
        "volume",
        (F.col("volume") * F.col("close")).alias("quote_volume"),
    )


def walk_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily random-walk bars, six symbols."""
    return _walk(ticks(spark, sf_dir))


def exact_walk_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opens and closes of :func:`walk_1d` that do not hang on the order in which rows are added up.

    A sum of doubles moves by its last digits with that order, and the prices rounded from it move
    by a whole step. Discounts are added up as whole billionths here and daily returns as 10^-15.
    """
    whole = lambda c, unit: F.floor(c * unit + 0.5)
    # A double beyond 2^53 is whole already, and floor() would end at the largest long.
    price = lambda p: F.when(p < 9e9, whole(p, 1e6).cast("double")).otherwise(p * 1e6) / 1e6
    w = W.partitionBy("symbol").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    mean = F.try_divide(F.sum(whole(F.col("l_discount"), 1e9)).cast("double"), F.count("l_discount")) / 1e9
    daily = ticks(spark, sf_dir).groupBy("symbol", "day").agg((mean - 0.05).alias("r"))
    priced = daily.withColumn("lv", F.sum(whole(F.col("r"), 1e15)).over(w).cast("double") / 1e15)
    return priced.select("symbol", "day", price(100 * F.exp(F.col("lv") - 0.7 * F.col("r"))).alias("open"), price(100 * F.exp("lv")).alias("close"))


def walk_wk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly random-walk bars, forty symbols."""
    return _walk(_weekly(spark, sf_dir))


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three settlements per symbol-day, eight hours apart."""
    return (
        ticks(spark, sf_dir)
        .groupBy("symbol", "day", (F.col("l_linenumber") % 3).alias("slot"))
        .agg(((F.avg("l_discount") - 0.05) / 100).alias("rate"))
    )


def spot_perp_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot close and perpetual close per symbol-day."""
    made = {"taxes": (F.sum, "l_tax"), "taxed": (F.sum, F.col("l_tax").isNotNull().cast("long"))}
    tax = F.try_divide("taxes", "taxed")
    return _barred(ticks(spark, sf_dir), ["symbol", "day"], made).select(
        "symbol", "day", "close", (F.col("close") * (1 + (tax - 0.04) / 10)).alias("perp_close")
    )


def venue_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).withColumn("symbol", F.concat(F.lit("S"), F.col("l_suppkey") % 4))
    return _barred(rows, ["venue", "symbol", "day"], {"quote_volume": (F.sum, "notional")}).drop("open")


def peg_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        ticks(spark, sf_dir)
        .groupBy("day")
        .agg((1 + (F.avg("l_tax") - 0.04) / 100).alias("close"))
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id")).alias("pool"),
        F.col("ts").alias("observed_at"),
        F.col("value").alias("price"),
        (100.0 * _props_number()).alias("liquidity"),
        (F.col("event_type") != "error").alias("alive"),
        "event_id",
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = (
        F.when(F.col("p_size") % 6 == 0, "killed")
        .when(F.col("p_size") % 6 == 1, "noise")
        .when(F.col("p_size") % 6 == 2, "signal")
        .when(F.col("p_size") % 6 == 3, "rejected")
        .when(F.col("p_size") % 6 == 4, "candidate")
        .otherwise("inconclusive")
    )
    branch = F.when(F.col("p_size") % 2 == 0, "info.").otherwise("strategy.")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("trial_id"),
        F.concat(F.lit("H"), F.col("p_partkey")).alias("hypothesis"),
        F.concat(branch, F.lower("p_type")).alias("family"),
        verdict.alias("verdict"),
        (F.col("p_retailprice") / 10000).alias("p_value"),
        F.col("p_name").alias("evidence"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency edges: suppliers of neighbouring lines of an order, lower key to higher, so acyclic."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    a = line.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("a"))
    b = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("b"))
    pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return (
        a.join(b, ["l_orderkey", "l_linenumber"])
        .select(*pair)
        .where("a < b")
        .distinct()  # while they are numbers
        .select(F.concat(F.lit("N"), "a").alias("src"), F.concat(F.lit("N"), "b").alias("dst"))
    )
