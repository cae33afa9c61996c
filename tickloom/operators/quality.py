"""Bar quality: findings as rows, never repairs.

Rows are first reduced to one record per (symbol, stamp), which combines map-side, so a
symbol holding a large share of the raw rows costs no more than its grid of stamps. Gap and
return checks then run over that grid; examples are the first five stamps by a running
count, so nothing unbounded is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.operators.skew import exact_percentiles
from tickloom.session import shared

# Outlier threshold, its scale, and the number of example stamps.
MAD_Z = 10.0
MAD_SCALE = 0.6745
EXAMPLES = 5

SEVERITY = {
    "schema": "error",
    "empty": "error",
    "nulls": "error",
    "duplicates": "error",
    "unsorted": "error",
    "incoherent": "error",
    "gaps": "warning",
    "zero_volume": "warning",
    "outliers": "warning",
    "coverage": "info",
}


def schema_drift(df: DataFrame, want: StructType) -> list[str]:
    """Missing, extra and retyped columns, by name; empty when the schemas agree."""
    have = {f.name: f.dataType for f in df.schema.fields}
    need = {f.name: f.dataType for f in want.fields}
    out = [f"missing {n}" for n in need if n not in have]
    out += [f"extra {n}" for n in have if n not in need]
    out += [f"retyped {n}" for n in need if n in have and have[n] != need[n]]
    return out


def set_findings(df: DataFrame, want: StructType, expected: DataFrame) -> DataFrame:
    """(symbol, check, severity, count, detail) of whole sets: drifted schema, or no rows at all.

    ``expected`` names the symbols that should have rows. A schema that differs is found for
    each of them, one row a difference, and nothing else is looked at.
    """
    severity = lambda check: F.lit(SEVERITY[check]).alias("severity")
    drift = schema_drift(df, want)
    if drift:
        found = expected.select("symbol", F.lit("schema").alias("check"), severity("schema"), F.explode(F.lit(drift)).alias("detail"))
    else:
        present = df.select("symbol").distinct()
        found = expected.join(present, "symbol", "left_anti").select("symbol", F.lit("empty").alias("check"), severity("empty"), F.lit("no rows").alias("detail"))
    return found.withColumn("count", F.lit(1).cast("long"))


def incoherent(open_="open", high="high", low="low", close="close", volume="volume") -> Column:
    o, h, lo, c, v = (F.col(x) for x in (open_, high, low, close, volume))
    return (lo > F.least(o, c)) | (h < F.greatest(o, c)) | (F.least(o, h, lo, c) <= 0) | (v < 0)


def lag_in_buckets(df: DataFrame, key: str, order: Column, bucket: Column, value: str, out: str) -> DataFrame:
    """``lag(value)`` per key in ``order``, without one task per key.

    Each (key, bucket) is sorted alone; only the bucket's last value crosses to the next
    bucket, through a table with one row per (key, bucket). Buckets must follow ``order``.
    """
    rows = df.withColumns({"__b": bucket, "__o": order})
    inner = W.partitionBy(key, "__b").orderBy("__o")
    rows = rows.withColumns(
        {"__lag": F.lag(value).over(inner), "__rn": F.row_number().over(inner)}
    )
    edge = rows.groupBy(key, "__b").agg(F.max_by(value, "__o").alias("__last"))
    edge = edge.select(key, "__b", F.lag("__last").over(W.partitionBy(key).orderBy("__b")).alias("__carry"))
    joined = rows.join(edge, [key, "__b"], "left")
    return joined.withColumn(
        out, F.when(F.col("__rn") == 1, F.col("__carry")).otherwise(F.col("__lag"))
    ).drop("__b", "__o", "__lag", "__rn", "__carry")


def unsorted_rows(rows: DataFrame, order: Column, bucket: Column, ts: str = "ts") -> DataFrame:
    """(symbol, unsorted): rows whose stamp is before that of the row ingested just before.

    Each (symbol, bucket) is sorted alone and leaves one row, its count and its first and last
    stamps; these meet their neighbours. Buckets must follow ``order``.
    """
    rows = rows.select("symbol", F.col(ts).alias("__ts"), order.alias("__o"), bucket.alias("__b"))
    prev = F.lag("__ts").over(W.partitionBy("symbol", "__b").orderBy("__o"))
    per_bucket = rows.withColumn("__prev", prev).groupBy("symbol", "__b").agg(
        F.count_if(F.col("__ts") < F.col("__prev")).alias("n"), F.min_by("__ts", "__o").alias("first"), F.max_by("__ts", "__o").alias("last")
    )
    joint = per_bucket.withColumn("carry", F.lag("last").over(W.partitionBy("symbol").orderBy("__b")))
    return joint.groupBy("symbol").agg((F.sum("n") + F.count_if(F.col("first") < F.col("carry"))).alias("unsorted"))


def by_stamp(rows: DataFrame, last_by: Column | str, ts: str = "ts") -> DataFrame:
    """One record per (symbol, stamp): row, null, incoherent and zero-volume counts, last close."""
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ("open", "high", "low", "close", "volume")])
    return rows.groupBy("symbol", F.col(ts).alias("ts")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(any_null).alias("null_rows"),
        F.count_if(incoherent()).alias("bad_rows"),
        F.count_if(F.col("volume") == 0).alias("zero_rows"),
        F.max_by("close", last_by).alias("close"),
    )


def findings(
    stamps: DataFrame, step_seconds: int, unsorted: DataFrame | None = None
) -> DataFrame:
    """(symbol, check, severity, count, missing, examples) from :func:`by_stamp` records.

    The records are read by every refinement of the medians; the rows behind them are read once.
    """
    stamps = shared(stamps)
    w = W.partitionBy("symbol").orderBy("ts")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    grid = stamps.withColumns(
        {
            "hole": F.greatest(F.floor((seconds - F.lag(seconds).over(w)) / step_seconds) - 1, F.lit(0)),
            "ret": F.try_divide(F.col("close"), F.lag("close").over(w)) - 1,
        }
    )
    med = exact_percentiles(grid, ["symbol"], "ret", {"med": 0.5})
    n_ret = grid.groupBy("symbol").agg(F.count("ret").alias("n_ret"))
    dev = grid.join(n_ret, "symbol").join(med, "symbol", "left").withColumn("dev", F.abs(F.col("ret") - F.col("med")))
    mad = exact_percentiles(dev, ["symbol"], "dev", {"mad": 0.5})
    scored = dev.join(mad, "symbol", "left").withColumn(
        "outlier",
        (F.col("n_ret") >= 2) & (F.col("mad") > 0) & (MAD_SCALE * F.col("dev") > MAD_Z * F.col("mad")),
    )
    counts = {
        "nulls": F.col("null_rows"),
        "duplicates": F.when(F.col("rows") > 1, F.col("rows")).otherwise(0),
        "incoherent": F.col("bad_rows"),
        "gaps": (F.col("hole") > 0).cast("int"),
        "zero_volume": F.col("zero_rows"),
        "outliers": F.coalesce(F.col("outlier").cast("int"), F.lit(0)),
    }
    counts = {k: F.coalesce(v, F.lit(0)).cast("long") for k, v in counts.items()}
    run = w.rowsBetween(W.unboundedPreceding, 0)
    seen = scored.withColumns({f"__{k}": v for k, v in counts.items()}).withColumns(
        {f"__{k}_i": F.sum((F.col(f"__{k}") > 0).cast("int")).over(run) for k in counts}
    )
    aggs = []
    for k in counts:
        first = F.when((F.col(f"__{k}") > 0) & (F.col(f"__{k}_i") <= EXAMPLES), F.col("ts"))
        aggs += [F.sum(f"__{k}").alias(f"n_{k}"), F.array_sort(F.collect_list(first)).alias(f"x_{k}")]
    per_symbol = seen.groupBy("symbol").agg(F.coalesce(F.sum("hole"), F.lit(0)).cast("long").alias("missing"), *aggs)
    rows = [
        F.struct(
            F.lit(k).alias("check"),
            F.lit(SEVERITY[k]).alias("severity"),
            F.col(f"n_{k}").alias("count"),
            F.when(F.lit(k) == "gaps", F.col("missing")).otherwise(F.lit(0)).cast("long").alias("missing"),
            F.col(f"x_{k}").alias("examples"),
        )
        for k in counts
    ]
    out = per_symbol.select("symbol", F.inline(F.array(*rows))).where(F.col("count") > 0)
    if unsorted is not None:
        empty = F.array().cast(out.schema["examples"].dataType)
        out = out.unionByName(
            unsorted.where("unsorted > 0").select(
                "symbol",
                F.lit("unsorted").alias("check"),
                F.lit(SEVERITY["unsorted"]).alias("severity"),
                F.col("unsorted").alias("count"),
                F.lit(0).cast("long").alias("missing"),
                empty.alias("examples"),
            )
        )
    return out


def report(found: DataFrame) -> DataFrame:
    """(symbol, errors, warnings, storable): any error keeps the batch out of the lake."""
    return found.groupBy("symbol").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        (F.count_if(F.col("severity") == "error") == 0).alias("storable"),
    )


def coverage(bars: DataFrame, start: str, end: str, step_days: int = 1) -> DataFrame:
    """Rows, span, share of the interval grid filled, and shortfall against ``[start, end]``."""
    g = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("day").alias("first"), F.max("day").alias("last")
    )
    slots = F.floor(F.datediff("last", "first") / step_days) + 1
    return g.withColumns(
        {
            "complete_pct": F.col("rows") * 100.0 / slots,
            "late_start": F.greatest(F.datediff("first", F.lit(start).cast("date")), F.lit(0)),
            "early_end": F.greatest(F.datediff(F.lit(end).cast("date"), "last"), F.lit(0)),
        }
    )


def manifest_parts(df: DataFrame, keys: list[str], day: str, values: list[str]) -> DataFrame:
    """(keys, part, rows, first, last, d1, d2): content of every year of a key, as sums.

    A row is written out as its day and its values in millionths; two halves of the MD5 of that
    are added up. Sums do not depend on order, tell repeated rows apart from single ones, combine
    map-side and can be taken from any engine. ``part`` is the year.
    """
    shown = [F.coalesce(F.floor(F.col(v) * 1e6 + 0.5).cast("bigint").cast("string"), F.lit("null")) for v in values]
    digest = F.md5(F.concat_ws("|", F.date_format(day, "yyyy-MM-dd"), *shown))
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)"))
    return df.groupBy(*keys, F.year(day).alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(day).alias("first"), F.max(day).alias("last"), half(1).alias("d1"), half(16).alias("d2")
    )


def manifest(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, first, last, digest): parts added up; stable across rebuilds."""
    return parts.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.concat_ws("-", F.sum("d1").cast("string"), F.sum("d2").cast("string")).alias("digest"),
    )


def renewed(parts: DataFrame, df: DataFrame, touched: DataFrame, keys: list[str], day: str, values: list[str]) -> DataFrame:
    """The parts after an upsert: only those with touched rows are read and summed again."""
    stale = touched.select(*keys, F.year(day).alias("part")).distinct()
    years = df.withColumn("part", F.year(day)).join(stale, [*keys, "part"], "left_semi").drop("part")
    return parts.join(stale, [*keys, "part"], "left_anti").unionByName(manifest_parts(years, keys, day, values))


def signature(df: DataFrame, day: str = "day") -> DataFrame:
    """(column, type, nulls, rows, symbols, first, last) of a panel, from one aggregate."""
    aggs = [F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)]
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("symbol").alias("symbols"),
        F.min(day).alias("first"),
        F.max(day).alias("last"),
        *aggs,
    )
    rows = [
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n_{i}").alias("nulls"))
        for i, f in enumerate(df.schema.fields)
    ]
    return one.select("rows", "symbols", "first", "last", F.inline(F.array(*rows)))


def panel_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(column, only_a, only_b, max_abs): key mismatches and the largest change per number."""
    numbers = [f.name for f in a.schema.fields if f.dataType.simpleString() in ("double", "bigint", "int") and f.name not in keys]
    left = a.select(*keys, *(F.col(c).alias(f"a_{c}") for c in numbers), F.lit(True).alias("in_a"))
    right = b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in numbers), F.lit(True).alias("in_b"))
    both = left.join(right, keys, "full")
    agg = both.agg(
        F.count_if(F.col("in_b").isNull()).alias("only_a"),
        F.count_if(F.col("in_a").isNull()).alias("only_b"),
        *(F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias(f"d_{c}") for c in numbers),
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").cast("double").alias("max_abs")) for c in numbers]
    return agg.select("only_a", "only_b", F.inline(F.array(*rows)))
