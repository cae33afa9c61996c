"""As-of lookups: what was known when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.windows import by_symbol
from tickloom.operators.bars import calendar
from tickloom.operators.skew import with_facts
from tickloom.session import shared


def carry_forward(df: DataFrame) -> DataFrame:
    """Each symbol's latest row on every day of the union timeline from its first bar on.

    A row answers for its own day and the timeline rows up to the symbol's next bar, which is
    a bounded explode of row positions. Adds ``as_of`` (the day answered) and ``fresh``.
    """
    days = shared(calendar(df))
    placed = df.join(days, "day").withColumn("__until", F.lead("ord").over(by_symbol("ord")) - 1)
    full = placed.withColumn("__at", F.explode(F.sequence("ord", F.coalesce("__until", "days")))).drop("ord", "days", "__until")
    at = days.select(F.col("ord").alias("__at"), F.col("day").alias("as_of"))
    return full.join(at, "__at").withColumn("fresh", F.col("as_of") == F.col("day")).drop("__at")


#: Rows of a key that one task orders, about.
BUCKET_ROWS = 100_000


def _instant(c, kind) -> Column:
    """A time as a number that keeps its order."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    return c


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], on: str, right_on: str, values: list[str], strict: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Latest right-hand ``values`` at or before (``strict``: before) each left row's ``on``.

    Two levels. Both sides are dealt into buckets of their key's time span, as many as the key has
    ``bucket_rows``; inside a bucket a union carries the last value forward, and what stands
    before a bucket is carried over a table of one row a bucket. A key with half of all rows is
    many buckets, and no range is joined. At equal times right rows come first unless ``strict``;
    of right rows with equal times the one with the largest values counts. Rows with a null time
    match nothing; ``keys`` may be empty.
    """
    cols = left.columns
    kinds = {f.name: f.dataType for f in (*left.schema.fields, *right.schema.fields)}
    k = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    val = F.struct(right_on, *values)
    row_type, val_type = left.select(F.struct(*cols)).schema[0].dataType, right.select(val).schema[0].dataType
    l = left.select(
        k.alias("k"), F.col(on).alias("t"), F.lit(0 if strict else 1).alias("side"), F.struct(*cols).alias("row"), F.lit(None).cast(val_type).alias("val"),
    )
    r = right.where(F.col(right_on).isNotNull()).select(
        k.alias("k"), F.col(right_on).alias("t"), F.lit(1 if strict else 0).alias("side"), F.lit(None).cast(row_type).alias("row"), val.alias("val"),
    )
    both = l.unionByName(r).withColumn("at", _instant(F.col("t"), kinds[on]).cast("double"))
    spans = both.groupBy("k").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.ceil(F.count(F.lit(1)) / bucket_rows).alias("parts"))
    share = F.try_divide(F.col("at") - F.col("lo"), F.col("hi") - F.col("lo"))
    bucket = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * F.col("parts")), F.col("parts") - 1).cast("long")
    placed = with_facts(both, spans, "k").select("k", "t", "side", "row", "val", bucket.alias("bucket"))
    order = ["t", "side", "val"]
    ends = placed.groupBy("k", "bucket").agg(F.max_by("val", F.when(F.col("val").isNotNull(), F.struct(*order))).alias("end"))
    opening = ends.select("k", "bucket", F.last("end", ignorenulls=True).over(W.partitionBy("k").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)).alias("open"))
    inside = W.partitionBy("k", "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    carried = placed.withColumn("own", F.last("val", ignorenulls=True).over(inside)).where("row is not null")
    out = carried.join(opening, ["k", "bucket"]).withColumn("val", F.when(F.col("t").isNotNull(), F.coalesce("own", "open")))
    return out.select("row.*", F.col(f"val.{right_on}").alias(f"asof_{right_on}"), *(F.col(f"val.{v}").alias(v) for v in values))


def known_at(bars: DataFrame, as_of: str, interval_days: int = 1, lag_days: int = 0) -> DataFrame:
    """Rows knowable at ``as_of``: a bar is available when its interval (plus lag) has passed."""
    out = bars.withColumn("available_at", F.date_add("day", interval_days + lag_days))
    return out.where(F.col("available_at") <= F.lit(as_of).cast("date"))


def latest_state(known: DataFrame, values: list[str]) -> DataFrame:
    """Newest known row per symbol."""
    return known.groupBy("symbol").agg(
        F.max("day").alias("day"), *(F.max_by(v, "day").alias(v) for v in values)
    )


def lookahead(uses: DataFrame, source_day: str, as_of: str, interval_days: int = 1) -> DataFrame:
    """(symbol, uses, latest, violations): source rows used before their bar had closed.

    ``uses`` has one row for each source row a decision read: ``source_day``, the bar's day, and
    ``as_of``, the time of the decision.
    """
    known = uses.withColumn("available_at", F.date_add(source_day, interval_days))
    return known.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("uses"),
        F.max("available_at").alias("latest"),
        F.count_if(F.col("available_at") > F.col(as_of)).alias("violations"),
    )


def first_after(events: DataFrame, observations: DataFrame, key: str, at: str, obs_at: str, values: list[str]) -> DataFrame:
    """First observation strictly after each key's event time, as columns.

    Observations of a busy key are spread over salts for the join, filtered, and reduced
    map-side, so no task sees a whole key. Expects one event per key.
    """
    later = with_facts(observations, events.select(key, at), key).where(F.col(obs_at) > F.col(at))
    packed = F.struct(obs_at, *values)
    return later.groupBy(key, at).agg(F.min(packed).alias("e")).select(key, at, "e.*")
