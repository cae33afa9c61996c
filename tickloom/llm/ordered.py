"""Rows dealt into ranges of an integer key, small enough for a task each.

The ranges are cut at keys of the table itself: a uniform sample by hash, whose size depends on
the number of ranges and not on the table, is sorted and every ``OVER``-th key becomes a cut. So
every range is known to start with the row of its cut, which neighbours can be told about.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

OVER = 16
# Null keys sort first.
NULL_KEY = -(2**63)


def key_of(key: str) -> Column:
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULL_KEY))


def ranges(df: DataFrame) -> int:
    """Four ranges for each shuffle partition of the session."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cuts(df: DataFrame, key: str, n: int) -> list[int]:
    """At most ``n`` ascending keys of the table, the first one its smallest; [] if it is empty."""
    keys = df.select(key_of(key).alias("k"))
    least = keys.agg(F.min("k")).first()[0]
    if least is None:
        return []
    drawn = keys.orderBy(F.xxhash64("k"), "k").limit(OVER * n).collect()
    return sorted({least, *sorted(r[0] for r in drawn)[OVER - 1 :: OVER]})


def range_of(key: Column, cut: list[int]) -> Column:
    """The number of the range a key lies in: looked up in two steps, each the root of their number."""
    step = max(1, round(len(cut) ** 0.5))
    rows = [cut[i : i + step] for i in range(0, len(cut), step)]
    heads = F.lit([r[0] for r in rows])
    row = F.size(F.filter(heads, lambda c: c <= key))
    inner = F.size(F.filter(F.get(F.array(*[F.lit(r) for r in rows]), row - 1), lambda c: c <= key))
    return ((row - 1) * step + inner - 1).cast("int")


def map_with_next(docs: DataFrame, key: str, text: str, row_of: Callable, kept_of: Callable, schema: str) -> DataFrame:
    """``row_of(key, text, next text, kept, next kept)`` for every row and the one after it.

    Rows are ascending by key (nulls first, equal keys by text, nulls as the empty text); the last
    row is followed by the first, a single row by itself. ``kept_of(text)`` is worked out once a
    row and handed over with it. Each range also gets a copy of the row that starts the next one,
    as a guest, so a task needs nothing from another; one shuffle of the texts.
    """
    n = ranges(docs)
    bounds = cuts(docs, key, n)
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    if not bounds:
        return slim.sparkSession.createDataFrame([], schema)
    last = len(bounds) - 1
    at = slim.withColumn("at", range_of(key_of("key"), bounds))
    starts = key_of("key") == F.get(F.lit(bounds), F.col("at"))
    before = F.when(F.col("at") > 0, F.col("at") - 1).otherwise(F.lit(last))
    places = F.when(starts, F.array(F.struct(F.col("at").alias("range"), F.lit(0).alias("guest")), F.struct(before.alias("range"), F.lit(1).alias("guest"))))
    places = places.otherwise(F.array(F.struct(F.col("at").alias("range"), F.lit(0).alias("guest"))))
    dealt = at.select("key", "text", F.inline(places)).repartition(n, "range").sortWithinPartitions("range", "guest", "key", "text")
    fields = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = None, None  # the row that waits for its next one; the range
        for batch in batches:
            out = []
            for k, t, r, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != now:
                    now, held = r, None
                elif held is None:
                    continue  # more guests with the same key
                kept = kept_of(t)
                if held is not None:
                    out.append(row_of(held[0], held[1], t, held[2], kept))
                held = None if guest else (k, t, kept)
            columns = zip(*out, strict=True) if out else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return dealt.mapInArrow(run, schema)
