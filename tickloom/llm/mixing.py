"""Mixing sources to target weights (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, cut, whole

# Sources up to this number travel to every task (some tens of bytes each); more are joined.
SMALL_SOURCES = 100_000
ROWS_A_SALT = 500_000


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def targets(totals: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """``source, source_size, rows`` with the tokens each source is to give.

    Sources in code-point order, null last, take the weights in turn and share ``share`` times
    all tokens by them. No source gives more than ``cap`` times its own; what is cut off goes to
    the others by weight, until none is above: target = least(cap * size, level * weight). The
    level is the largest of those that spend the budget if the sources that fill up first, and
    those alone, were full. An empty source gives 0. One row a source here, never a document.
    """
    turn = F.expr("row_number() OVER (ORDER BY source ASC NULLS LAST) - 1")
    w = F.get(F.lit(weights), F.pmod(turn, F.lit(len(weights))).cast("int")).cast("double")
    open_ = totals.withColumn("weight", w).withColumn("full", cap * F.col("source_size"))
    levels = open_.where("source_size > 0").selectExpr(
        "*",
        f"{share}D * sum(source_size) OVER () AS budget",
        "coalesce(sum(full) OVER (ORDER BY full / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D) AS before",
        "sum(weight) OVER (ORDER BY full / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest",
    )
    filled = levels.selectExpr("*", "max((budget - before) / rest) OVER () AS level")
    given = filled.selectExpr("source", "source_size", "rows", "least(full, level * weight) AS target")
    none = open_.where("source_size <= 0 OR source_size IS NULL").selectExpr("source", "source_size", "rows", "0D AS target")
    return given.unionByName(none)


def draw(key: Column, seed: int) -> Column:
    """A number of 0 to 1 for each key, the same in every run."""
    word = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(word, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def with_copies(
    docs: DataFrame, size: str, weights: list[int], share: float = 1.5, cap: float = 2.0, seed: int = 0, key: str = "doc_id", source: str = "source"
) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` (its source's) and ``copies`` (how often to emit it).

    The repetition rate of a source is its target over its size; a document is emitted floor(rate)
    times and once more with the fraction as probability, drawn from a hash of its key. Null keys
    share a draw, and so do repeated rows; a null source is a source of its own; a null size
    counts as 0; columns named like the new ones are replaced; an empty table stays empty.

    Tokens are summed map-side, so a hot source leaves its tasks as one row. Rates reach the
    documents without a shuffle up to ``SMALL_SOURCES`` sources; beyond that by a join whose hot
    sources are split over salts in proportion to their rows.
    """
    docs = docs.drop("source_size", "target", "copies")
    size_col = F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long")
    totals = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(size_col).alias("source_size"), F.count(F.lit(1)).alias("rows"))
    rates = cut(targets(totals, weights, share, cap))
    few, most = rates.agg(F.count(F.lit(1)), F.max("rows")).first()
    name = rates.select(F.col("source").alias("__source"), "source_size", "target")
    if few <= SMALL_SOURCES:
        joined = docs.join(F.broadcast(name), F.col(f"`{source}`").eqNullSafe(F.col("__source")))
    else:
        salts = max(1, -(-most // ROWS_A_SALT))
        spread = name.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = docs.withColumn("__salt", F.pmod(F.xxhash64(f"`{key}`"), F.lit(salts)).cast("int"))
        joined = dealt.join(spread, F.col(f"`{source}`").eqNullSafe(F.col("__source")) & (dealt["__salt"] == spread["__salt"]))
        joined = joined.drop("__salt")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.col("target") / F.col("source_size"))).otherwise(0.0)
    whole_part = F.floor(rate)
    copies = whole_part + (draw(F.col(f"`{key}`"), seed) < rate - whole_part).cast("long")
    return joined.withColumn("copies", copies).drop("__source")


def mixed(docs: DataFrame, size: str, weights: list[int], **options) -> DataFrame:
    """The mix itself: every document as often as :func:`with_copies` says, in the columns of ``docs``."""
    counted = with_copies(docs, size, weights, **options)
    emitted = counted.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return emitted.select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][turn % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS full_size FROM s
), l AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
    coalesce(sum(full_size) OVER (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w WHERE source_size > 0
), t AS (
  SELECT source, source_size, least(full_size, max((budget - before) / rest) OVER () * weight) AS target FROM l
  UNION ALL SELECT source, source_size, 0.0 FROM w WHERE source_size <= 0
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(2.0::DOUBLE, t.target / t.source_size) ELSE 0.0 END AS rate,
    ('0x' || substr(md5('0:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
