"""Importance resampling towards a target distribution of hashed word n-grams (operator 13).

A 256-byte table lower-cases A-Z and blanks separators in UTF-8, ``bytes.split`` yields words, CRC-32
seeds chained from word to word extend n-grams, and counters reduce them to buckets.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import cut

# Letters, digits and all bytes of other than ASCII characters stay; everything else parts words.
TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
CHUNK = 1 << 20


def chunks(text: bytes, size: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number of bytes (or one word) at a time."""
    at = 0
    while at < len(text):
        end = at + size
        part = text[at:end].translate(TABLE)
        # A word cut by the end of the part is completed piece by piece.
        while end < len(text) and part[-1:] != b" ":
            more = text[end : end + size].translate(TABLE)
            stop = more.find(b" ") + 1 or len(more)
            part, end = part + more[:stop], end + stop
        yield part.split()
        at = end


def grams(text: bytes, n: int, size: int = CHUNK) -> Iterator[list[int]]:
    """CRC-32 of all runs of 1 to ``n`` words joined by one space, a list a chunk and length."""
    tail: list[bytes] = []
    for words in chunks(text, size):
        seq = tail + words
        joined = [b" " + w for w in seq]
        level = list(map(crc32, seq))
        for k in range(1, n + 1):
            # Runs that end in this chunk; the others were counted with the one before.
            yield level[max(0, len(tail) - k + 1) :]
            level = list(map(crc32, joined[k:], level))
        tail = seq[len(seq) - n + 1 :] if n > 1 else []


def bucket_counts(docs: DataFrame, n: int = 2, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """``bucket, n``: how many features of all texts fall into each bucket that has any.

    Null and empty texts have none. A task sends at most ``buckets`` rows, however many texts it reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for level in grams(t or b"", n):
                    found.update([c % buckets for c in level])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["bucket", "n"])

    sent = docs.select(F.col(f"`{text}`").cast("binary").alias("text"))
    return sent.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = 10_000) -> list[int]:
    """A thousandth log ratio of smoothed bucket shares, target over raw, for every bucket."""
    s_all, t_all = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((raw.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def weighed(docs: DataFrame, gain: list[int], n: int = 2, text: str = "text") -> DataFrame:
    """``docs`` less the text, with ``n_words``, ``n_features`` and ``weight``: the floored mean gain of its features (none: 0).

    Input columns named like new ones are replaced. No shuffle.
    """
    made = ["n_words", "n_features", "weight"]
    carry = [c for c in docs.columns if c != text and c not in made]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), *(f"{m} bigint" for m in made)])
    sent = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("binary").alias("__text"))
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for t in batch.column(len(carry)).to_pylist():
                words = features = total = 0
                for i, level in enumerate(grams(t or b"", n)):
                    words += len(level) * (i % n == 0)
                    features += len(level)
                    total += sum([gain[c % buckets] for c in level])
                for column, value in zip(out, (words, features, total // features if features else 0), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *(pa.array(c, pa.int64()) for c in out)], names=[*carry, *made])

    return sent.mapInArrow(run, schema)


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``df`` with the place of every row in the order, from 1, without one task that sorts all.

    Rows are dealt into ranges of the order, cut between rows even where all rows are equal, and
    numbered inside their range; what stands before a range comes from one count a range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    dealt = cut(cut(rows).repartitionByRange(parts, *order, F.col("__row")).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    # One row a range of the shuffle: as many as there are partitions.
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order, "__row"))
    return dealt.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + inside).drop("__range", "__row", "__before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, n: int = 2, buckets: int = 10_000, least_words: int = 20, seed: int = 7, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``key, n_words, n_features, weight, score, rank``: documents drawn towards ``target`` by Gumbel top-k.

    Every document's weight is the mean log ratio of its features; its score adds a Gumbel variate
    from a hash of seed and key, so reruns agree. Of the documents with ``least_words`` or more,
    ``percent`` in a hundred (rounded down) with the highest scores are ranked; the others have a
    null rank. Ties go to smaller keys, nulls first; a null key is hashed as the empty string.
    Repeated rows have equal scores and are ranked one after another. Null and empty texts have no
    features and weight 0; an empty table stays empty. Only bucket counts (at most ``buckets`` rows
    of either table) reach the driver; what is ranked are rows of six numbers.
    """
    counted = [{r["bucket"]: r["n"] for r in bucket_counts(df, n, buckets, c).collect()} for df, c in ((docs, text), (target, target_text))]
    slim = docs.select(F.col(f"`{key}`").cast("bigint").alias("__key"), F.col(f"`{text}`").alias("text"))
    rows = weighed(slim, gains(*counted, buckets), n)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__key").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    scored = cut(rows.withColumn("score", F.col("weight") + noise))
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    placed = ranked(scored.where(fit), F.col("score").desc(), F.col("__key").asc_nulls_first())
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("bigint")))
    every = placed.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("bigint")))
    return every.select(F.col("__key").alias(key), "n_words", "n_features", "weight", "score", "rank")


# The same in plain SQL, CRC-32 spelled out by its rule over the bytes of every distinct feature.
SQL = r"""
WITH steps AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t
), words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), features AS (
  SELECT side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words
), distinct_features AS (
  SELECT f, hex(f) AS x FROM (SELECT DISTINCT f FROM features)
), hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: (16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM distinct_features, steps
), tallied AS (
  SELECT side, id, bucket, count(*) AS n FROM features JOIN hashed USING (f) GROUP BY ALL
), totals AS (
  SELECT coalesce(sum(n) FILTER (side = 'd'), 0) AS s_all, coalesce(sum(n) FILTER (side = 't'), 0) AS t_all FROM tallied
), buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM tallied GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS g FROM buckets, totals
), weights AS (
  SELECT id, sum(n) AS n_features, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM tallied JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || w.id)[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM words w LEFT JOIN weights ON weights.id = w.id WHERE w.side = 'd'
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS fit FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * fit // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
