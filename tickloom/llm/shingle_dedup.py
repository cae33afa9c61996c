"""Near-duplicates by SimHash and pivot distance tables, verified by the Jaccard similarity of word shingles.

Equal sets of shingles are one node, with a SimHash of 256 bits. No pair at the similarity is left
out by the search for pairs: that share of a near copy's shingles stands in its partner, so texts
with fewer that stand elsewhere are discarded, and of what is left every pair shares a key among
the first shingles by hash (the prefix of a set that no partner can miss as a whole). The first
node of a key is its pivot. Pairs whose distances to the pivot differ by more than the radius are
discarded, then those whose SimHashes do; what is left is verified on the sets.

At 0.8 the bits of two large sets differ with a probability of 0.15, of sets of 4 and 5 shingles
(the worst) of 0.19: 39 and 48 of 256, with deviations of 6. Unrelated ones differ in 128.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.blocks import distance
from tickloom.llm.common import cut, freed_shuffles
from tickloom.llm.components import components
from tickloom.llm.simhash import majority

SEED = 42
# Words of a SimHash, and the most bits in which near copies differ: over six deviations beyond the worst mean.
WORDS, RADIUS = 4, 90
# Shingles that a task counts at a time, and bytes of text that it deals at a time.
COUNTED, SLICE = 1 << 22, 1 << 24


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of ``shingle`` words; of all words if there are fewer."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z alone, and ASCII white space
    if not words:
        return np.empty(0, "<u8")
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g, SEED) for g in grams], "<u8"))


def keys_of(hashes: np.ndarray, similarity: float = 0.8) -> list[int]:
    """The first hashes of a sorted set, one more than a similar set can lack: two similar sets share one of them."""
    n = len(hashes)
    return hashes[: n - math.ceil(similarity * n - 1e-9) + 1].astype(np.uint64).view(np.int64).tolist() if n else []


@lru_cache(maxsize=1)
def _spread() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"word %d" % i, SEED) | 1 for i in range(WORDS)], np.uint64)


def fingerprint(hashes: np.ndarray) -> list[int]:
    """The SimHash of a set as signed words; every hash is spread over all of them. 0 of an empty set."""
    if not len(hashes):
        return [0] * WORDS
    words = hashes[:, None] * _spread()
    words ^= words >> np.uint64(32)
    return majority(words * _spread()[::-1] ^ words).tolist()


def _name(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - 2**63


def _described(rows: DataFrame, shingle: int) -> DataFrame:
    """``row, node, n, fp`` of ``rows`` (row, text): a hash of the set, its size, its SimHash."""
    schema = f"row {rows.schema['row'].dataType.simpleString()}, node bigint, n bigint, fp array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, shingle) for t in batch["text"].to_pylist()]
            made = [
                pa.array([_name(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([fingerprint(s) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch["row"], *made], names=["row", "node", "n", "fp"])

    return rows.select("row", "text").mapInArrow(run, schema)


def _slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Runs of at most ``size`` bytes and 2^15 texts, so that a place fits 16 bits; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = min(max(int(np.searchsorted(ends, before + size, "right")), at + 1), at + 2**15)
        yield texts.slice(at, to - at)
        at = to


def _echoed(texts: DataFrame, shingle: int, similarity: float, shingles_: int) -> DataFrame:
    """``node`` of the texts of which at least the share ``similarity`` of shingles stands in other rows too.

    Shingles are dealt by their upper bits into buckets and counted there by the lower 32; a clash
    only keeps a text. They travel as arrays, a row for each slice of texts and bucket, and come
    back as one number a text and bucket. A slice sends a shingle once, however common it is.
    """
    buckets, size = 1 + shingles_ // COUNTED, SLICE

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for texts in _slices(batch["text"], size):
                sets = [shingles(t, shingle) for t in texts.to_pylist()]
                flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int16), [len(s) for s in sets])
                flat, first, which, often = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
                here = np.bincount(doc[often[which] > 1], minlength=len(sets))
                need = [max(math.ceil(similarity * len(s) - 1e-9), 1) for s in sets] - here
                # What stands in several texts of the slice is sent once, for others to meet.
                owner = np.where(often > 1, np.int16(-1), doc[first])
                cuts = np.searchsorted((flat >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64)).astype(np.int32)
                ends = pa.array([*cuts, cuts[-1]], pa.int32())
                # A bucket of its own holds which texts they are and how many shingles must be found in the others.
                made = [
                    pa.array([*range(buckets), -1 - at], pa.int64()),
                    pa.array([at] * (buckets + 1), pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(flat.astype(np.uint32).view(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(owner)),
                    pa.array([None] * buckets + [[_name(s) for s in sets]], pa.list_(pa.int64())),
                    pa.array([None] * buckets + [need.astype(np.int32)], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(made, names=["bucket", "batch", "hashes", "docs", "nodes", "counts"])
                at += 1

    def counted(group: pa.Table) -> pa.Table:
        if group["bucket"][0].as_py() < 0:
            return group.select(["batch", "docs", "nodes", "counts"])
        hashes, docs = group["hashes"].combine_chunks(), group["docs"].combine_chunks()
        _, which, often = np.unique(hashes.flatten().to_numpy(), return_inverse=True, return_counts=True)
        flat = docs.flatten().to_numpy()
        shared, cuts = (often[which] > 1) & (flat >= 0), np.concatenate([[0], np.cumsum(hashes.value_lengths().to_numpy())])
        made = [np.unique(flat[s:t][shared[s:t]], return_counts=True) for s, t in zip(cuts[:-1], cuts[1:], strict=True)]
        found = [pa.array([p for p, _ in made], pa.list_(pa.int16())), pa.array([None] * len(made), pa.list_(pa.int64())), pa.array([n.astype(np.int32) for _, n in made], pa.list_(pa.int32()))]
        return pa.table([group["batch"], *found], names=["batch", "docs", "nodes", "counts"])

    def summed(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next(r for r in rows if r["nodes"] is not None)
        need = np.array(own["counts"], np.int64)
        for r in rows:
            if r["nodes"] is None:
                need[np.array(r["docs"], np.int64)] -= np.array(r["counts"], np.int64)
        return pa.table([pa.array(np.array(own["nodes"], np.int64)[need <= 0])], names=["node"])

    parts = texts.select("text").mapInArrow(dealt, "bucket bigint, batch bigint, hashes array<int>, docs array<smallint>, nodes array<bigint>, counts array<int>")
    counts = parts.groupBy("bucket").applyInArrow(counted, "batch bigint, docs array<smallint>, nodes array<bigint>, counts array<int>")
    return counts.groupBy("batch").applyInArrow(summed, "node bigint").distinct()


def _texts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of ``nodes`` (node, row), read again from their rows."""
    wanted = nodes.select("node", F.col("row.key").alias("k"), F.col("row.print").alias("p"))
    read = rows.join(wanted, F.col("row.key").eqNullSafe(F.col("k")) & (F.col("row.print") == F.col("p")))
    return read.select("node", "text").dropDuplicates(["node"])


def _sets(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``node, n, keys, set`` of ``texts`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, shingle) for t in batch["text"].to_pylist()]
            made = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([keys_of(s, similarity) for s in sets], pa.list_(pa.int64())),
                pa.array([s.view("<i8") for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch["node"], *made], names=["node", "n", "keys", "set"])

    return texts.mapInArrow(run, "node bigint, n bigint, keys array<bigint>, set array<bigint>")


def _apart(a: str, b: str) -> Column:
    """In how many bits two SimHashes differ."""
    return reduce(Column.__add__, [distance(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(WORDS)])


def _edges(rows: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs of nodes at least so similar.

    The first node of every key, its pivot, is compared with the others of it; then those pairs of
    a key are that this leaves unconnected, so a group of near copies costs a comparison a member.
    Only pairs that the distances to the pivot and the SimHashes leave are compared on their sets.
    """
    held = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    alive = cut(_echoed(rows, shingle, similarity, held))
    # Copies stand in each other: one row of each node is counted again.
    texts = cut(_texts(rows, nodes.join(alive, "node", "left_semi")))
    alive = cut(_echoed(texts, shingle, similarity, held))
    sets = cut(_sets(texts.join(alive, "node", "left_semi"), shingle, similarity))
    nodes = nodes.join(alive, "node", "left_semi")
    keyed = cut(sets.select(F.explode("keys").alias("key"), "node", "n"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min_by(F.struct("node", "n"), "node").alias("first")).where("held > 1")
    prints = nodes.select("node", "fp")
    pivots = shared.select("key", "first").join(prints.select(F.col("node").alias("p"), F.col("fp").alias("pivot")), F.col("first.node") == F.col("p"))
    live = keyed.join(pivots.select("key", "first", "pivot"), "key").join(prints, "node")
    live = cut(live.select("key", "node", "n", "first", "fp", _apart("fp", "pivot").alias("to_pivot")))

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
        both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
        alike = F.col("common") + 1e-9 >= similarity * (F.size("x") + F.size("y") - F.col("common"))
        return cut(both.where(alike).select("a", "b"))

    near = F.least("m", "n") + 1e-9 >= similarity * F.greatest("m", "n")  # no set can share more than the smaller one holds
    stars = live.where((F.col("node") != F.col("first.node")) & (F.col("to_pivot") <= RADIUS)).select(F.col("first.node").alias("a"), F.col("node").alias("b"), F.col("first.n").alias("m"), "n")
    found = verified(stars.where(near).select("a", "b").distinct())
    rooted = live.join(components(found), "node", "left").select("key", "node", "n", "fp", "to_pivot", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    open_ = cut(rooted.join(mixed, "key"))
    other = open_.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("fp").alias("fp_b"), F.col("to_pivot").alias("b_to_pivot"))
    close = (F.abs(F.col("to_pivot") - F.col("b_to_pivot")) <= RADIUS) & (_apart("fp", "fp_b") <= RADIUS)
    pairs = open_.withColumnRenamed("node", "a").join(other, "key").where((F.col("a") < F.col("b")) & (F.col("root") != F.col("other")) & near & close)
    return found.unionByName(verified(pairs.select("a", "b").distinct()))


def first_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for every connected group of near-duplicates: the smallest key, null first.

    Two texts are linked if the sets of their ``shingle``-word runs (A-Z lower-cased, parted at
    ASCII white space) have a Jaccard similarity of at least ``similarity``, which is meant to be
    0.8 or more, and their SimHashes differ in ``RADIUS`` bits at most; texts without words are one
    group. Rows are told apart by key and text; of rows equal in both one stays. Texts are hashed
    twice, those of which most stands elsewhere up to twice more, and all are shuffled once, to
    meet the keys that stay.
    """
    print_ = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = docs.select(F.struct(F.col(f"`{key}`").alias("key"), print_.alias("print")).alias("row"), F.col(f"`{text}`").alias("text"))
    with freed_shuffles(docs.sparkSession):
        nodes = cut(_described(rows, shingle).groupBy("node").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", "fp")]))
        rooted = components(_edges(rows, nodes, shingle, similarity))
    named = nodes.select("node", "row").join(rooted, "node", "left")
    stays = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("row").alias("row")).select(F.col("row.key").alias("__key"), F.col("row.print").alias("__print"))
    mine = docs.withColumn("__mine", print_)
    kept = mine.join(stays, F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.col("__mine") == F.col("__print")), "left_semi")
    return kept.dropDuplicates([key, "__mine"]).select(*[F.col(f"`{c}`") for c in docs.columns])
