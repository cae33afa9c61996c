"""Exact repeats of byte strings by suffixes in sorted ranges (operator 12).

A byte goes if some string of ``length`` bytes over it also starts earlier. Only suffixes that can
begin such a string are sorted. Every window of ``length`` bytes names an anchor, the ``GRAM`` bytes
in it with the least hash (the leftmost of equals); equal windows have equal anchors at the same
place, and neighbouring windows share theirs, so a text is a row of blocks: an anchor and the run of
windows that name it.

1. Blocks are suffixes whose leading token is the name of their anchor's bytes. Sampled splitters
   deal them into ranges of (token, digest, place); ranges are sorted, neighbours compared, and what
   hangs on a boundary is settled from one row an end of a range. A block that repeats an earlier
   one goes whole; first blocks that share a token with another first block are contested.
2. Windows of contested blocks are suffixes of the text itself: ranges of leading tokens, sorted
   in their bucket by multikey quicksort, eight bytes a digit, and compared with their neighbour.
   A token with more than ``HOT`` contested blocks is dealt by single windows as in step 1.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import freed_shuffles, scratch, whole
from tickloom.llm.ordered import OVER, key_of, ranges

GRAM = 32
#: Bytes hashed at a time; windows sorted at a time, about; contested blocks of a token before it is dealt by windows.
SLICE, WINDOWS, HOT = 1 << 21, 400_000, 2_000
#: Documents whose blocks splitters are drawn from, about. They set boundaries and nothing else.
DRAWN = 1_000

COPY, CONTESTED, START, END = 0, 1, 2, 4
PLACE = "key bigint, th bigint, l int, n int"
BLOCK = f"h bigint, d bigint, {PLACE}"
_ORDER = ["bucket", "h", "d", "key", "th", "l"]

# Odd multipliers of published 64-bit mixers.
_BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]
_MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def grams(data: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """A 64-bit hash of every ``k`` bytes, by doubling."""
    power = {n: np.uint64(pow(int(base), n, 1 << 64)) for n in {1 << b for b in range(k.bit_length())}}
    part, size = data.astype(np.uint64) + np.uint64(1), 1
    found, done = None, 0
    while True:
        if k & size:
            if found is None:
                found, done = part, size
            else:
                n = max(0, len(data) - done - size + 1)
                found, done = found[:n] * power[size] + part[done : done + n], done + size
        if 2 * size > k:
            return mixed(found)
        n = max(0, len(data) - 2 * size + 1)
        part, size = part[:n] * power[size] + part[size : size + n], 2 * size


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window of ``length`` bytes, and the hash of every gram."""
    gram = grams(data, GRAM, _BASES[0])
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    size, wide = 1, length - GRAM + 1
    while 2 * size <= wide:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < wide:
        least = np.minimum(least[: len(least) - wide + size], least[wide - size :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), gram


def blocks(data: np.ndarray, offsets: np.ndarray, length: int, size: int = SLICE) -> Iterator[tuple[np.ndarray, ...]]:
    """``(document, h, d, l, n)`` of all blocks of texts laid end to end, a slice of bytes at a time.

    A block cut by a slice is two blocks: their windows are then contested instead of copied.
    """
    for at in range(0, max(0, int(offsets[-1]) - length + 1), size):
        part = data[at : at + size + length - 1]
        if len(part) < length:
            return
        named, gram = anchors(part, length)
        inside = np.searchsorted(offsets, np.arange(at, at + len(named)), side="right") - 1
        starts = np.flatnonzero(np.arange(at, at + len(named)) + length <= offsets[inside + 1])
        if not len(starts):
            continue
        anchor = named[starts]
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.append(first[1:], len(starts)) - 1
        l, r, p = starts[first], starts[last], anchor[first]
        ends = grams(part, length, _BASES[1])
        d = mixed(ends[l] * _BASES[0] + ends[r] * _MIX[0] + ((p - l) * 65536 + (r - l)).astype(np.uint64) * _MIX[1])
        doc = inside[l]
        yield doc, gram[p].view(np.int64), d.view(np.int64), (l + at - offsets[doc]).astype(np.int32), (r - l + 1).astype(np.int32)


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, hash of the text and its bytes: rows that agree in both are one document."""
    content = whole(F.col(f"`{text}`"))
    return docs.select(key_of(key).alias("key"), F.xxhash64(content).alias("th"), content.cast("binary").alias("text"))


def _blocks(docs: DataFrame, length: int, splitters: list[tuple] | None = None) -> DataFrame:
    """The blocks of all texts, with the range each belongs to."""
    named = ["bucket", "h", "d", "key", "th", "l", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = _flat(batch.column(2))
            for doc, h, d, l, n in blocks(data, offsets, length):
                key, th = (batch.column(i).to_numpy()[doc] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (_ranges(splitters, h, d, key, th, l), h, d, key, th, l, n)], names=named)

    return docs.mapInArrow(run, f"bucket int, {BLOCK}")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins in its batch, and the bytes of all of them."""
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def _ranges(splitters: list[tuple] | None, h: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """The number of splitters at or before every row."""
    if not splitters:
        return np.zeros(len(h), np.int32)
    tokens = np.array([s[0] for s in splitters], np.int64)
    low, high = np.searchsorted(tokens, h, "left"), np.searchsorted(tokens, h, "right")
    # Rows with a splitter's own token, a frequent one as a rule, are told apart by the rest.
    for i in np.flatnonzero(low < high):
        low[i] = bisect_right(splitters, (int(h[i]), *(int(c[i]) for c in rest)), int(low[i]), int(high[i]))
    return low.astype(np.int32)


def _splitters(rows: DataFrame, n: int) -> list[tuple]:
    """At most ``n`` ascending rows, evenly spaced in a sample that a hash draws."""
    names = ["h", "d", "key", "th", "l"]
    drawn = sorted(tuple(r) for r in rows.select(*names).orderBy(F.xxhash64(*names)).limit(OVER * n).collect())
    return sorted(set(drawn[OVER - 1 :: OVER]))


def marks(rows: DataFrame, splitters: list[tuple], folder: str) -> DataFrame:
    """``kind, h, key, th, l, n``: copies of earlier blocks and contested first blocks.

    ``rows`` are blocks with the range each belongs to. One shuffle; ranges are compared as they
    stream by, with one row held. What passes a boundary is settled from two rows a range, which
    are as many as the splitters.
    """
    spark = rows.sparkSession
    dealt = rows.repartition(max(1, len(splitters)), "bucket").sortWithinPartitions(*_ORDER)
    dealt.mapInArrow(_compared, f"kind int, bucket int, {BLOCK}").write.parquet(folder)
    found = spark.read.parquet(folder)
    edges = found.where(F.col("kind") >= START).collect()
    extra = spark.createDataFrame(_settled(edges), f"kind int, h bigint, {PLACE}")
    return found.where(F.col("kind") < START).select("kind", "h", "key", "th", "l", "n").unionByName(extra)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks to marks; the ends of every range are told as well."""
    names = [*_ORDER, "n"]
    before: list[np.ndarray] | None = None  # the last row
    held: list[np.ndarray] | None = None  # the last first block, with its flags

    def told(kinds: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), *(pa.array(c) for c in columns)], names=["kind", *names])

    def firsts(columns: list[np.ndarray], shared: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at, kind in ((shared, CONTESTED), (starts, START), (ends, END)):
            if at.any():
                yield told(np.where(shared[at] & (kind > CONTESTED), kind + 1, kind), [c[at] for c in columns])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        columns = [columns[batch.schema.get_field_index(n)] for n in names]
        joined = [np.concatenate([b, c]) for b, c in zip(before, columns, strict=True)] if before else columns
        changed = [c[1:] != c[:-1] for c in joined[:6]]
        if before is None:
            changed = [np.insert(c, 0, True) for c in changed]
        # A row that repeats the one before it in all but its extent is a row of the same document.
        fresh, new_range = np.logical_or.reduce(changed), changed[0]
        new_token = new_range | changed[1]
        new_block = new_token | changed[2]
        before = [c[-1:] for c in columns]
        copied = fresh & ~new_block
        if copied.any():
            yield told(np.zeros(copied.sum()), [c[copied] for c in columns])
        own = [c[new_block] for c in columns]
        opening = new_range[new_block]
        same = ~new_token[new_block]  # shares range and token with the first block before it
        if held is not None:
            own = [np.concatenate([a, b]) for a, b in zip(held[0], own, strict=True)]
            opening, same = np.insert(opening, 0, held[1]), np.insert(same, 0, held[2])
        if not len(same):
            continue
        done = slice(0, len(same) - 1)
        # The held block's flag says what came before it; it is no run of its own here.
        yield from firsts([c[done] for c in own], same[:-1] | same[1:], opening[:-1], opening[1:])
        held = ([c[-1:] for c in own], opening[-1], same[-1])
    if held is not None:
        yield from firsts(held[0], np.array([held[2]]), np.array([held[1]]), np.array([True]))


def _settled(edges: list) -> list[tuple]:
    """What the first block of every range is, given the ranges before it."""
    ends: dict[int, dict] = {}
    for e in edges:
        ends.setdefault(e["bucket"], {})["start" if e["kind"] < END else "end"] = e
    out, last, shared = [], None, False  # the last first block so far; whether it is contested
    row = lambda kind, e: (kind, e["h"], e["key"], e["th"], e["l"], e["n"])
    for bucket in sorted(ends):
        start, end = ends[bucket]["start"], ends[bucket]["end"]
        alone = all(start[c] == end[c] for c in ("h", "d", "key", "th", "l"))
        contested = start["kind"] == START + 1
        if last is not None and last["h"] == start["h"]:
            same = last["d"] == start["d"]
            if same and (last["key"], last["th"], last["l"]) != (start["key"], start["th"], start["l"]):
                out.append(row(COPY, start))
            if (contested or not same) and not shared:
                out.append(row(CONTESTED, last))
                shared = True
            if not same and not contested:
                out.append(row(CONTESTED, start))
            if alone:
                last, shared = (last, shared) if same else (start, True)
                continue
        last, shared = end, end["kind"] == END + 1
    return out


def multikey_quicksort(order: np.ndarray, at: np.ndarray, digits: np.ndarray, text: bytes, length: int, small: int = 48) -> None:
    """Sort ``order`` by the ``length`` bytes from ``at[order]``, stably, in place.

    ``digits[p]`` are the eight bytes from ``p`` as a number: a segment is parted into smaller,
    equal and larger ones by one digit, equals go on with the next digit. Small segments are
    compared whole.
    """
    last, places = length - 8, at.tolist()
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        part = order[low:high]
        if len(part) <= small:
            if len(part) > 1:
                order[low:high] = sorted(part.tolist(), key=lambda i: text[places[i] : places[i] + length])
            continue
        values = digits[at[part] + min(depth, last)]
        pivot = np.sort(values[:: max(1, len(values) // 31)])[:31]
        pivot = pivot[len(pivot) // 2]
        less, more = values < pivot, values > pivot
        equal = ~(less | more)
        order[low:high] = np.concatenate([part[less], part[equal], part[more]])
        a, b = low + int(less.sum()), high - int(more.sum())
        todo += [(low, a, depth), (b, high, depth)]
        if depth < last:
            todo.append((a, b, depth + 8))


def _repeated(key: np.ndarray, th: np.ndarray, start: np.ndarray, at: np.ndarray, text: bytes, length: int) -> np.ndarray:
    """Which windows have an equal one at an earlier place; rows ascend by place."""
    data = np.frombuffer(text + bytes(8), np.uint8)
    digits = np.zeros(len(text) + 1, np.uint64)
    for i in range(8):
        digits = (digits << np.uint64(8)) | data[i : i + len(digits)]
    order = np.arange(len(at))
    multikey_quicksort(order, at, digits, text, length)
    equal = np.ones(len(order) - 1, bool)
    for depth in [*range(0, length - 8, 8), length - 8]:
        value = digits[at[order] + depth]
        equal &= value[1:] == value[:-1]
    first = np.maximum.accumulate(np.where(np.insert(equal, 0, False), 0, np.arange(len(order))))
    known = order[first]
    out = np.zeros(len(order), bool)
    out[order] = (key[order] != key[known]) | (th[order] != th[known]) | (start[order] != start[known])
    return out


def _sorted_buckets(length: int, windows: int):
    """Contested blocks with their bytes, whole tokens together, to runs of repeated windows."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by([("key", "ascending"), ("th", "ascending"), ("l", "ascending")]).combine_chunks()
        offsets, data = _flat(table["chunk"].chunk(0))
        key, th, l, n = (table[c].to_numpy() for c in ("key", "th", "l", "n"))
        block = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
        start = l[block] + step
        out = np.flatnonzero(_repeated(key[block], th[block], start, offsets[block] + step, data.tobytes(), length))
        # A run ends where a window is missing or its block ends.
        cut = np.flatnonzero((np.diff(out, prepend=-2) != 1) | (np.diff(block[out], prepend=-1) != 0))
        sizes = np.diff(np.append(cut, len(out)))
        rows = out[cut]
        arrays = (key[block[rows]], th[block[rows]], start[rows].astype(np.int32), sizes.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["key", "th", "l", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, token = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
            if held and h[0] != token and count >= windows:
                yield flush(held)
                held, count = [], 0
            n, begin = np.cumsum(batch.column("n").to_numpy()), 0
            for end in ends:
                count_now = count + int(n[end - 1]) - (int(n[begin - 1]) if begin else 0)
                if count_now >= windows and end < len(h):
                    held.append(batch.slice(begin, end - begin))
                    yield flush(held)
                    held, count, begin = [], 0, int(end)
            if begin < len(h):
                held.append(batch.slice(begin))
                count += int(n[-1]) - (int(n[begin - 1]) if begin else 0)
            token = h[-1]
        if held:
            yield flush(held)

    return run


def _windows(chunks: DataFrame, length: int, splitters: list[tuple] | None = None) -> DataFrame:
    """Every window of contested blocks as a block of its own, named by two hashes of its bytes."""
    names = ["bucket", "h", "d", "key", "th", "l", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, data = _flat(batch.column("chunk"))
            key, th, l, n = (batch.column(c).to_numpy() for c in ("key", "th", "l", "n"))
            block = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
            h, d = (grams(data, length, base)[offsets[block] + step].view(np.int64) for base in _BASES)
            place = key[block], th[block], (l[block] + step).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (_ranges(splitters, h, d, *place), h, d, *place, np.ones(len(h), np.int32))], names=names)

    return chunks.mapInArrow(run, f"bucket int, {BLOCK}")


def repeats(docs: DataFrame, length: int = 100, hot: int = HOT, windows: int = WINDOWS, drawn: int = DRAWN) -> DataFrame:
    """``key, th, l, n``: all runs of windows of ``length`` bytes that also start earlier.

    ``docs`` are key, hash of the text and its bytes. Intermediate rows are written to the shared
    folder; a lost executor repeats its own tasks.
    """
    spark = docs.sparkSession
    n = ranges(docs)
    some = max(1, docs.count() // drawn)
    drawn_docs = docs.where(F.pmod(F.xxhash64("key", "th"), F.lit(some)) == 0)
    splitters = _splitters(_blocks(drawn_docs, length), n)
    found = marks(_blocks(docs, length, splitters), splitters, scratch(spark, "marks"))
    copies = found.where(F.col("kind") == COPY).select("key", "th", "l", "n")

    contested = found.where(F.col("kind") == CONTESTED).drop("kind")
    crowded = contested.groupBy("h").agg(F.count(F.lit(1)).alias("blocks")).where(F.col("blocks") > hot).select("h", F.lit(True).alias("crowded"))
    chunk = F.expr(f"substring(text, l + 1, n + {length - 1})").alias("chunk")
    held = contested.join(crowded, "h", "left").join(docs, ["key", "th"]).select("h", "key", "th", "l", "n", chunk, F.col("crowded").isNotNull().alias("crowded"))
    folder = scratch(spark, "contested")
    held.write.parquet(folder)
    chunks = spark.read.parquet(folder)

    few = chunks.where(~F.col("crowded")).drop("crowded").repartitionByRange(n, "h").sortWithinPartitions("h")
    local = few.mapInArrow(_sorted_buckets(length, windows), PLACE)
    many = chunks.where("crowded").drop("crowded", "h")
    if many.isEmpty():
        return copies.unionByName(local)
    splitters = _splitters(_windows(many, length), n)
    single = marks(_windows(many, length, splitters), splitters, scratch(spark, "windows"))
    return copies.unionByName(local).unionByName(single.where(F.col("kind") == COPY).select("key", "th", "l", "n"))


def kept(text: bytes, starts: list[int], counts: list[int], length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs of bytes, and the remaining bytes."""
    runs: list[tuple[int, int]] = []
    for l, n in sorted(zip(starts, counts, strict=True)):
        a, b = l, l + n - 1 + length
        if runs and a <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(b, runs[-1][1])
        else:
            runs.append((a, b))
    ends = [0, *(b for _, b in runs)]
    return runs, b"".join(text[e:a] for e, a in zip(ends, [*(a for a, _ in runs), len(text)], strict=True))


def without_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", digest: bool = False, **how: int) -> DataFrame:
    """One row a document: ``key, n_bytes, n_removed, n_spans`` and what is left of its UTF-8 bytes.

    A byte is removed if a string of ``length`` bytes that covers it also starts in a document with
    a smaller key or earlier in its own; strings overlap and are judged on the input. What is left
    is ``kept`` (binary; it may end within a character), or with ``digest`` its ``kept_sha256``.
    Null and empty texts are empty. A null key comes before all others. Documents with one key are
    ordered by a hash of their text; rows that agree in key and text are the same document and get
    the same result. Texts shorter than ``length`` and empty tables lose nothing. Other columns are
    not read. ``how`` may set ``hot``, ``windows`` and ``drawn``, which change no result.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "repeats")
    with freed_shuffles(spark):
        repeats(_identified(docs, key, text), length, **how).write.parquet(folder)
    runs = spark.read.parquet(folder).groupBy("key", "th").agg(F.collect_list("l").alias("l"), F.collect_list("n").alias("n"))
    return _finished(docs, runs, length, key, text, digest)


def _finished(docs: DataFrame, runs: DataFrame, length: int, key: str, text: str, digest: bool) -> DataFrame:
    content: Column = whole(F.col(f"`{text}`"))
    own = docs.select(F.col(f"`{key}`").cast("bigint").alias("own"), key_of(key).alias("key"), F.xxhash64(content).alias("th"), content.cast("binary").alias("text"))
    sent = own.join(runs, ["key", "th"], "left").select("own", "text", "l", "n")
    last = "kept_sha256 string" if digest else "kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for content, l, n in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                value = content.as_py()
                spans, left = kept(value, l.as_py() or [], n.as_py() or [], length)
                row = len(value), len(value) - len(left), len(spans), hashlib.sha256(left).hexdigest() if digest else left
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 3 + [pa.string() if digest else pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[key, "n_bytes", "n_removed", "n_spans", last.split()[0]])

    return sent.mapInArrow(run, f"`{key}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {last}")
