"""Order MinHash fingerprints (operator 10).

The k-mers of a text are numbered by occurrence, so a repeated one is as many elements. Each
sketch takes the smallest ones of its own order, puts them back in text order and hashes the
tuple: two sketches agree only where the same k-mers stand in the same order, which edits by
insertion, deletion or moving lower. The order of sketch i is over the elements whose hash falls
in bin i; where a bin has too few (short texts), over all elements rehashed for that sketch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.ordered import map_with_next

K, TUPLE, SKETCHES = 6, 2, 128  # code points of a k-mer; k-mers of a sketch; sketches
_PLACE = np.uint64(20)  # bits of a position packed beside a hash
_U = np.uint64
_LAST = _U(2**64 - 1)
_AT_ONCE = 1 << 20
_ODD = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _kmers(text: str, k: int) -> np.ndarray:
    """A hash of every k-mer; of the whole text if it is shorter; none of an empty text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    k = min(k, len(codes))
    if not k:
        return codes
    out = np.zeros(len(codes) - k + 1, np.uint64)
    for i in range(k):
        out *= _ODD
        out += codes[i : i + len(out)]
    return _mix(out)


def _occurrences(hashes: np.ndarray) -> np.ndarray | None:
    """Which occurrence of its hash each element is, from 0; None if none repeats."""
    n = len(hashes)
    if n >> int(_PLACE):
        order = np.lexsort((np.arange(n), hashes))
        same = hashes[order[1:]] == hashes[order[:-1]]
    else:
        packed = (hashes >> _PLACE << _PLACE) | np.arange(n, dtype=np.uint64)
        packed.sort()
        same = packed[1:] >> _PLACE == packed[:-1] >> _PLACE
        order = None
    if not same.any():
        return None
    if order is None:
        order = (packed & _U((1 << int(_PLACE)) - 1)).astype(np.int64)
    first = np.concatenate([[True], ~same])
    at = np.arange(n)
    out = np.empty(n, np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def _tuples(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of each row's elements in text order."""
    places = np.sort(places, axis=1)
    out = np.zeros(len(places), np.uint64)
    for i in range(places.shape[1]):
        out = _mix(out * _ODD + values[places[:, i]])
    return out


def sketch(text: str | None, k: int = K, size: int = TUPLE, sketches: int = SKETCHES) -> np.ndarray:
    """The fingerprint of a text: ``sketches`` (a power of two) 16-bit hashes; zeros if it is empty."""
    values = _kmers(text or "", k)
    n, bits = len(values), int(sketches).bit_length() - 1
    out = np.zeros(sketches, np.uint64)
    if not n:
        return out.astype(np.uint16)
    nth = _occurrences(values)
    values = _mix(values if nth is None else values + nth.astype(np.uint64) * _ODD)
    low = values << _U(bits) >> _U(bits)  # the order within a bin; the bin is the bits above
    share = 1 << (64 - bits)
    limit = share if n < 16 * sketches else min(share, share // n * 12 * sketches)
    while True:
        # Elements under the limit hold the smallest of every bin that has enough of them.
        chosen = np.flatnonzero(low < _U(limit)) if limit < share else np.arange(n)
        order = chosen[np.argsort(values[chosen])]
        begins = np.searchsorted(values[order] >> _U(64 - bits), np.arange(sketches + 1, dtype=np.uint64))
        full = np.diff(begins) >= size
        if full.all() or limit >= share:
            break
        limit = min(share, limit * 4)
    if full.any():
        out[full] = _tuples(values, order[begins[:-1][full][:, None] + np.arange(size)])
    short = np.flatnonzero(~full)
    for some in np.array_split(short, len(short) * n // _AT_ONCE + 1) if len(short) else []:
        own = _mix(values[None, :] ^ _mix((some + 1).astype(np.uint64) * _ODD)[:, None])
        places = np.empty((len(some), min(size, n)), np.int64)
        for i in range(places.shape[1]):
            places[:, i] = own.argmin(axis=1)
            own[np.arange(len(some)), places[:, i]] = _LAST
        out[some] = _tuples(values, places)
    return (out >> _U(48)).astype(np.uint16)


def written(sketches: np.ndarray) -> str:
    return sketches.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of sketches that agree."""
    return float(np.count_nonzero(a == b)) / len(a)


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as hexadecimal digits in a new column ``into``.

    Null and empty texts have the fingerprint of zeros; equal texts have equal ones; repeated
    rows keep their rows; an empty table stays empty; a column named ``into`` is replaced. The
    text travels to Python by itself; no shuffle, one batch in memory at a time.
    """
    kept = docs.drop(into) if into != text else docs
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema) + f"`{into}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [written(sketch(t)) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, into])

    return kept.mapInArrow(run, schema)


def against_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and neighbours are.

    The edited text has its last half (rounded down) replaced by as much of the beginning of the
    next text by key. Order, nulls, ties and the end are as in :func:`ordered.map_with_next`.
    """
    schema = f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def row(k, t: str, following: str, own: np.ndarray, theirs: np.ndarray) -> tuple:
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        other = sketch(edited)
        return k, len(t), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(other), likeness(own, other), likeness(own, theirs)

    return map_with_next(docs, key, text, row, sketch, schema)
