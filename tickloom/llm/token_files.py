"""Token ids in binary shards under a minimal perfect hash index (operator 8).

A shard holds the raw ids of a range of keys, in ascending order of the key, 2 bytes each (4 where
the vocabulary needs them), least byte first. The index is parted by key hash. Each part holds a
minimal perfect hash of its keys (levels of bit arrays: a key is placed at the first level where
no other key meets it) and, by the key's number, a 32-bit fingerprint of the key and the place of
its ids. A lookup reads one part, tests a bit a level, compares the fingerprint and reads one slice.
Shards are written as they come and read slice by slice, so neither is ever held whole.
"""

from __future__ import annotations

import gc
import io
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import cut, whole
from tickloom.llm.ordered import cuts, key_of, range_of, ranges
from tickloom.llm.pretokens import MEMO, Memo, parted, segments, spelled, units

KEYS_A_PART = 100_000


class Units(dict):
    """Ids of units that stand behind ``lead``, remembered within a bound; a full memo starts again.

    A unit of letters is one pre-token. Stops behind it are another, and a unit that goes over a
    line end is put together from what is before and behind it: such units seldom repeat, so they
    are not kept themselves.
    """

    def __init__(self, encoder: Encoder, lead: str, limit: int):
        super().__init__()
        self.encoder, self.lead, self.letters, self.limit = encoder, lead, spelled(lead), limit

    def __missing__(self, unit: str) -> bytes:
        if unit.isascii() and unit.isalpha():
            value = self.encoder.ids(self.letters + unit)
        elif found := parted(unit):
            word, stops, line, after = found
            if line:
                return self[word + stops] + self.encoder.stops[line] + self.encoder.first[after]
            value = self[word] + self.encoder.stops[stops] if stops else self.encoder.ids(self.letters + spelled(word))
        else:
            value = self.encoder.packed(*self.encoder.tokenizer.encode(self.lead + unit, add_special_tokens=False).ids)
        if len(self) >= self.limit:
            self.clear()
        self[unit] = value
        return value


class Encoder:
    """Ids of a text as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, memo: int = 3 * MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.code = "H" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.tokenize = self.tokenizer.model.tokenize  # the property makes a new model each time
        self.stops = Memo(lambda p: self.ids(spelled(p)), memo // 8)
        self.first, self.rest = Units(self, "", memo // 8), Units(self, " ", memo)
        gc.freeze()  # the memos live as long as the worker; no collection walks through them

    def ids(self, letters: str) -> bytes:
        """Packed ids of one pre-token in the byte alphabet."""
        return array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()

    def packed(self, *ids: int) -> bytes:
        return array(self.code, ids).tobytes()

    def __call__(self, text: str) -> bytes:
        out = []
        for special, part in segments(text, list(self.specials)):
            if special:
                out.append(self.packed(self.specials[part]))
            elif part:
                first, *others = units(part)
                out.append(self.first[first])
                out.extend(map(self.rest.__getitem__, others))
        return b"".join(out)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def place(folder: str) -> tuple[pafs.FileSystem, str]:
    """The store and path of a folder's URI (or of a plain local path)."""
    return pafs.FileSystem.from_uri(folder)


def put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Write a file so that it appears whole; a repeated task leaves the same bytes."""
    half = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(half) as out:
        out.write(data)
    fs.move(half, path)


class Stream:
    """A file written as it comes, that appears whole when it is closed; a repeated task leaves the same bytes."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path, self.half = fs, path, f"{path}.{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.half, buffer_size=1 << 20)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.half, self.path)


def get(fs: pafs.FileSystem, path: str) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read()


def slices(f: pa.NativeFile, begins: np.ndarray, sizes: np.ndarray, most: int = 1 << 22) -> Iterator[bytes]:
    """Slices of an open file, ascending: neighbours come in one read of about ``most`` bytes, gaps are not read."""
    ends, at = begins + sizes, 0
    while at < len(begins):
        last = at
        while last + 1 < len(begins) and begins[last + 1] - ends[last] < 4096 and ends[last + 1] - begins[at] <= most:
            last += 1
        data = f.read_at(int(ends[last] - begins[at]), int(begins[at]))
        for i in range(at, last + 1):
            yield data[int(begins[i] - begins[at]) : int(ends[i] - begins[at])]
        at = last + 1


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """A fresh 64-bit hash of a hash for each level."""
    x = h + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers n distinct 64-bit hashes 0 .. n-1 without storing them."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.before = np.cumsum([0, *(int(b.sum()) for b in bits)])
        self.ranks = [np.cumsum(b, dtype=np.int64) - b for b in bits]

    @classmethod
    def build(cls, hashes: np.ndarray, room: float = 2.0) -> PerfectHash:
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys of the index share a 64-bit hash")
        bits, left = [], hashes
        while len(left):
            size = max(64, int(room * len(left)))
            at = (_mixed(left, len(bits)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        return cls(bits)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's number; -1 where no level holds a bit for it."""
        found = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, bits in enumerate(self.bits):
            at = (_mixed(hashes[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            found[open_[hit]] = self.before[level] + self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return found


class Part:
    """One part of the index: the perfect hash and, by number, fingerprint and place."""

    NAMES = ("print", "shard", "offset", "n", "start")

    def __init__(self, hashed: PerfectHash, values: dict[str, np.ndarray]):
        self.hashed, self.values = hashed, values

    @classmethod
    def build(cls, hashes: np.ndarray, values: dict[str, np.ndarray]) -> Part:
        hashed = PerfectHash.build(hashes)
        order = np.empty(len(hashes), np.int64)
        order[hashed.number(hashes)] = np.arange(len(hashes))
        return cls(hashed, {k: v[order] for k, v in values.items()})

    def dump(self) -> bytes:
        out = io.BytesIO()
        packed = {f"level{i}": np.packbits(b) for i, b in enumerate(self.hashed.bits)}
        np.savez(out, sizes=np.array([len(b) for b in self.hashed.bits], np.int64), **packed, **self.values)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Part:
        z = np.load(io.BytesIO(data))
        bits = [np.unpackbits(z[f"level{i}"], count=int(s)) for i, s in enumerate(z["sizes"])]
        return cls(PerfectHash(bits), {k: z[k] for k in cls.NAMES})

    def look_up(self, hashes: np.ndarray, prints: np.ndarray) -> dict[str, np.ndarray]:
        """Places of the keys; ``shard`` is -1 where the fingerprint says the key is not here."""
        if not len(self.values["print"]):
            return {k: np.full(len(hashes), -1, np.int64) for k in self.NAMES}
        at = self.hashed.number(hashes)
        known = (at >= 0) & (self.values["print"][at] == prints)
        return {k: np.where(known, v[at], -1) for k, v in self.values.items()}


def _hashed(df: DataFrame, parts: int) -> DataFrame:
    """Hash and fingerprint of the index key: the key and which of its equals it is."""
    key = F.struct("key", "copy")
    return df.withColumns({"hash": F.xxhash64(key), "print": F.hash(key)}).withColumn("part", F.pmod("hash", F.lit(parts)).cast("int"))


def write(docs: DataFrame, folder: str, path: str, end_id: int | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards and the index; return one row per document: key, copy, shard, offset, n, start.

    ``key`` is an integer column; rows are in ascending order of it, nulls first, equal keys by
    text, and ``copy`` numbers equal keys from 0, so repeated rows are all stored. Null and empty
    texts hold the end id alone (nothing if it is None); an empty table makes empty folders.
    Only key and text are used, so other columns may have any names. One shuffle of the texts
    by ranges of the key; tasks write whole shards by move, so that a repeated task does no harm.
    """
    spark = docs.sparkSession
    fs, root = place(folder)
    for sub in ("shards", "index"):
        fs.create_dir(f"{root}/{sub}", recursive=True)
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("key"), whole(F.col(f"`{text}`")).alias("text"))
    n = ranges(docs)
    bounds = cuts(docs, key, n)
    schema = "key bigint, copy bigint, shard bigint, offset bigint, n bigint"
    if not bounds:
        return spark.createDataFrame([], f"{schema}, start bigint")
    dealt = slim.withColumn("shard", range_of(key_of("key"), bounds)).repartition(n, "shard").sortWithinPartitions("shard", "key", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(folder)
        encode = _encoder(path)
        tail = b"" if end_id is None else encode.packed(end_id)
        width = len(encode.packed(0))
        shard, out, at, last, copy = None, None, 0, None, 0
        for batch in batches:
            rows: list[tuple] = []
            for k, t, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if out is not None:
                        out.close()
                    shard, out, at, last = s, Stream(fs, f"{root}/shards/{s:08d}.ids"), 0, ()
                copy = copy + 1 if k == last else 0
                last = k
                ids = encode(t) + tail
                out.write(ids)
                rows.append((k, copy, s, at, len(ids) // width))
                at += len(ids) // width
            names = ["key", "copy", "shard", "offset", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names=names)
        if out is not None:
            out.close()

    # Cut: what reads the places must not write the shards again.
    placed = cut(dealt.mapInArrow(shards, schema))
    per_shard = placed.groupBy("shard").agg(F.sum("n").alias("m"))
    bases = per_shard.select("shard", F.expr("sum(m) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - m").alias("base"))
    full = placed.join(bases, "shard").select("key", "copy", "shard", "offset", "n", (F.col("base") + F.col("offset")).alias("start"))
    _index(full, folder, max(n // 4, -(-placed.count() // KEYS_A_PART)))
    return full


def _index(placed: DataFrame, folder: str, parts: int) -> None:
    """Build every part in a task of its own and note their number."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        fs, root = place(folder)
        values = {k: rows[k].to_numpy() for k in ("print", "shard", "offset", "n", "start")}
        part = Part.build(rows["hash"].to_numpy().view(np.uint64), values)
        put(fs, f"{root}/index/{key[0].as_py():06d}.mph", part.dump())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([rows.num_rows], pa.int64())})

    built = _hashed(placed, parts).groupBy("part").applyInArrow(build, "part int, keys bigint")
    built.agg(F.sum("keys")).collect()
    fs, root = place(folder)
    put(fs, f"{root}/index/parts", b"%d" % parts)


def read(spark: SparkSession, folder: str, path: str, keys: DataFrame) -> DataFrame:
    """Look ``keys`` (key, copy) up and read their ids from the shards.

    Returns key, copy, start, ids (array of long); keys that the index does not hold are left
    out. Keys meet the index part by part, then the shards shard by shard.
    """
    return _read(spark, folder, path, keys, "ids array<bigint>", lambda ids: ids.astype(np.int64), pa.list_(pa.int64()))


def read_checksums(spark: SparkSession, folder: str, path: str, keys: DataFrame) -> DataFrame:
    """As :func:`read`, with the number of ids and the CRC-32 of them as 4-byte integers."""
    return _read(spark, folder, path, keys, "ids_crc32 bigint", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _read(spark: SparkSession, folder: str, path: str, keys: DataFrame, column: str, made, kind: pa.DataType) -> DataFrame:
    fs, root = place(folder)
    if fs.get_file_info(f"{root}/index/parts").type == pafs.FileType.NotFound:
        return spark.createDataFrame([], f"key bigint, copy bigint, start bigint, n bigint, {column}")
    parts = int(get(fs, f"{root}/index/parts"))
    width = len(_encoder(path).packed(0))
    name = column.split()[0]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(folder)
        at, part = None, None
        for batch in batches:
            hashes = batch["hash"].to_numpy().view(np.uint64)
            prints, which = batch["print"].to_numpy(), batch["part"].to_numpy()
            for p in np.unique(which):
                if p != at:
                    at, part = p, Part.load(get(fs, f"{root}/index/{p:06d}.mph"))
                here = which == p
                found = part.look_up(hashes[here], prints[here])
                kept = found["shard"] >= 0
                rows = batch.filter(pa.array(here)).filter(pa.array(kept)).select(["key", "copy"])
                places = [pa.array(found[k][kept], pa.int64()) for k in ("shard", "offset", "n", "start")]
                yield pa.RecordBatch.from_arrays([*rows.columns, *places], names=["key", "copy", "shard", "offset", "n", "start"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(folder)
        for batch in batches:
            out = []
            shards, offsets, sizes = (batch[c].to_numpy() for c in ("shard", "offset", "n"))
            for shard in np.unique(shards):
                here = shards == shard
                with fs.open_input_file(f"{root}/shards/{shard:08d}.ids") as f:
                    out += [made(np.frombuffer(d, f"<u{width}")) for d in slices(f, offsets[here] * width, sizes[here] * width)]
            yield pa.RecordBatch.from_arrays([*batch.select(["key", "copy", "start", "n"]).columns, pa.array(out, kind)], names=["key", "copy", "start", "n", name])

    asked = _hashed(keys.select(F.col("key").cast("long"), F.col("copy").cast("long")), parts)
    asked = asked.repartition("part").sortWithinPartitions("part")
    placed = asked.mapInArrow(find, "key bigint, copy bigint, shard bigint, offset bigint, n bigint, start bigint")
    by_shard = placed.repartition("shard").sortWithinPartitions("shard", "offset")
    return by_shard.mapInArrow(fetch, f"key bigint, copy bigint, start bigint, n bigint, {column}")
