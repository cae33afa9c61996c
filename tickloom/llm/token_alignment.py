"""Alignment of two tokenizers' tokens over the same bytes (operator 11).

Divide and conquer at shared cuts: a common token end near the middle of an interval is located by
bisection and both halves are aligned in turn; an interval without a cut inside is a group.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.byte_bpe import Table
from tickloom.llm.common import scratch
from tickloom.llm.pretokens import byte_letters
from tickloom.session import sided

# Characters that some engine takes for white space; no text is cut behind them.
_SPACES = r"\s\x1c-\x1f\x85\u180e\u200b\ufeff"

#: Links of a group up to which they are listed one by one.
WIDE = 4_096
#: Bytes of text whose new units are encoded together.
BYTES = 2_000_000


def cuts(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ends of two ascending lists the other one shares.

    ``last_a`` and ``last_b`` are the places of ends known to be shared, which part the lists into
    intervals. All intervals are halved side by side, round by round: the end of ``a`` nearest to
    the middle of an interval that bisection finds in ``b`` as well is a cut, and both sides of it
    go into the next round; an interval without one is a group.
    """
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    in_a[last_a] = in_b[last_b] = True
    # Ends i..j-1 of a and k..l-1 of b lie inside an interval.
    i, k = np.insert(last_a[:-1] + 1, 0, 0)[: len(last_a)], np.insert(last_b[:-1] + 1, 0, 0)[: len(last_b)]
    j, l = last_a, last_b  # noqa: E741
    while True:
        inside = (i < j) & (k < l)
        i, j, k, l = i[inside], j[inside], k[inside], l[inside]  # noqa: E741
        if not len(i):
            return in_a, in_b
        found_a, found_b = np.full(len(i), -1), np.full(len(i), -1)
        middle, open_, step = (i + j) // 2, np.arange(len(i)), 0
        while len(open_):
            for x in (middle[open_] + step, middle[open_] - step):
                valid = (found_a[open_] < 0) & (x >= i[open_]) & (x < j[open_])
                at, x = open_[valid], x[valid]
                y = np.searchsorted(b, a[x])
                hit = b[y] == a[x]
                found_a[at[hit]], found_b[at[hit]] = x[hit], y[hit]
            step += 1
            open_ = open_[(found_a[open_] < 0) & ((middle[open_] + step < j[open_]) | (middle[open_] - step >= i[open_]))]
        cut = found_a >= 0
        x, y = found_a[cut], found_b[cut]
        in_a[x] = in_b[y] = True
        i, j = np.concatenate([i[cut], x + 1]), np.concatenate([x, j[cut]])
        k, l = np.concatenate([k[cut], y + 1]), np.concatenate([y, l[cut]])  # noqa: E741


class Aligner:
    """Tokens of a text by a byte-level BPE (A) and by a sentencepiece BPE (B), aligned.

    A text is cut where a space follows other than white space: both vocabularies provably start
    anew there (no pre-token of A and no piece of B reaches over such a space; the latter is
    checked when the model is read), so these are shared cuts known beforehand. What lies between
    them, a unit, is encoded and aligned once a worker and remembered, within a bound; units that
    are new to a batch of texts are encoded together.
    """

    def __init__(self, byte_path: str, piece_path: str, memo: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        values = {c: b for b, c in byte_letters().items()}
        size = self.a.get_vocab_size(with_added_tokens=True)
        model = pb.ModelProto()
        with open(piece_path, "rb") as stored:
            model.ParseFromString(stored.read())
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        byte = pb.ModelProto.SentencePiece.BYTE
        pieces = [bytes([int(p.piece[3:5], 16)]) if p.type == byte else p.piece.replace("▁", " ").encode() for p in model.pieces]
        self.bytes = Table([bytes(values[c] for c in self.a.id_to_token(i)) for i in range(size)]), Table(pieces)
        self.width, self.ids = len(model.pieces), max(size, len(pieces))
        # Ids followed by a comma, by what ends A's tokens of a group, and by what ends the group.
        self.decimals = Table([b"%d%c" % (i, mark) for mark in b",|;" for i in range(self.ids)])
        self.crossing = any("▁" in p.piece.lstrip("▁") for p in model.pieces)
        self.odd = re.compile(rf"[{_SPACES}] |^ | \Z")
        self.open = re.compile(rf"(?:^|[{_SPACES}])\Z")
        self.memo = memo
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.written: list[str] = []
        self.held = 0
        # Tokens of A, of B, groups and links of every unit (A's are negative where bytes differ); where its pairs begin.
        self.sizes, self.begins = np.zeros((0, 4), np.int64), np.zeros(1, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def units(self, text: str) -> list[str]:
        """The text in pieces that each stand for a space and themselves."""
        if self.crossing:
            return [text]
        parts = text.split(" ")
        if not self.odd.search(text):
            return parts
        held: list[list[str]] = [[parts[0]]]
        for part, last in zip(parts[1:], parts, strict=False):
            if self.open.search(last):
                held[-1].append(part)
            else:
                held.append([part])
        whole = [" ".join(h) for h in held]
        # Spaces alone at the end stay with what they follow: B gives the empty text no tokens.
        if len(whole) > 1 and not whole[-1].strip(" "):
            whole[-2:] = [f"{whole[-2]} {whole[-1]}"]
        return whole

    def learn(self, new: list[str]) -> None:
        """Encode and align units together, and remember them."""
        n, first = len(new), len(self.written)
        ids = [e.ids for e in self.a.encode_batch_fast([" " + u for u in new], add_special_tokens=False)], self.b.encode(new, num_threads=1)
        raw = [f" {u}".encode() for u in new]
        sizes = np.array(list(map(len, raw)))
        sides = []
        for table, side in zip(self.bytes, ids, strict=True):
            unit = np.repeat(np.arange(n), list(map(len, side)))
            flat = np.fromiter(chain.from_iterable(side), np.int64, len(unit))
            sides.append((table, flat, unit, np.bincount(unit, table.sizes[flat], n)))
        good = (sides[0][3] == sizes) & (sides[1][3] == sizes)
        text = np.frombuffer(b"".join([r for r, g in zip(raw, good, strict=True) if g]), np.uint8)
        of_byte = np.repeat(np.flatnonzero(good), sizes[good])
        for table, flat, unit, _ in sides:
            spelled = np.frombuffer(table.spell(flat[good[unit]]), np.uint8)
            good[of_byte[spelled != text]] = False
        # Tokens of good units, and the places of the last one of each unit.
        (a, ua), (b, ub) = ((flat[good[unit]], unit[good[unit]]) for _, flat, unit, _ in sides)
        last = [np.flatnonzero(np.diff(u, append=-1)) for u in (ua, ub)]
        cut_a, cut_b = cuts(np.cumsum(self.bytes[0].sizes[a]), np.cumsum(self.bytes[1].sizes[b]), *last)
        ga, gb = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        unit = ua[cut_a]
        ca, cb = np.bincount(ga, minlength=len(unit)), np.bincount(gb, minlength=len(unit))
        begin_a, begin_b = np.cumsum(ca) - ca, np.cumsum(cb) - cb
        # Written group by group, A's tokens before B's: an id and what follows it is one entry of a table.
        stream, of_unit = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        for at, side, u, cut, mark in ((np.arange(len(a)) + begin_b[ga], a, ua, cut_a, 1), (np.arange(len(b)) + (begin_a + ca)[gb], b, ub, cut_b, 2)):
            stream[at], of_unit[at] = side + np.where(cut, mark, 0) * self.ids, u
        ends = np.cumsum(np.bincount(of_unit, self.decimals.sizes[stream], n)).astype(int).tolist()
        written = self.decimals.spell(stream).decode()
        self.written += [written[x : max(x, y - 1)] for x, y in zip([0, *ends], ends, strict=False)]
        self.held += len(written) + int(sizes.sum())
        pairs, times, owner = self._pairs(a, b, ca, cb, begin_a, begin_b, unit)
        told = np.stack([np.bincount(u, minlength=n) for u in (ua, ub, unit)] + [np.bincount(unit, ca * cb, n).astype(np.int64)], axis=1)
        told[~good, 0] = -1
        self.index.update(zip(new, range(first, first + n), strict=True))
        self.sizes = np.concatenate([self.sizes, told])
        self.begins = np.append(self.begins, len(self.pairs) + np.cumsum(np.bincount(owner, minlength=n)))
        self.pairs, self.times = np.append(self.pairs, pairs), np.append(self.times, times)

    def _pairs(self, a, b, ca, cb, begin_a, begin_b, unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``pairs, how often each is linked, its unit``, in order of units."""
        n = ca * cb
        few = np.flatnonzero(n <= WIDE)
        group = np.repeat(few, n[few])
        r = np.arange(len(group)) - np.repeat(np.cumsum(n[few]) - n[few], n[few])
        pairs = a[begin_a[group] + r // cb[group]] * self.width + b[begin_b[group] + r % cb[group]]
        out = [(pairs, np.ones(len(pairs), np.int64), unit[group])]
        # Ids that repeat within a wide group make one pair: no more of them than there are ids.
        for g in np.flatnonzero(n > WIDE):
            (x, m), (y, k) = (np.unique(side[at : at + size], return_counts=True) for side, at, size in ((a, begin_a[g], ca[g]), (b, begin_b[g], cb[g])))
            out.append(((x[:, None] * self.width + y).ravel(), (m[:, None] * k).ravel(), np.full(len(x) * len(y), unit[g])))
        pairs, times, owner = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.argsort(owner, kind="stable")
        return pairs[order], times[order], owner[order]

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray]]:
        """``(tokens of A, of B, groups, links), groups written out, pairs, links of each pair`` of every text."""
        if len(self.written) > self.memo or self.held > 200 * self.memo:
            self.forget()
        parted = [self.units(t) if t else [] for t in texts]
        new = {u for units in parted for u in units}.difference(self.index)
        if new:
            self.learn(list(new))
        nothing = (0, 0, 0, 0), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        for units in parted:
            at = list(map(self.index.__getitem__, units))
            unit, count = np.unique(np.array(at, np.int64), return_counts=True)
            sizes = self.sizes[unit]
            if not at or (sizes[:, 0] < 0).any():
                yield nothing
                continue
            n = self.begins[unit + 1] - self.begins[unit]
            where = np.arange(n.sum()) + np.repeat(self.begins[unit] - np.cumsum(n) + n, n)
            pair, inverse = np.unique(self.pairs[where], return_inverse=True)
            links = np.zeros(len(pair), np.int64)
            np.add.at(links, inverse, self.times[where] * np.repeat(count, n))
            yield tuple((sizes * count[:, None]).sum(0).tolist()), ";".join(map(self.written.__getitem__, at)), pair, links


@lru_cache(maxsize=2)
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about ``limit`` bytes, or one row."""
    start, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield start, at
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def aligned(docs: DataFrame, byte_path: str, piece_path: str, carry: list[str], text: str = "text") -> DataFrame:
    """``carry``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` and the linked pairs of every document.

    ``pairs`` are ``a * size of B's vocabulary + b``, ascending, ``links`` how often each is linked.
    No shuffle; batches are cut by what they hold.
    """
    made = {n: "bigint" for n in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": "string", "pairs": "array<int>", "links": "array<bigint>"}
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), *(f"{n} {t}" for n, t in made.items())])
    sent = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(byte_path, piece_path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(len(carry))), 0).to_numpy()
            for start, end in _slices(sizes, BYTES):
                part = batch.slice(start, end - start)
                out = [(*totals, hashlib.sha256(w.encode()).hexdigest() if w else "", p.astype(np.int32), n) for totals, w, p, n in align(part.column(len(carry)).to_pylist())]
                kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *arrays], names=[*carry, *made])

    return sent.mapInArrow(run, schema)


def alignment(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: sizes and digest of its alignment, and how its links stand in the corpus.

    ``n_best`` counts the links whose pair of ids is, of all pairs with that id of A, linked in the
    most documents (ties included); ``count_sum`` adds up, over links, how many documents hold the
    pair linked. Null and empty texts, and texts that the two tokenizers do not spell alike, have
    zeros and an empty digest. Repeated rows are documents of their own, a null key is a key like
    any other, an empty table stays empty, other columns are not read.

    Texts are encoded once; what they link is written to the shared folder and counted with
    map-side combine. Only pairs of two or more documents are looked up: a pair not found has a
    count of 1. That table is counted and broadcast up to a limit, beyond it a sort-merge join;
    the highest count of an id of A is a table no longer than A's vocabulary.
    """
    spark = docs.sparkSession
    width = _aligner(byte_path, piece_path).width
    folder = scratch(spark, "aligned")
    slim = docs.select(F.col(f"`{key}`").cast("bigint").alias("__key"), F.col(f"`{text}`").alias("text"))
    aligned(slim, byte_path, piece_path, ["__key"]).write.parquet(folder)
    rows = spark.read.parquet(folder)
    counted = scratch(spark, "pairs")
    rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).write.parquet(counted)
    counts = spark.read.parquet(counted)
    best = counts.groupBy(F.expr(f"pair div {width}").cast("int").alias("a")).agg(F.max("n").alias("most"))
    common = counts.where("n > 1")
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    linked = numbered.select("__row", F.inline(F.arrays_zip("pairs", "links"))).withColumnsRenamed({"pairs": "pair", "links": "m"})
    linked = linked.withColumn("a", F.expr(f"pair div {width}").cast("int"))
    linked = linked.join(sided(common, common.count()), "pair", "left").join(F.broadcast(best), "a")
    n = F.coalesce("n", F.lit(1))
    sums = linked.groupBy("__row").agg(F.sum(F.when(n == F.col("most"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * n).alias("count_sum"))
    told = numbered.drop("pairs", "links").join(sums, "__row", "left").fillna(0, ["n_best", "count_sum"])
    return told.select(F.col("__key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
