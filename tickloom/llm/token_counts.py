"""Token counts with overlap resynchronisation of huge documents (operator 9)."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.pretokens import MEMO, Memo, pieces, segments, spelled, units


class Counter:
    """Counts tokens of whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    Texts up to ``huge`` code points are counted unit by unit (see :mod:`pretokens`). Longer ones
    are encoded in chunks that overlap, with offsets, and spliced at stable boundaries. Only for
    vocabularies that part words at white space and drop it.
    """

    def __init__(self, path: str, huge: int, chunk: int, overlap: int, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self.per_piece = Memo(lambda p: len(self.tokenizer.model.tokenize(spelled(p.lower()))), memo)
        self.per_unit = Memo(self._unit, memo)

    def _unit(self, unit: str) -> int:
        plain = pieces(unit)
        if plain is None:
            return len(self.tokenizer.encode(unit, add_special_tokens=False).ids)
        return sum(self.per_piece[p] for p in plain if p != "\n")

    def __call__(self, text: str) -> int:
        total = 0
        for special, part in segments(text, self.specials):
            if special:
                total += 1
            elif len(part) > self.huge:
                total += self.spliced(part)
            else:
                total += sum(map(self.per_unit.__getitem__, units(part)))
        return total

    def _starts(self, text: str, at: int, end: int) -> list[int]:
        """Where the tokens of ``text[at:end]`` begin, as positions of the whole text."""
        found = self.tokenizer.encode(text[at:end], add_special_tokens=False).offsets
        return [at + a for a, _ in found]

    def spliced(self, text: str) -> int:
        """Tokens of a text from overlapping chunks.

        A boundary is stable where white space ends and both chunks start a token: what follows
        white space is parted the same whatever came before it, so left of the boundary the left
        chunk is exact and right of it the right one. Where the overlap holds no such boundary,
        or the chunks disagree on a token up to the last word that both hold whole, the overlap
        is doubled; at the worst the left chunk takes the rest of the text.
        """
        total, begin, at = 0, 0, 0
        while True:
            overlap, ahead = self.overlap, at + self.chunk
            while True:
                end = min(len(text), ahead + overlap)
                left = [p for p in self._starts(text, at, end) if p >= begin]
                if end == len(text):
                    return total + len(left)
                cut = self._stable(text, left, ahead, end)
                if cut is not None:
                    break
                overlap *= 2
            total += sum(p < cut for p in left)
            begin, at = cut, ahead

    def _stable(self, text: str, left: list[int], ahead: int, end: int) -> int | None:
        """The first boundary of ``ahead .. end`` that both encodings share and agree after."""
        edge = end  # the last word may be cut off
        while edge > ahead and not text[edge - 1].isspace():
            edge -= 1
        starts = set(left)
        right = [p for p in self._starts(text, ahead, end) if p < edge]
        for cut in right:
            if cut > ahead and text[cut - 1] in " \n\t" and not text[cut].isspace() and cut in starts:
                same = [p for p in left if cut <= p < edge] == [p for p in right if p >= cut]
                return cut if same else None
        return None


@lru_cache(maxsize=2)
def _counter(path: str, huge: int, chunk: int, overlap: int) -> Counter:
    return Counter(path, huge, chunk, overlap)


def count_tokens(
    docs: DataFrame,
    path: str,
    text: str = "text",
    into: str = "n_tokens",
    carry: list[str] | None = None,
    huge: int = 32_768,
    chunk: int = 16_384,
    overlap: int = 512,
) -> DataFrame:
    """``docs`` with the number of tokens of ``text`` in a new long column ``into``.

    ``carry`` names the columns to return beside it (all by default), so that texts need not
    travel back. Null and empty texts have 0 tokens; repeated rows are counted each; an empty
    table stays empty; a column already named ``into`` is replaced and other names may be
    anything. Nothing is shuffled: a task streams Arrow batches, holding one batch and a bounded
    memo, and a lost task is simply run again.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c != into]
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry) + f"`{into}` bigint"
    sent = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path, huge, chunk, overlap)
        for batch in batches:
            found = [count(t) if t else 0 for t in batch.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(found, pa.int64())], names=[*carry, into])

    return sent.mapInArrow(run, schema)
