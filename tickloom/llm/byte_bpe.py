"""Byte-level BPE encoding and decoding through a serialised sentencepiece model (operator 3)."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.pretokens import MEMO, Memo, byte_letters, pieces, spelled, units


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: base64 and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def serialised(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the vocabulary.

    Pieces are the tokens in the byte alphabet, in order of rank, scored by negative rank, so the
    best-scored merge is the lowest-ranked one. Normalisation is the identity and white space is
    left alone. The unknown piece that the library asks for comes last, spelled with a character
    outside the byte alphabet; all 256 bytes are in the vocabulary, so it is never produced.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    letters = byte_letters()
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        model.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    unknown = "⁇unk"
    model.pieces.add(piece=unknown, score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size = pb.TrainerSpec.BPE, len(model.pieces)
    spec.unk_id, spec.unk_piece, spec.bos_id, spec.eos_id, spec.pad_id = len(ranks), unknown, -1, -1, -1
    form = model.normalizer_spec
    form.name, form.add_dummy_prefix, form.remove_extra_whitespaces, form.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Table:
    """Byte strings by id, laid end to end, so that whole id arrays are spelled at once."""

    def __init__(self, values: list[bytes]):
        self.flat = np.frombuffer(b"".join(values), np.uint8)
        self.sizes = np.array([len(v) for v in values], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def spell(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.begins[ids] - ends + sizes, sizes)
        return self.flat[at].tobytes()


class ByteBpe:
    """Encodes texts match by match of the pre-token pattern; decodes ids by inverse mapping."""

    def __init__(self, path: str, pattern: str, memo: int = MEMO):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        by_rank = sorted(self.ranks.items(), key=lambda item: item[1])
        self.ids = [rank for _, rank in by_rank]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(self.ranks))
        self.pattern = regex.compile(pattern)
        token = [b""] * (self.ids[-1] + 1)
        for t, rank in by_rank:
            token[rank] = t
        self.bytes = Table(token)
        self.decimals = Table([b"%d " % i for i in range(len(token))])
        self.piece = Memo(self._piece, memo)
        self.first = Memo(self._unit, memo // 8)
        self.rest = Memo(lambda unit: self._unit(" " + unit), memo)

    def _piece(self, piece: str) -> bytes:
        """One match of the pattern: a whole token, or the merges of its letters."""
        rank = self.ranks.get(piece.encode("utf-8"))
        found = [rank] if rank is not None else [self.ids[i] for i in self.model.encode(spelled(piece))]
        return array("I", found).tobytes()

    def _unit(self, unit: str) -> bytes:
        plain = pieces(unit.removeprefix(" "))
        if plain is None:
            return b"".join(self.piece[m.group()] for m in self.pattern.finditer(unit))
        first, *others = plain
        return b"".join([self.piece[" " * unit.startswith(" ") + first], *map(self.piece.__getitem__, others)])

    def encode(self, text: str) -> np.ndarray:
        first, *others = units(text)
        return np.frombuffer(self.first[first] + b"".join(map(self.rest.__getitem__, others)), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes.spell(ids)

    def written(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        return self.decimals.spell(ids)[:-1]


@lru_cache(maxsize=2)
def _bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", carry: list[str] | None = None, ids: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``n_tokens`` and digests of the ids and the decoded bytes.

    Every text is encoded whole and decoded again; ``ids_sha256`` is over the decimal ids joined
    by one space, ``decoded_sha256`` over the decoded bytes, which are the text's own UTF-8.
    ``carry`` names the columns to return beside them (all by default), ``ids=False`` leaves the
    ids out. Null and empty texts have no ids; repeated rows are encoded each; an empty table
    stays empty; input columns named like new ones are replaced. No shuffle, one batch at a time.
    """
    made = {"ids": "array<int>"} if ids else {}
    made |= {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), *(f"{n} {t}" for n, t in made.items())])
    sent = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in made}
            for t in batch.column(len(carry)).to_pylist():
                found = bpe.encode(t or "")
                if ids:
                    out["ids"].append(found.astype(np.int32))
                out["n_tokens"].append(len(found))
                out["ids_sha256"].append(hashlib.sha256(bpe.written(found)).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(found)).hexdigest())
            kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
            arrays = [pa.array(v, kinds.get(n, pa.string())) for n, v in out.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *arrays], names=[*carry, *made])

    return sent.mapInArrow(run, schema)
