"""Memoised encoding of texts cut where a tokenizer provably starts anew.

The byte-level pre-token pattern starts a pre-token at every plain space that is followed by a
character other than white space: a run of white space gives up its last character only to such
a pre-token, and no other alternative reaches over a space. A text may therefore be cut before
such spaces and its pieces encoded by themselves. The same holds of a vocabulary that drops white
space. Words repeat, so every piece is encoded once per worker and remembered, within a bound.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

# A letter of these ranges is a letter in every Unicode version that a tokenizer may follow.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"([{_LETTERS}]+)([.,]*)(?:(\n)([{_LETTERS}]+)([.,]*))?")
_CUT = re.compile(r" (?=\S)")

MEMO = 400_000


class Memo(dict):
    """Remembers ``make(key)`` of at most ``limit`` keys; a full memo starts again."""

    def __init__(self, make: Callable, limit: int = MEMO):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


def units(text: str) -> list[str]:
    """Cut before every space that is followed by other than white space; the space is dropped.

    All units but the first stand for a space and themselves.
    """
    parts = text.split(" ")
    # A space before other white space, or at the end, is no cut.
    return _CUT.split(text) if "" in parts or any(map(str.isspace, [p[0] for p in parts])) else parts


def pieces(unit: str) -> Iterator[str] | None:
    """Pre-tokens of a unit of plain letters, stops and one line end; None for any other unit."""
    found = _PLAIN.fullmatch(unit)
    return filter(None, found.groups()) if found else None


def parted(unit: str) -> tuple[str, str, str, str] | None:
    """Word, stops, line end and what follows it, of a unit that :func:`pieces` parts; None for any other."""
    found = _PLAIN.fullmatch(unit)
    if found is None:
        return None
    word, stops, line, *after = found.groups("")
    return word, stops, line, "".join(after)


def segments(text: str, specials: list[str]) -> list[tuple[bool, str]]:
    """The text parted at special strings, as the library parts it before anything else."""
    if not any(s in text for s in specials):
        return [(False, text)]
    parts = re.split("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")", text)
    return [(i % 2 == 1, p) for i, p in enumerate(parts) if p]


def byte_letters() -> dict[int, str]:
    """The published byte alphabet: printable bytes stand for themselves, others follow U+0100."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(same)]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = byte_letters()


def spelled(text: str) -> str:
    """The UTF-8 bytes of a text in the byte alphabet."""
    return text.encode("utf-8").decode("latin-1").translate(_BYTE_LETTERS)
