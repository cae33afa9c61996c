import hashlib

import numpy as np

from tests.llm.conftest import prose
from tickloom.llm import order_minhash as O


def test_neighbours_equal_brute_force(docs, empty):
    order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    texts = [r["text"] or "" for r in order]
    wanted = []
    for i, (r, t) in enumerate(zip(order, texts, strict=True)):
        following, half = texts[(i + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b, c = O.sketch(t), O.sketch(edited), O.sketch(following)
        wanted.append((r["doc_id"], len(t), hashlib.sha256(edited.encode()).hexdigest(), O.written(a), O.written(b), O.likeness(a, b), O.likeness(a, c)))
    got = O.against_edits(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    assert O.against_edits(empty).collect() == []
    alone = O.against_edits(docs.where("doc_id = -20")).collect()
    assert [r["near_next"] for r in alone] == [1.0]


def plain(text, k=O.K, size=O.TUPLE, sketches=O.SKETCHES):
    """The elements, bins and orders spelled out: a loop over Python numbers."""
    values = [int(v) for v in O._kmers(text, k)]
    seen, elements = {}, []
    for v in values:
        seen[v] = seen.get(v, -1) + 1
        elements.append(int(O._mix(np.array([(v + seen[v] * int(O._ODD)) % 2**64], np.uint64))[0]))
    out, bits = [], sketches.bit_length() - 1
    for i in range(sketches if elements else 0):
        mine = [p for p, e in enumerate(elements) if e >> (64 - bits) == i]
        if len(mine) >= size:
            rank = {p: elements[p] for p in mine}
        else:
            seed = int(O._mix(np.array([(i + 1) * int(O._ODD) % 2**64], np.uint64))[0])
            rank = {p: int(O._mix(np.array([e ^ seed], np.uint64))[0]) for p, e in enumerate(elements)}
        h = 0
        for p in sorted(sorted(rank, key=rank.get)[:size]):
            h = int(O._mix(np.array([(h * int(O._ODD) + elements[p]) % 2**64], np.uint64))[0])
        out.append(h >> 48)
    return out or [0] * sketches


def test_sketches_equal_their_definition():
    for text in ["", "abc", "aaaa aaaa aaaa aaaa", prose(1, 20), prose(2, 200), prose(3, 700), "ab" * 400]:
        assert O.sketch(text).tolist() == plain(text)


def test_edits_and_moves_lower_likeness_by_degrees():
    text = prose(4, 600)
    half = len(text) // 2
    own = O.sketch(text)
    moved = O.likeness(own, O.sketch(text[half:] + text[:half]))
    few = O.likeness(own, O.sketch("".join("#" if i % 150 == 75 else c for i, c in enumerate(text))))
    other = O.likeness(own, O.sketch(prose(5, 600)))
    assert 1 > few > 0.8 and other < 0.1 and other < moved < few


def test_rows_and_clashing_names(docs):
    rows = O.fingerprints(docs.withColumnRenamed("lang", "fingerprint")).collect()
    assert all(r["fingerprint"] == O.written(O.sketch(r["text"])) for r in rows) and len(rows) == docs.count()
