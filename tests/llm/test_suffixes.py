import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import prose
from tickloom.llm import suffixes as S

NULLS_FIRST = -(2**63)


def brute(spark, rows, length):
    """Every window of every document in order; rows that agree in key and text are one document."""
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted({(NULLS_FIRST if k is None else k, hashes[t or ""], (t or "").encode()) for k, t in rows})
    seen, kept = set(), {}
    for k, h, t in order:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept[k, t] = len(t), len(t) - len(left), spans, left
    return sorted(((k, *kept[NULLS_FIRST if k is None else k, (t or "").encode()]) for k, t in rows), key=str)


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, periodic texts, repeated keys and rows, nulls."""
    draw = random.Random(5)
    passage, line = prose(900, 60), "all rights reserved by the makers of this page and by nobody else in the whole wide world, it says here. " * 1
    out = []
    for i in range(60):
        t = prose(i % 25, 25 + 3 * (i % 25))
        if i % 3 == 0:
            at = draw.randrange(len(t))
            t = t[:at] + passage + t[at:]
        if i % 4 == 0:
            t = f"{t} {line}{prose(700 + i, 9)}"
        if i % 7 == 0:
            at = draw.randrange(len(t))
            t = t[:at] + "é" + t[at + 1 :]
        out.append((3 * i - 11, t))
    out += [(None, out[5][1]), (None, prose(80, 40)), (None, None), (400, ""), (401, None), (402, "short"), (403, "ab" * 400), (404, "x" * 700), (405, "é" * 300)]
    out += [out[8], out[8], (out[9][0], out[3][1]), (out[9][0], prose(81, 50)), (500, prose(82, 3000) + passage + prose(82, 400))]
    return out


@pytest.mark.parametrize(("length", "how", "size"), [(100, {}, S.SLICE), (100, {"hot": 3, "windows": 200, "drawn": 5}, 500), (40, {"hot": 10, "drawn": 20}, 333), (32, {}, S.SLICE)])
def test_rows_equal_brute_force(spark, rows, length, how, size, monkeypatch):
    monkeypatch.setattr(S.blocks, "__defaults__", (size,))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in S.without_repeats(docs, length, **how).collect()]
    assert sorted(got, key=str) == brute(spark, rows, length)


def test_digests_empty_tables_and_clashing_names(spark, docs, empty, rows):
    clashing = docs.withColumnRenamed("lang", "key").withColumnRenamed("source", "th")
    got = S.without_repeats(clashing, digest=True).collect()
    wanted = [(k, n, gone, spans, hashlib.sha256(left).hexdigest()) for k, n, gone, spans, left in brute(spark, [(r["doc_id"], r["text"]) for r in docs.collect()], 100)]
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    assert S.without_repeats(empty).collect() == []


def test_multikey_quicksort_sorts_stably():
    draw = random.Random(1)
    text = bytes(draw.choice(b"ab") for _ in range(3000))
    for length in (32, 41, 100):
        at = np.array([draw.randrange(len(text) - length) for _ in range(1500)])
        padded = np.frombuffer(text + bytes(8), np.uint8)
        digits = np.zeros(len(text) + 1, np.uint64)
        for i in range(8):
            digits = (digits << np.uint64(8)) | padded[i : i + len(digits)]
        order = np.arange(len(at))
        S.multikey_quicksort(order, at, digits, text, length, small=4)
        assert order.tolist() == sorted(range(len(at)), key=lambda i: (text[at[i] : at[i] + length], i))


def test_grams_depend_on_their_bytes_alone():
    data = np.frombuffer(b"abcdefgh" * 30, np.uint8)
    for k in (1, 7, 32, 100):
        g = S.grams(data, k, S._BASES[0])
        assert len(g) == len(data) - k + 1 and (g[:-8] == g[8:]).all() and len(set(g.tolist())) == min(8, len(g))


def test_ends_of_ranges_settle_runs_over_many(spark):
    """One block in every row, then tokens that run over boundaries, against marks without boundaries."""
    draw = random.Random(3)
    rows = sorted({(draw.randrange(4), draw.randrange(3), draw.randrange(50), 0, draw.randrange(9)) for _ in range(250)})
    schema = f"bucket int, {S.BLOCK}"
    import tempfile

    def found(splitters):
        dealt = [(sum(s <= r for s in splitters), *r, 1) for r in rows]
        folder = tempfile.mkdtemp() + "/m"
        marked = list(map(tuple, S.marks(spark.createDataFrame(dealt, schema), splitters, folder).collect()))
        copies = {m[1:] for m in marked if m[0] == S.COPY}
        # A copy that starts a range may be held for contested as well: its windows are then compared besides.
        return sorted(m for m in marked if m[0] == S.COPY or m[1:] not in copies)

    alone = found([])
    assert alone and found(rows[::7]) == alone and found(rows[::2]) == alone and found(rows) == alone
