import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickloom.llm import token_alignment as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@given(st.lists(st.tuples(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60))), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_cuts_are_the_shared_ends(stretches):
    """Stretches of 70 bytes laid end to end, whose last ends are known to be shared."""
    a, b = ([70 * i + e for i, pair in enumerate(stretches) for e in [*sorted(pair[side]), 70]] for side in (0, 1))
    last = [np.array([side.index(70 * i + 70) for i in range(len(stretches))]) for side in (a, b)]
    in_a, in_b = T.cuts(np.array(a), np.array(b), *last)
    assert in_a.tolist() == [e in b for e in a] and in_b.tolist() == [e in a for e in b]


@pytest.fixture(scope="module")
def libraries():
    """Whole texts by the libraries, and groups by a walk along both."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: n for n, c in T.byte_letters().items()}

    def groups(text):
        if not text:
            return []
        left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        if not b"".join(t for _, t in left) == b"".join(t for _, t in right) == (" " + text).encode():
            return []
        out, x, y, p, q, group = [], 0, 0, 0, 0, ([], [])
        while x < len(left) or y < len(right):
            if p <= q and x < len(left):
                group[0].append(left[x][0])
                p, x = p + len(left[x][1]), x + 1
            else:
                group[1].append(right[y][0])
                q, y = q + len(right[y][1]), y + 1
            if p == q:
                out.append(group)
                group = ([], [])
        return out

    return groups


def brute(rows, groups):
    per = [(key, groups(t)) for key, t in rows]
    linked = [Counter((x, y) for left, right in found for x in left for y in right) for _, found in per]
    count = Counter(p for links in linked for p in links)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (key, found), links in zip(per, linked, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found)
        sizes = [sum(len(g[0]) for g in found), sum(len(g[1]) for g in found), len(found), sum(links.values())]
        best = sum(n for p, n in links.items() if count[p] == most[p[0]])
        total = sum(n * count[p] for p, n in links.items())
        out.append((key, *sizes, best, total, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


ODD = [" lead", "trail ", "trail  ", " ", "   ", "a \n b", "a\n b", "a  b  c", "x▁y", "▁", "a\u3000 b", "tab\t x", "\r\n x {\r", "{\r }\r", "a\x1c b", "\u180e x\u180e y", "\x00 \x00a", "<0x41> <s> <unk> </s>", "ＡＢＣ ﬁ", "é ́", "🙂 🙂🙂", "ab" * 3000, "語 " * 50]


def test_rows_equal_brute_force(spark, docs, empty, libraries):
    more = spark.createDataFrame([(1000 + i, t, "en", "s", 0) for i, t in enumerate(ODD)], docs.schema)
    every = docs.unionByName(more)
    got = T.alignment(every, A, B).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r["doc_id"], r["text"]) for r in every.collect()], libraries)
    assert T.alignment(empty, A, B).collect() == []


def test_small_memos_and_join_without_broadcast(spark, docs, libraries, monkeypatch):
    monkeypatch.setattr("tickloom.session.BROADCAST_ROWS", 0)
    monkeypatch.setattr(T, "BYTES", 300)
    part = docs.limit(15).withColumnRenamed("lang", "n_a").withColumnRenamed("source", "pairs").cache()
    got = T.alignment(part, A, B).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r["doc_id"], r["text"]) for r in part.collect()], libraries)
    monkeypatch.setattr(T, "WIDE", 3)
    few, many = T.Aligner(A, B, memo=3), T._aligner(A, B)
    for t in ODD * 2:
        (x,), (y,) = few([t]), many([t])
        assert x[:2] == y[:2] and len(x[2]) == len(y[2]) and (x[2] == y[2]).all() and (x[3] == y[3]).all()


@given(st.text(alphabet="ab .,\n\t\r ▁é語'1{", max_size=30))
@settings(max_examples=400, deadline=None)
def test_units_do_not_change_tokens(libraries, text):
    found = libraries(text)
    written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found)
    assert next(T._aligner(A, B)([text]))[1] == written
