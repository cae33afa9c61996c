import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import duckdb
import pytest

from tests.llm.conftest import prose
from tickloom.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_grams_equal_their_definition_whatever_the_chunks(texts, size, n):
    for text in texts[:40]:
        got = Counter(c for level in I.grams((text or "").encode(), n, size) for c in level)
        assert got == Counter(crc32(f.encode()) for f in features(text, n)[1])


def brute(rows, targets, percent, n, buckets, least, seed):
    raw, target = Counter(), Counter()
    for counted, texts in ((raw, [t for _, t in rows]), (target, targets)):
        for t in texts:
            counted.update(crc32(f.encode()) % buckets for f in features(t, n)[1])
    s_all, t_all = sum(raw.values()) + buckets, sum(target.values()) + buckets
    gain = [math.floor(1000 * math.log((target[b] + 1) * s_all / ((raw[b] + 1) * t_all))) for b in range(buckets)]
    out = []
    for key, t in rows:
        words, found = features(t, n)
        weight = sum(gain[crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for i, r in enumerate(fit[: len(fit) * percent // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=str)


def test_draw_equals_brute_force(spark, docs, empty):
    targets = [prose(500 + i, 60) for i in range(5)] + [None, ""]
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for percent, buckets in ((25, 10_000), (100, 50)):
        got = I.resample(docs, target, percent=percent, buckets=buckets).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, targets, percent, 2, buckets, 20, 7)
    assert I.resample(empty, target).collect() == []
    none = I.resample(docs.where("doc_id = -20"), target.where("false")).collect()
    assert [r["rank"] for r in none] == [None]  # a quarter of one document is none


def test_equal_rows_are_numbered_in_many_ranges(spark):
    same = spark.range(0, 5000, 1, 8).selectExpr("7L as score")
    rows = I.ranked(same, same.score.desc()).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 5001))


def test_sql_agrees(spark, docs, tmp_path):
    shown = docs.where("doc_id is not null").distinct()
    con = duckdb.connect()
    for name, df in (("documents", shown), ("benchmark", shown.selectExpr("doc_id as item_id", "text").where("doc_id % 3 = 0"))):
        con.register(name, df.toPandas())
    target = shown.where("doc_id % 3 = 0")
    got = I.resample(shown, target).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(I.SQL).fetchall(), key=str)


def test_clashing_names(docs):
    rows = I.weighed(docs.withColumnRenamed("lang", "weight").withColumnRenamed("source", "n_words"), [1] * 10).collect()
    assert len(rows) == docs.count() and set(rows[0].asDict()) == {"doc_id", "n_chars", "n_words", "n_features", "weight"}
