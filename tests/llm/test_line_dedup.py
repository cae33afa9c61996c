import random

import pytest

from tests.llm import brute
from tests.llm.conftest import SCHEMA, prose
from tickloom.llm import line_dedup


def hold(spark, rows, **names):
    frame = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame).collect()}
    wanted = brute.deduped(rows)
    for (k, t), w in zip(rows, wanted, strict=True):
        lines = len(t.split("\n")) if t is not None else 0
        assert found[k]["text"] == (w if t is not None else None), k
        assert found[k]["n_lines"] == lines
        assert found[k]["n_removed"] == lines - (len(w.split("\n")) if w or t == "" else 0), k


def test_lines_equal_brute_force(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts[:-1]) if t is None or (t.strip() and "\n\n" not in t)]
    hold(spark, rows)


@pytest.mark.parametrize("bucket", [256, 2])
def test_dense_groups_of_near_lines(spark, monkeypatch, bucket):
    """Variants of one long line: leaders, their members and finer keys lose no link."""
    monkeypatch.setattr(line_dedup, "BUCKET", bucket)
    draw, base = random.Random(2), prose(1, 80).replace("\n", " ").split()
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(draw.randrange(3)):
            words[draw.randrange(len(words))] = draw.choice(["x", "something", "another"])
        rows.append((i, " ".join(words) + "\n" + prose(500 + i, 12).replace("\n", " ")))
    hold(spark, rows)


def test_edits_are_counted_with_the_spaces_of_words_put_in(spark):
    """Four edits in 23 would be similar; a word of four letters and its space are five."""
    rows = [(0, "one two three four"), (1, "one two three four four"), (2, "five six seven eight"), (3, "five six seven eight six")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"]: r["text"] for r in found.collect()} == dict(rows) | {3: ""}


def test_long_and_short_lines_have_the_majority_of_their_bits(spark):
    """Lines are counted in parts, equal rows apart; SimHashes are those of all their distinct words."""
    texts = [" ".join(f"w{i}" for i in range(n)) + " w0" for n in (1, 2, 126, 127, 128, 254, 255, 900)]
    docs = spark.createDataFrame(list(enumerate(texts)) * 3, "doc bigint, text string").selectExpr("doc", "xxhash64(text) AS print", "text")
    found = {r["at"]["doc"]: r["sim"] & (2**64 - 1) for r in line_dedup._nodes(line_dedup._lines(docs)).collect()}
    hashes = {r["w"]: r["h"] & (2**64 - 1) for r in spark.range(900).selectExpr("concat('w', id) AS w", "xxhash64(concat('w', id)) AS h").collect()}
    assert found == {i: brute.majority([hashes[w] for w in set(t.split())]) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("a", "b"), [("x one two", "y one two"), ("one", "one two"), ("one two", "two"), ("one three", "one two three"), ("a b c d", "a x c y"), ("a b c", "b c a"), ("ab cd", "ab ce"), ("one two two", "one two")])
def test_bounded_edits_equal_the_distance_or_suffice(spark, a, b):
    rows = spark.range(1, 12).selectExpr("cast(id AS int) AS k", f"'{a}' AS a", f"'{b}' AS b", f"levenshtein('{a}', '{b}') AS d")
    for r in rows.select("k", "d", line_dedup._edits("a", "b", "k").alias("most"), line_dedup._edits("a", "b", "k", "-1").alias("exact")).collect():
        assert r["exact"] == (r["d"] if r["d"] <= r["k"] else -1)
        assert r["most"] == -1 if r["d"] > r["k"] else r["d"] <= r["most"] <= r["k"]


def test_same_words_in_another_order_are_no_copy(spark):
    words = prose(8, 30).replace("\n", " ").split()
    rows = [(0, " ".join(words)), (1, " ".join(reversed(words))), (2, " ".join(words).upper() + " !!"), (3, " ".join(reversed(words)) + ".")]
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {0: rows[0][1], 1: rows[1][1], 2: "", 3: ""}


def test_nulls_repeated_rows_blank_lines_and_clashing_names(spark, empty):
    rows = [(None, "alpha beta\n\n--\nalpha beta", 1), (1, "Alpha, beta\ngamma", 2), (1, "Alpha, beta\ngamma", 3), (2, None, 4), (3, "", 5)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int")
    found = line_dedup.dedup_lines(frame)
    assert found.columns == ["doc_id", "text", "n_lines", "n_removed"]
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted([(None, "alpha beta\n\n--", 4, 1), (1, "gamma", 2, 1), (1, "gamma", 2, 1), (2, None, 0, 0), (3, "", 1, 0)], key=str)
    assert line_dedup.dedup_lines(empty).collect() == []


def test_no_python_on_the_main_path(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_line_is_hashed_once_and_not_once_a_word(docs):
    """Hashes of whole lines stand below the rows of words."""
    slim = docs.selectExpr("doc_id AS doc", "xxhash64(text) AS print", "text")
    plan = line_dedup._nodes(line_dedup._lines(slim))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode", 1)
    assert "xxhash64(words" not in above and "xxhash64(words" in below
