import random

from tests.llm import brute
from tests.llm.conftest import prose
from tickloom.llm import shingle_dedup


def grams(text):
    w = brute.SPACE_WORD.findall(brute.ascii_lower(text))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited(text, n, draw):
    words = text.split()
    for i in draw.sample(range(len(words)), n):
        words[i] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def test_one_of_every_group_by_brute_force_jaccard(spark):
    """Near copies with words replaced at random, on both sides of similarity 0.8."""
    draw, texts = random.Random(11), []
    for g in range(40):
        base = prose(9000 + g, draw.choice([60, 150, 400]))
        n = len(base.split())
        texts += [base] + [edited(base, draw.randrange(1, max(2, n // 30)), draw) for _ in range(3)]
    texts += [None, "", "  ", "four words in all", "four words in all", "Four Words in all!"]
    sets = [grams(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])]
    edge = [1 for i, j in links if sets[i] != sets[j] and len(sets[i] & sets[j]) < 0.85 * len(sets[i] | sets[j])]
    assert len(edge) >= 10
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in shingle_dedup.first_of_each(rows).collect())
    assert kept == sorted(set(brute.roots(len(texts), links)))


def test_pipeline_stage_drops_a_copy_at_the_bound(spark):
    import corpus_pipeline

    base = prose(77, 300)
    texts = [base] + [edited(base, 6, random.Random(i)) for i in range(20)]
    assert all(similar(grams(base), grams(t)) for t in texts)
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near-dedup"](spark, rows, "").collect()] == [0]


def test_keys_meet_at_the_bound():
    """Of 3,000 pairs of sets at similarity 0.8 every one shares a key."""
    import numpy as np

    draw = np.random.default_rng(3)
    for _ in range(3000):
        h = draw.integers(0, 2**63, 90).astype(np.uint64)
        a, b = np.sort(h[:81]), np.sort(np.concatenate([h[:72], h[81:]]))
        assert 5 * len(np.intersect1d(a, b)) == 4 * len(np.union1d(a, b))
        assert set(shingle_dedup.keys_of(a)) & set(shingle_dedup.keys_of(b))


def test_simhashes_of_near_sets_are_within_the_radius():
    """At similarity 0.8, down to sets of 4 and 5, all are; of unrelated sets of some size none is."""
    import numpy as np

    draw, far = np.random.default_rng(5), []
    bits = lambda s: np.array(shingle_dedup.fingerprint(s), np.int64).view(np.uint64)
    apart = lambda a, b: int(np.bitwise_count(bits(a) ^ bits(b)).sum())
    for both, left, right in [(4, 0, 1), (8, 0, 2), (8, 1, 1), (12, 1, 2), (72, 9, 9), (400, 0, 100), (400, 50, 50)]:
        for _ in range(400):
            h = draw.integers(0, 2**64, both + left + right, dtype=np.uint64)
            a, b = h[: both + left], np.concatenate([h[:both], h[both + left :]])
            assert apart(a, b) <= shingle_dedup.RADIUS
            far.append(apart(h[: both // 2 * 2 + 1], draw.integers(0, 2**64, both // 2 * 2 + 1, dtype=np.uint64)))
    assert min(far) > shingle_dedup.RADIUS


def test_pairs_beyond_the_radius_are_not_verified(spark, monkeypatch):
    """The pipeline's stage gets its pairs through SimHashes and pivot distances."""
    import corpus_pipeline

    base = prose(77, 300)
    texts = [base] + [edited(base, 2, random.Random(i)) for i in range(6)]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stage = dict(corpus_pipeline.STAGES)["near-dedup"]
    assert [r["doc_id"] for r in stage(spark, rows, "").collect()] == [0]
    monkeypatch.setattr(shingle_dedup, "RADIUS", 0)
    assert sorted(r["doc_id"] for r in stage(spark, rows, "").collect()) == list(range(7))


def test_no_pair_is_left_out_where_min_hashes_miss_some(spark):
    """Pairs a little above similarity 0.6: a pair missed all of 24 keys of 4 min-hashes once in 30 to 200 times."""
    draw, texts = random.Random(21), []
    for g in range(400):
        base = [f"w{g}x{i}" for i in range(90)]
        other = base[:]
        for i in draw.sample(range(10, 80, 10), 4):
            other[i] = f"u{g}x{i}"
        texts += [" ".join(base), " ".join(other)]
    sets = [grams(t) for t in texts]
    assert all(0.6 <= len(a & b) / len(a | b) < 0.7 for a, b in zip(sets[::2], sets[1::2], strict=True))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in shingle_dedup.first_of_each(rows, similarity=0.6).collect())
    assert kept == list(range(0, 800, 2))


def test_texts_are_found_over_many_slices_and_buckets(spark, monkeypatch):
    """Few bytes a slice and few shingles a bucket: who has no partner is not read again, near copies are."""
    monkeypatch.setattr(shingle_dedup, "COUNTED", 50)
    monkeypatch.setattr(shingle_dedup, "SLICE", 700)
    base = prose(5, 120)
    texts = [base, edited(base, 2, random.Random(1)), *[prose(100 + i, 60) for i in range(12)], None, "", base]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    echoed = shingle_dedup._echoed(rows, 5, 0.8, 1500).collect()
    seen = {shingle_dedup._name(shingle_dedup.shingles(t, 5)) for t in texts[:2]}
    assert {r["node"] for r in echoed} == seen
    assert sorted(r["doc_id"] for r in shingle_dedup.first_of_each(rows).collect()) == [0, *range(2, 15)]
