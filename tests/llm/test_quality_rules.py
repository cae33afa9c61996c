import duckdb

from tests.llm import brute
from tickloom.llm import quality_rules as Q


def test_measures_and_bits_equal_brute_force(docs, empty):
    rows = Q.ledger(docs.withColumnRenamed("n_chars", "failed")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        m = brute.measures(r["text"])
        assert {k: r[k] for k in m} == m
        bits = [eval(rule, {}, m) for _, rule in Q.RULES]  # the rules are plain comparisons
        assert r["failed"] == sum(1 << i for i, b in enumerate(bits) if b)
    assert Q.ledger(empty).collect() == []


def test_query_columns_equal_the_sql(docs):
    rows = Q.ledger(docs)
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = rows.select("doc_id", *measures, (~Q.passes("base-1")).alias("base_failed"), Q.passes("prose-1").alias("kept"))
    with duckdb.connect() as db:
        db.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
        wanted = db.sql(Q.SQL).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)


def test_ablations_read_the_ledger_alone(docs):
    ledger = Q.ledger(docs).select("failed").cache()
    bits = [r["failed"] & Q.mask(Q.POLICIES["prose-1"]) for r in ledger.collect()]
    for r in Q.ablations(ledger, "prose-1").collect():
        bit = Q.mask([r["rule"]])
        assert r["failed"] == sum(b & bit != 0 for b in bits)
        assert r["alone"] == sum(b == bit for b in bits)
        assert r["kept_without"] == sum(b & ~bit == 0 for b in bits)


def test_prose_passes_and_junk_does_not(docs):
    kept = {r["text"] for r in Q.ledger(docs).where(Q.passes("prose-1")).collect()}
    texts = [r["text"] for r in docs.collect()]
    assert set(texts[:24]) <= kept
    assert not kept & {t for t in texts if t and ("###" in t or "SHOUTING" in t or t.startswith("same line"))}


def test_no_python_on_the_main_path(docs):
    plan = Q.ledger(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
