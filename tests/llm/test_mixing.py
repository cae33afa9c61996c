import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.llm import mixing


def mixed(docs):
    sized = docs.withColumn("size", mixing.n_words(F.col("text")))
    counted = mixing.with_copies(sized, "size", [5, 2, 1])
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@pytest.mark.parametrize("small", [100_000, 0])
def test_mix_equals_the_sql_with_and_without_salts(docs, monkeypatch, small):
    monkeypatch.setattr(mixing, "SMALL_SOURCES", small)
    monkeypatch.setattr(mixing, "ROWS_A_SALT", 3)
    got = sorted(map(tuple, mixed(docs).collect()), key=str)
    with duckdb.connect() as db:
        db.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
        wanted = sorted(db.sql(mixing.SQL).fetchall(), key=str)
    assert got == wanted


def test_targets_fill_up_and_spend_the_budget(spark):
    totals = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 1000, 1), (None, 500, 1), ("z", 0, 1)], "source string, source_size bigint, rows bigint")
    found = {r["source"]: r["target"] for r in mixing.targets(totals, [5, 2, 1], 1.5, 2.0).collect()}
    assert found["a"] == 20.0 and found["z"] == 0.0
    assert sum(found.values()) == pytest.approx(1.5 * 2510)
    # b, c and null weigh 2, 1, 2 (z comes before null and weighs 5).
    assert found["b"] == pytest.approx(2 * found["c"], rel=1e-9) or found["b"] == 2000.0
    assert found[None] == 1000.0


def test_emitted_copies_nulls_and_clashing_names(docs, empty):
    sized = docs.withColumn("target", mixing.n_words(F.col("text")))
    counted = mixing.with_copies(sized.withColumnRenamed("target", "size"), "size", [5, 2, 1])
    copies = {(r["doc_id"], r["text"]): r["copies"] for r in counted.collect()}
    out = mixing.mixed(sized.withColumnRenamed("target", "size"), "size", [5, 2, 1])
    assert out.columns == [*docs.columns, "size"]
    emitted = {}
    for r in out.collect():
        emitted[r["doc_id"], r["text"]] = emitted.get((r["doc_id"], r["text"]), 0) + 1
    repeated = {(r["doc_id"], r["text"]): 0 for r in docs.collect()}
    for r in docs.collect():
        repeated[r["doc_id"], r["text"]] += 1
    assert emitted == {k: c * repeated[k] for k, c in copies.items() if c}
    assert mixing.mixed(empty, "n_chars", [1]).collect() == []
