"""The registered queries of the text operators: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import byte_bpe, html_text, importance, license_scan, line_dedup, mixing, order_minhash, quality_rules, simhash, suffixes, token_alignment, token_counts, token_files
from tickloom.llm.common import cut, scratch, table, whole
from tickloom.session import prepare


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    # Sizes are read twice, by the totals and by the mix: the texts are counted once.
    sized = cut(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")))
    counted = mixing.with_copies(sized, "size", [5, 2, 1])
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode(docs, path, public_tokenizers.PATTERN, carry=["doc_id"], ids=False)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(prepare(spark), sf_dir, "pages"), carry=["page_id", "url"])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    rows = quality_rules.ledger(docs)
    base_failed = ~quality_rules.passes("base-1")
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *measures, base_failed.alias("base_failed"), quality_rules.passes("prose-1").alias("kept"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, shingle=3, radius=3)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan(docs).select("doc_id", "scan.*")
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return found.withColumns(joined).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-files")
    stored = token_files.write(docs, folder, path, end_id=2)
    back = token_files.read_checksums(spark, folder, path, stored.select("key", "copy"))
    return back.select(F.col("key").alias("doc_id"), "start", F.col("n").alias("n_tokens"), "ids_crc32")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.octet_length(whole(F.col("text"))).cast("long").alias("n_bytes"))
    path = public_tokenizers.path("word_bpe_49k.json")
    counted = token_counts.count_tokens(docs, path, carry=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.against_edits(table(prepare(spark), sf_dir, "documents").select("doc_id", "text"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return token_alignment.alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return suffixes.without_repeats(docs, length=100, digest=True)


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (table(prepare(spark), sf_dir, name) for name in ("documents", "benchmark"))
    drawn = importance.resample(docs, target, percent=25, n=2, buckets=10_000, least_words=20, seed=7)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


_QUERIES = [op1_line_dedup, op2_source_mix, op3_byte_bpe, op4_html_text, op5_quality_rules, op6_simhash, op7_license_scan, op8_token_files, op9_token_counts, op10_order_minhash, op11_token_alignment, op12_suffix_dedup, op13_importance_resample]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op2_source_mix": mixing.SQL, "op5_quality_rules": quality_rules.SQL, "op13_importance_resample": importance.SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql is not None}
