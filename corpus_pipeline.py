"""From raw documents to token ids: quality rules, line dedup, near-dedup, source mix, encoding.

Each stage reads all that its predecessor kept, and all but the last return the columns of
``documents``. Nulls, empty texts, repeated rows and empty tables are handled as the operators
say; a stage that drops documents drops those and no others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import byte_bpe, line_dedup, mixing, quality_rules, shingle_dedup
from tickloom.llm.common import scratch, table
from tickloom.session import prepare

POLICY = "prose-1"
WEIGHTS = [5, 2, 1]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy."""
    return quality_rules.ledger(docs).where(quality_rules.passes(POLICY)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that stand elsewhere before; ``n_chars`` follows."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies: close SimHashes by pivot distances, verified on the shingles."""
    return shingle_dedup.first_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for."""
    sized = docs.withColumn("__size", mixing.n_words(F.col("text")))
    return mixing.mixed(sized, "__size", WEIGHTS).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, their number, and digests of the ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode(docs, path, public_tokenizers.PATTERN, carry=["doc_id", "lang", "source"])


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-dedup", near_copies),
    ("source mix", mix),
    ("byte-level BPE", encode),
]

# Fingerprints, edit-distance components and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            written = scratch(spark, f"stage-{i}")
            docs.write.parquet(written)
            docs = spark.read.parquet(written)
    return docs
