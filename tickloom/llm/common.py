"""Small helpers of the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import cut_lineage, shared_folder
from tickloom.session import freed_shuffles as freed_shuffles

# White space that parts words, as a class for Java and Python patterns.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z alone; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def whole(text: Column) -> Column:
    """The text with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back, without its lineage."""
    return cut_lineage(df)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
