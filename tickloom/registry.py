"""Named queries: a Spark builder plus, where SQL can say it, the same question in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import prepare

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Builder
    sql: str | None


QUERIES: dict[str, Query] = {}


def expand_rounding(sql: str) -> str:
    """Expand ``R6(expr)`` in check SQL to the rounding :func:`presentable` applies."""
    while (at := sql.find("R6(")) >= 0:
        depth, end = 1, at + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + 3 : end - 1]
        sql = f"{sql[:at]}(floor(CAST({inner} AS DOUBLE) * 1000000.0 + 0.5) / 1000000.0){sql[end:]}"
    return sql


def presentable(df: DataFrame) -> DataFrame:
    """Round doubles to six places and print dates, so results compare across engines."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.floor(c * 1e6 + 0.5) / 1e6
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``covers`` lists inventory ids."""

    def register(fn: Builder) -> Builder:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return presentable(fn(prepare(spark), sf_dir))

        build.__name__ = name
        build.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, tuple(covers.split()), build, sql and expand_rounding(sql))
        return fn

    return register
