"""Conditions and outcomes over a panel, reduced to day-level sums in one pass.

Many cells share one ``groupBy(day)``: each contributes conditional sums, and the cells
become rows only after the aggregate, so the panel is never multiplied by the cell count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cell:
    """Compare outcome ``y`` where ``a`` holds with where ``b`` holds, within ``scope``."""

    name: str
    y: Column
    a: Column
    b: Column | None = None  # None: everything in scope that is not ``a``
    scope: Column | None = None


@dataclass(frozen=True)
class Event:
    """Signed event value: null where there is no event."""

    name: str
    v: Column


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def two_group_days(panel: DataFrame, cells: Sequence[Cell], day: str = "day") -> DataFrame:
    """(cell, day, a_sum, a_n, b_sum, b_n); days with no row in a cell's scope are left out."""
    aggs, rows = [], []
    for i, c in enumerate(cells):
        scope = _true(c.scope) if c.scope is not None else F.lit(True)
        a = _true(c.a)
        b = ~a if c.b is None else _true(c.b)
        in_a, in_b = F.when(scope & a, c.y), F.when(scope & b, c.y)
        aggs += [
            F.count_if(scope).alias(f"rows{i}"),
            F.coalesce(F.sum(in_a), F.lit(0.0)).alias(f"as{i}"),
            F.count(in_a).alias(f"an{i}"),
            F.coalesce(F.sum(in_b), F.lit(0.0)).alias(f"bs{i}"),
            F.count(in_b).alias(f"bn{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(c.name).alias("cell"),
                F.col(f"rows{i}").alias("rows"),
                F.col(f"as{i}").alias("a_sum"),
                F.col(f"an{i}").alias("a_n"),
                F.col(f"bs{i}").alias("b_sum"),
                F.col(f"bn{i}").alias("b_n"),
            )
        )
    daily = panel.groupBy(F.col(day).alias("day")).agg(*aggs)
    return daily.select("day", F.inline(F.array(*rows))).where("rows > 0").drop("rows")


def event_days(panel: DataFrame, events: Sequence[Event], day: str = "day") -> DataFrame:
    """(cell, day, v_sum, v_n) over the days that have events."""
    aggs, rows = [], []
    for i, e in enumerate(events):
        aggs += [F.sum(e.v).alias(f"s{i}"), F.count(e.v).alias(f"n{i}")]
        rows.append(
            F.struct(
                F.lit(e.name).alias("cell"), F.col(f"s{i}").alias("v_sum"), F.col(f"n{i}").alias("v_n")
            )
        )
    daily = panel.groupBy(F.col(day).alias("day")).agg(*aggs)
    return daily.select("day", F.inline(F.array(*rows))).where("v_n > 0")
