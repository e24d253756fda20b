"""Running aggregates over large groups, taken in blocks so that no group has to pass through one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How two partial results combine; the functions skip nulls.
COMBINE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": F.greatest,
    "min": F.least,
}


def running(rows: DataFrame, keys: tuple[str, ...], block: str, order: tuple, kind: str, value: Column, name: str, current: bool = True) -> DataFrame:
    """Adds the running ``kind`` (sum, max or min) of ``value`` in each group of ``keys``.

    ``block`` has to rise with ``order``. Windows cover one block of a group; what comes before a block is taken from
    a table with one row per block. Without ``current`` a row's own value is left out. Null keys form groups, too.
    """
    aggregate = getattr(F, kind)
    inside = [*keys, block]
    inner = Window.partitionBy(*inside).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    outer = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*inside).agg(aggregate(value).alias("_total"))
    before = totals.select(
        *(F.col(c).alias(f"_b{i}") for i, c in enumerate(inside)), aggregate("_total").over(outer).alias("_before")
    )
    same = None
    for i, c in enumerate(inside):
        part = rows[c].eqNullSafe(before[f"_b{i}"])
        same = part if same is None else same & part
    joined = rows.withColumn("_inner", aggregate(value).over(inner)).join(before, same, "left")
    return joined.withColumn(name, COMBINE[kind](F.col("_inner"), F.col("_before"))).select(*rows.columns, name)
