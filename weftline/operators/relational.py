"""Joins by order and by range, without a row meeting every other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Spark limits each group before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before its time.

    Both sides are put in one order and the last value carried forward: one shuffle, no pairs.
    """
    rest = [c for c in left.columns if c not in (*keys, time)]
    both = left.withColumns({value: F.lit(None).cast(right.schema[value].dataType), "__side": F.lit(1)}).unionByName(right.select(*keys, time, value).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(time, "__side", value).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("__side = 1").select(*keys, time, *rest, value)


def in_range(points: DataFrame, at: str, spans: DataFrame, low: str, high: str, cell: int) -> DataFrame:
    """Points in [low, high) of spans, by cells that equal on both sides; a span is in as many cells as it is long."""
    spread = spans.filter(F.col(high) > F.col(low)).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor((F.col(high) - 1) / cell))))
    return points.withColumn("__cell", F.floor(F.col(at) / cell)).join(spread, "__cell").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__cell")
