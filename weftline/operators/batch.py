"""Batches: fixed size, by size class, metadata, resume, collation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.order import dealt


def fixed(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """batch_id and row_in_batch of a position."""
    return df.withColumns({"batch_id": F.floor(F.col(pos) / size).cast("long"), "row_in_batch": F.pmod(pos, F.lit(size))})


def drop_last(df: DataFrame, n: int, size: int, pos: str = "pos") -> DataFrame:
    """Without the ragged last batch: a predicate on positions, so it sits below whatever is costly."""
    return df.filter(F.col(pos) < n // size * size)


def batches(n: int, size: int, drop: bool) -> int:
    return n // size if drop else -(-n // size)


def resumed(df: DataFrame, served: int) -> DataFrame:
    return df.filter(F.col("batch_id") >= served)


def bucket(width: Column, height: Column, step_w: int = 32, step_h: int = 32) -> list[Column]:
    return [(F.floor(width / step_w) * step_w).cast("long").alias("bucket_w"), (F.floor(height / step_h) * step_h).cast("long").alias("bucket_h")]


def size_batches(df: DataFrame, size: int, order: str, keys: tuple[str, ...] = ("bucket_w", "bucket_h")) -> DataFrame:
    """Batches of one size class each, at most ``size`` rows; every sample is in exactly one.

    A class that most samples share is ranked in ranges of the id between its quantiles, not in one task.
    """
    rows = dealt(df, order)
    before = rows.groupBy(*keys, "__deal").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(W.partitionBy(*keys).orderBy("__deal")) - F.col("__n")).drop("__n")
    local = rows.withColumn("__local", F.row_number().over(W.partitionBy(*keys, "__deal").orderBy(order)) - 1)
    pos = F.col("__local") + F.col("__before")
    return local.join(before, [*keys, "__deal"]).withColumns({"batch_in_bucket": F.floor(pos / size).cast("long"), "row_in_batch": F.pmod(pos, F.lit(size)).cast("long")}).drop("__deal", "__local", "__before")


def bucket_stats(df: DataFrame, size: int, keys: tuple[str, ...] = ("bucket_w", "bucket_h")) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("buckets"), F.sum("n").alias("samples"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum(F.ceil(F.col("n") / size)).cast("long").alias("batches"))


def varies(df: DataFrame, probe: int, order: str, width: str, height: str) -> DataFrame:
    """Whether the first ``probe`` samples have more than one size: the trigger of size batches."""
    first = df.orderBy(order).limit(probe)
    return first.agg(F.countDistinct(width, height).alias("sizes"), (F.countDistinct(width, height) > 1).alias("varies"))


def metadata(df: DataFrame, **columns: Column) -> DataFrame:
    """Per batch: size, the ids in order, and more aggregates."""
    ids = F.array_sort(F.collect_list(F.struct("row_in_batch", "sample_id")))
    return df.groupBy("batch_id").agg(F.count("*").alias("batch_size"), F.array_join(F.transform(ids, lambda r: r["sample_id"].cast("string")), ",").alias("indices"), *(c.alias(k) for k, c in columns.items()))


def collated(df: DataFrame, keys: list[str], order: str, leaves: list[str]) -> DataFrame:
    """Each leaf as a list in order, per group of bounded size (a batch, a conversation)."""
    rows = F.array_sort(F.collect_list(F.struct(order, *leaves)))
    return df.groupBy(*keys).agg(rows.alias("__rows")).select(*keys, *(F.col(f"__rows.{x}").alias(x) for x in leaves))


def progressive(spark, first: int, last: int, warmup: int, epochs: int) -> DataFrame:
    """(epoch, size): evenly from first to last over the warm-up, then last."""
    e = F.col("id")
    rise = F.floor(F.lit(float(first)) + e * (last - first) / max(1, warmup - 1)).cast("long")
    return spark.range(epochs).select(e.alias("epoch"), F.when(e < warmup, rise).otherwise(F.lit(last)).cast("long").alias("size"))


def loader_settings(budget_mb: int, bytes_per_batch: int, cpus: int) -> dict[str, int]:
    """Prefetch depth and workers for a memory budget: fixed tiers."""
    prefetch = min(2, max(1, int(0.7 * budget_mb * 1024 * 1024 / max(1, bytes_per_batch))))
    tiers = ((256, min(2, max(1, cpus // 4))), (512, min(4, cpus // 2)), (1024, min(8, cpus)))
    workers = next((w for most, w in tiers if budget_mb <= most), min(12, cpus))
    return {"prefetch": prefetch, "workers": max(1, workers)}
