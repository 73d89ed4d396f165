"""Identity and order: sample ids, epoch permutations, draws with replacement.

A rank over all rows never goes through one task: rows are dealt out by a coarse value that rises
with the sort key, ranked within, and shifted by how many rows lie before (one small row a deal).
Deals are ranges of the key between its approximate quantiles, as many as the frame's size asks for
and ``MOST_DEALS`` at most, so dense and sparse ids alike fall into deals of about equal size; md5
keys are uniform, and dealt out by their first digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import rng
from weftline.shared import size_estimate

#: Bytes of a deal's rows in files, and how many deals there are at most.
DEAL_BYTES, MOST_DEALS = 8 << 20, 4096


def dealt(df: DataFrame, key: str, name: str = "__deal") -> DataFrame:
    """Adds a deal that never falls while the numeric key rises; nulls come first. A small frame is one deal."""
    n = min(MOST_DEALS, -(-size_estimate(df.select(key)) // DEAL_BYTES))
    value = F.coalesce(F.col(key).cast("double"), F.lit(-math.inf))
    if n <= 1:
        return df.withColumn(name, F.lit(0.0))
    from pyspark.ml.feature import Bucketizer

    cuts = df.select(F.col(key).cast("double").alias("__key")).approxQuantile("__key", [k / n for k in range(1, n)], 0.25 / n)
    inner = sorted({c for c in cuts if math.isfinite(c)})
    if not inner:
        return df.withColumn(name, F.lit(0.0))
    return Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="__value", outputCol=name).transform(df.withColumn("__value", value)).drop("__value")


def ranked(dealt_out: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Replaces ``__deal``, which must never fall while the order rises, by the 0-based rank of each row."""
    sizes = dealt_out.groupBy("__deal").agg(F.count("*").alias("__n"))
    before = sizes.select("__deal", (F.sum("__n").over(W.orderBy("__deal")) - F.col("__n")).alias("__before"))  # one row a deal
    local = dealt_out.withColumn("__local", F.row_number().over(W.partitionBy("__deal").orderBy(*order)).cast("long") - 1)
    return local.join(before, "__deal").withColumn(name, F.col("__local") + F.col("__before")).drop("__deal", "__local", "__before")


def with_sample_id(df: DataFrame, key: str, name: str = "sample_id") -> DataFrame:
    """0-based ordinal by an integer key."""
    return ranked(dealt(df, key), [F.col(key)], name)


def shuffled(df: DataFrame, seed: int, epoch: int, sample: str = "sample_id", name: str = "pos") -> DataFrame:
    """Global epoch permutation: position by md5 key, ties by sample. Four digits make up to 65536 deals."""
    keyed = df.withColumn("__key", rng.key(seed, epoch, F.col(sample)))
    return ranked(keyed.withColumn("__deal", F.substring("__key", 1, 4)), [F.col("__key"), F.col(sample)], name).drop("__key")


def locally_shuffled(df: DataFrame, part: str, seed: int, epoch: int, sample: str = "sample_id", name: str = "pos") -> DataFrame:
    """Permutation within each part only, each under a seed of its own (seed + 1000 * part + epoch)."""
    keyed = F.md5(F.concat((F.lit(seed + epoch) + F.col(part) * 1000).cast("string"), F.lit(":"), F.col(sample).cast("string")))
    return df.withColumn(name, F.row_number().over(W.partitionBy(part).orderBy(keyed, sample)).cast("long") - 1)


def with_replacement(spark, draws: int, n: int, seed: int, epoch: int) -> DataFrame:
    """(draw, start): uniform starts in 0 .. n - 1."""
    return spark.range(draws).select(F.col("id").alias("draw"), rng.below(n, seed, epoch, F.col("id"), "start").alias("start"))
