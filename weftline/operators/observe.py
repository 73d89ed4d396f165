"""Caches, errors, profiles: as aggregates over rows, since per-task counters see no other task."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("INFO", "WARNING", "ERROR", "CRITICAL")
_LOG = logging.getLogger("weftline")


def by_content(df: DataFrame, content: str, key: str) -> DataFrame:
    """One row a distinct content: its hash, first key and uses."""
    return df.groupBy(F.md5(content).alias("content")).agg(F.min(key).alias(key), F.count("*").alias("hits"))


def cache_stats(df: DataFrame, content: str) -> DataFrame:
    """Lookups, misses (first uses) and hits of a cache that never evicts. Contents are counted by hash, each once."""
    each = df.groupBy(F.md5(content).alias("h")).agg(F.count("*").alias("n"))
    return each.agg(F.sum("n").alias("lookups"), F.count("*").alias("misses"), (F.sum("n") - F.count("*")).alias("hits"), F.round((F.sum("n") - F.count("*")) / F.sum("n"), 6).alias("hit_rate"))


def error_summary(df: DataFrame) -> DataFrame:
    return df.filter(F.col("error_type").isNotNull()).groupBy("severity", "error_type").agg(F.count("*").alias("n"))


def error_threshold(df: DataFrame, most: int) -> DataFrame:
    """Only errors and worse count towards the limit."""
    bad = F.count_if(F.col("severity").isin("ERROR", "CRITICAL"))
    return df.agg(bad.alias("counted"), (bad > most).alias("exceeded"))


def on_error(df: DataFrame, ok: Column, policy: str, payload: list[str]) -> DataFrame:
    """zero: payload of bad rows becomes 0; skip: they go; fail: the first one raises."""
    if policy == "skip":
        return df.filter(ok).withColumn("is_ok", F.lit(True))
    if policy == "zero":
        return df.withColumn("is_ok", ok).withColumns({c: F.when(F.col("is_ok"), F.col(c)).otherwise(F.lit(0)) for c in payload})
    if policy == "fail":
        return df.filter(F.when(ok, True).otherwise(F.raise_error(F.lit("a sample failed")).cast("boolean"))).withColumn("is_ok", F.lit(True))
    raise ValueError(f"unknown policy: {policy}")


def profile(df: DataFrame, operation: str, value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(F.col(operation).alias("operation")).agg(F.count("*").alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(F.min(v), 6).alias("least"), F.round(F.max(v), 6).alias("most"), F.round(F.avg(v), 6).alias("mean"))


def set_log(level: str = "INFO", path: str | None = None) -> logging.Logger:
    _LOG.setLevel(level)
    if path:
        _LOG.addHandler(logging.FileHandler(path))
    return _LOG
