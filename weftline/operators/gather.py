"""Rows by index list, sidecar grouping, label alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gather(data: DataFrame, indices: DataFrame, key: str = "sample_id") -> DataFrame:
    """indices (pos, key): their rows with positions; repeats come again, unknown indices are left out (see ``unknown``)."""
    return indices.join(data, key)


def unknown(data: DataFrame, indices: DataFrame, key: str = "sample_id") -> DataFrame:
    return indices.join(data.select(key), key, "left_anti")


#: Fixed value: a member's name is a stem and what follows its last dot.
NAME = r"^(.+?)\.([^.]+)$"


def split_name(name: Column) -> tuple[Column, Column]:
    """Stem and extension at the last dot."""
    return F.regexp_extract(name, NAME, 1), F.regexp_extract(name, NAME, 2)


def sidecars(members: DataFrame, name: str = "name", content: str = "content", order: str = "ordinal") -> DataFrame:
    """(key, parts): a map from extension to content; of equal extensions the last wins; names without a dot are left out."""
    stem, ext = split_name(F.col(name))
    parts = members.filter(F.col(name).rlike(NAME)).select(stem.alias("key"), ext.alias("ext"), content, order)
    last = parts.groupBy("key", "ext").agg(F.max_by(content, order).alias(content))
    return last.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", content)))).alias("parts"))


def decoded(samples: DataFrame) -> DataFrame:
    """image, label (json), text of sidecar samples."""
    part = lambda *names: F.coalesce(*(F.try_element_at("parts", F.lit(n)) for n in names))
    return samples.select("key", part("jpg", "jpeg", "png", "webp").alias("image"), part("json").alias("json"), part("txt").alias("text"))


def labelled(data: DataFrame, labels: DataFrame, key: str, value: str, default: int = 0) -> DataFrame:
    return data.join(labels.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))
