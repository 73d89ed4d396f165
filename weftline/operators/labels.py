"""Labels from names and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def folder(name: Column) -> Column:
    """First path component; a name without a separator is "unknown"."""
    path = F.replace(name, F.lit("\\"), F.lit("/"))
    return F.when(path.contains("/"), F.split(path, "/")[0]).otherwise("unknown")


def folder_labels(df: DataFrame, name: str, order: str, first_seen: bool = True) -> DataFrame:
    """Numbers classes by first appearance, or sorted. The class table is small: one row a class."""
    classed = df.withColumn("class", folder(F.col(name)))
    by = "first" if first_seen else "class"
    classes = classed.groupBy("class").agg(F.min(order).alias("first"))
    numbered = classes.select("class", (F.row_number().over(W.orderBy(by)) - 1).cast("long").alias("label"))
    return classed.join(numbered, "class")


def pattern(name: Column, regex: str, group: int = 1) -> Column:
    """The group as a number; 0 without a match; anything but digits raises."""
    found = F.regexp_extract(name, regex, group)
    return F.when(name.rlike(regex), found).otherwise("0").cast("long")


def metadata(of: Column, field: str, default: int = 0) -> Column:
    return F.coalesce(F.try_element_at(of, F.lit(field)), F.lit(default))


def json_field(text: Column, field: str) -> Column:
    return F.coalesce(F.get_json_object(text, f"$.{field}").cast("long"), F.lit(0))
