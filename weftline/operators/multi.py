"""Augmentations of several samples: self-joins by position, never by arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import rng


def partners(df: DataFrame, n: int, size: int, payload: list[str], pos: str = "pos") -> DataFrame:
    """Each row with the next of its batch; the last takes the first."""
    p = F.col(pos)
    first = F.floor(p / size) * size
    of = F.when((F.pmod(p, F.lit(size)) == size - 1) | (p == n - 1), first).otherwise(p + 1)
    other = df.select(F.col(pos).alias("__of"), *(F.col(c).alias(f"partner_{c}") for c in payload))
    return df.withColumn("__of", of).join(other, "__of").drop("__of")


def mixup(paired: DataFrame, key: str, vector: str, seed: int, epoch: int = 0) -> DataFrame:
    """lambda uniform, that is Beta(1, 1); both labels stay for soft targets."""
    lam = rng.uniform(seed, epoch, F.col(key), "lambda")
    mixed = F.zip_with(vector, f"partner_{vector}", lambda a, b: F.col("lambda") * a.cast("double") + (1 - F.col("lambda")) * b.cast("double"))
    return paired.withColumn("lambda", lam).withColumn("mixed", mixed)


def cut_box(key: Column, w: int, h: int, seed: int, epoch: int = 0) -> Column:
    """struct(x0, y0, x1, y1, lambda): a box of sides sqrt(1 - lambda), clipped; lambda is then what stays of the image."""
    u = lambda d: rng.uniform(seed, epoch, key, d)
    side = F.sqrt(1 - u("lambda"))

    def ends(n: int, d: str) -> tuple[Column, Column]:
        half, centre = F.floor(F.floor(n * side) / 2), F.floor(u(d) * n)
        return F.greatest(F.lit(0), centre - half), F.least(F.lit(n), centre + half)

    (x0, x1), (y0, y1) = ends(w, "x"), ends(h, "y")
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), (1 - (x1 - x0) * (y1 - y0) / F.lit(float(w * h))).alias("lambda"))


def cutmix(pixels: DataFrame, others: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels (img, y, x, c, v) with the box of boxes (img, partner, x0..y1) taken from the partner's."""
    boxed = pixels.join(boxes, "img")
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    other = others.select(F.col("img").alias("partner"), "y", "x", "c", F.col("v").alias("__v"))
    return boxed.join(other, ["partner", "y", "x", "c"], "left").select("img", "y", "x", "c", F.when(inside, F.coalesce("__v", "v")).otherwise(F.col("v")).alias("v"))


def groups_of(df: DataFrame, n: int, payload: list[str], pos: str = "pos") -> DataFrame:
    """Every n rows in a row, as one with lists in order: what a mosaic takes."""
    g = df.withColumns({"group": F.floor(F.col(pos) / n).cast("long")})
    rows = F.array_sort(F.collect_list(F.struct(pos, *payload)))
    return g.groupBy("group").agg(rows.alias("__r")).select("group", *(F.col(f"__r.{c}").alias(c) for c in payload))
