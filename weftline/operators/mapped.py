"""Objects with __getitem__ as sources, functions of a whole batch, batches as tensors, strict gathering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_items(spark: SparkSession, data: Any, schema: str, partitions: int | None = None) -> DataFrame:
    """sample_id and the fields of data[i], a dict or a tuple in the schema's order; workers ask for the items, not the driver.

    The object itself is sent to them, so it should hold paths rather than contents.
    """
    if not hasattr(data, "__getitem__") or not hasattr(data, "__len__"):
        raise TypeError("a source by index needs __getitem__ and __len__")
    full = f"sample_id long, {schema}"
    names = spark.createDataFrame([], schema).columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            items = [data[int(i)] for i in batch["id"]]
            fields = [x if isinstance(x, dict) else dict(zip(names, x if isinstance(x, tuple) else (x,), strict=True)) for x in items]
            yield pd.DataFrame({"sample_id": batch["id"], **{n: [f[n] for f in fields] for n in names}})

    return spark.range(0, len(data), 1, partitions).mapInPandas(run, full)


def collated_by(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: str = "pos", key: str = "batch_id") -> DataFrame:
    """Calls a function on each batch, its rows in order; batches are bounded by their size, so a task holds one."""
    return df.groupBy(key).applyInPandas(lambda rows: function(rows.sort_values(order, ignore_index=True)), schema)


def labelled_by(df: DataFrame, function: Callable[[str], int], column: str, name: str = "label", type_: str = "long") -> DataFrame:
    """A label by any function of a column (a file name, a class); it is called once a distinct value of a batch."""

    @F.pandas_udf(type_)
    def apply(values: pd.Series) -> pd.Series:
        known = {v: function(v) for v in values.unique()}
        return values.map(known)

    return df.withColumn(name, apply(F.col(column)))


def gathered(data: DataFrame, indices: DataFrame, key: str = "sample_id") -> DataFrame:
    """As ``gather.gather``, but an index that no row has raises."""
    rows = indices.join(data.withColumn("__found", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no row has {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return rows.withColumn("__found", F.when(F.col("__found").isNull(), missing.cast("boolean")).otherwise(True)).filter("__found").drop("__found")


def tensors(df: DataFrame, layout: str = "NCHW", mean: list[float] | None = None, std: list[float] | None = None) -> DataFrame:
    """(batch_id, n, h, w, data) from rows (batch_id, pos, h, w, data): images of a batch as one dense block in order.

    Bytes as they are, or, with mean and std, floats (little-endian, 32 bit) of (v / 255 - mean) / std. Images of several
    sizes in a batch raise; so does a batch without pixels.
    """
    if layout not in ("NCHW", "NHWC"):
        raise ValueError(f"no layout {layout}")
    if (mean is None) != (std is None) or (std is not None and not all(std)):
        raise ValueError("mean and std go together, and no std is 0")

    def stack(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = set(zip(rows["h"], rows["w"], strict=True))
        if len(sizes) != 1:
            raise ValueError(f"images of {len(sizes)} sizes in one batch")
        (h, w), n = sizes.pop(), len(rows)
        if not h or not w:
            raise ValueError("a batch without pixels")
        x = np.stack([np.frombuffer(d, np.uint8).reshape(h, w, 3) for d in rows["data"]])
        if mean is not None:
            x = ((x / np.float32(255) - np.asarray(mean, np.float32)) / np.asarray(std, np.float32)).astype("<f4")
        block = x.transpose(0, 3, 1, 2) if layout == "NCHW" else x
        return pd.DataFrame({"batch_id": rows["batch_id"][:1], "n": [n], "h": [h], "w": [w], "data": [np.ascontiguousarray(block).tobytes()]})

    return collated_by(df.select("batch_id", "pos", "h", "w", "data"), stack, "batch_id long, n long, h int, w int, data binary")


def flipped(images: DataFrame, draw: Column, p: float = 0.5) -> DataFrame:
    """Rows (.., h, w, data) mirrored where the draw is below p; one Arrow pass, other columns go with them."""
    @F.pandas_udf("binary")
    def mirror(h: pd.Series, w: pd.Series, data: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(d, np.uint8).reshape(a, b, 3)[:, ::-1].tobytes() if x < p else d for a, b, d, x in zip(h, w, data, u, strict=True)])

    return images.withColumn("data", mirror("h", "w", "data", draw))


def served(images: DataFrame, plan: DataFrame, draw: Column | None = None, mean: list[float] | None = None, std: list[float] | None = None, layout: str = "NCHW") -> DataFrame:
    """Batches of a fixed-width view as an epoch plan (batch_id, row_in_batch, sample_id) orders them.

    Images are gathered by sample_id, mirrored by the draw, and stacked. A plan cut to the batches not yet served gives the rest.
    """
    rows = gathered(images, plan.select("batch_id", F.col("row_in_batch").alias("pos"), "sample_id"))
    return tensors(flipped(rows, draw) if draw is not None else rows, layout, mean, std)


def arrow_images(encoded: DataFrame, decode: Callable[[bytes], Any], key: str = "img", content: str = "content") -> DataFrame:
    """(img, h, w, data) of encoded images, a batch at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode(c) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x.shape[k] for x in out], pa.int32()) for k in (0, 1)), pa.array([np.ascontiguousarray(x).tobytes() for x in out], pa.binary())], names=["img", "h", "w", "data"])

    return encoded.select(F.col(key).cast("long"), content).mapInArrow(run, "img long, h int, w int, data binary")
