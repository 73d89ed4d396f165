"""Image files by Spark's own reader: JPEG, PNG and BMP to rows (path, h, w, data), data being RGB."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.shared import size_estimate


#: Bytes of files a task reads, and how many of Spark's partitions, which hold 32 small files each, it takes at most.
TASK_BYTES, TASK_PARTS = 64 << 20, 64


def packed(files: DataFrame) -> DataFrame:
    """Files in fewer tasks. Spark counts a small file as 4 MB, so a task has some 32 and costs more than what it reads."""
    n = files.rdd.getNumPartitions()
    least = max(2 * files.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_PARTS), -(-size_estimate(files) // TASK_BYTES))
    return files.coalesce(least) if least < n else files


def scan(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """Files that are no images raise, or are left out. Grey is repeated over three channels, alpha goes.

    JPEG pixels are those of the JVM's decoder; they may differ by little from those of other decoders.
    """
    rows = packed(spark.read.format("image").option("dropInvalid", drop_invalid).load(path)).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["height"] <= 0:
                    raise ValueError(f"{row['origin']} is no image")
                x = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
                rgb = x[..., 2::-1] if x.shape[2] >= 3 else x[..., :1].repeat(3, -1)
                out.append({"path": row["origin"], "h": x.shape[0], "w": x.shape[1], "data": np.ascontiguousarray(rgb).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary())]))

    return rows.select("origin", "height", "width", "nChannels", F.col("data")).mapInArrow(run, "path string, h int, w int, data binary")
