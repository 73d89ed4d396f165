"""The folder that the driver and all executors share, and what Spark knows of a frame's size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The URI of spark.checkpoint.dir, or, in local sessions without it, of a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="weftline-"))


def size_estimate(df: DataFrame) -> int:
    """Bytes that Spark expects of a frame, from file sizes alone: no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Bytes of sources, as they are in files, that go to one shard.
SHARD_BYTES = 16 << 20


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame is made from, whatever it keeps of them: no job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def sharded(df: DataFrame, key: str, least: int, of: DataFrame | None = None) -> DataFrame:
    """``df`` in ranges of the key, sorted within: as many as its sources (or those of ``of``) ask for, ``least`` at least."""
    n = max(least, -(-source_bytes(df if of is None else of) // SHARD_BYTES))
    return df.repartitionByRange(n, key).sortWithinPartitions(key)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared one."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
