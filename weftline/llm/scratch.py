"""Tables and files between the steps of an operator.

They lie in the folder that the cluster names in ``spark.checkpoint.dir``, which the driver and all
executors share, so a lost executor loses nothing. Only where that setting is missing (tests, a
laptop) a temporary folder of this machine is used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.shared import root, size_estimate

__all__ = ["Scratch", "size_estimate"]

#: Spark's setting by which the shuffle files of a query go when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """A new folder below the shared one; ``save`` writes a frame there and reads it back."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def below(self, name: str) -> Scratch:
        """A folder of its own in this one, for a step that names its tables itself."""
        other = Scratch(self.spark, name)
        other.root = self.path(name)
        return other

    def save(self, df: DataFrame, name: str, zstd: bool = False) -> DataFrame:
        writer = df.write.mode("overwrite")
        if zstd:
            writer = writer.option("compression", "zstd")
        conf = self.spark.conf
        before = conf.get(CLEAN_UP, "false")
        conf.set(CLEAN_UP, "true")  # the table is whole when the query ends: nothing reads its shuffles again
        try:
            writer.parquet(self.path(name))
        finally:
            conf.set(CLEAN_UP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Deletes one table, or the whole folder, once nothing reads it any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
