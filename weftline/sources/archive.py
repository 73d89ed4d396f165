"""TAR archives as a data source: one partition a file, members in order, contents on demand.

``spark.read.format("archive").option("path", "...")`` gives (file, ordinal, name, ext, size, content).
The ordinal counts the members that the ``extensions`` option lets in (all by default) and stands for
identity within its file. ``content=false`` skips payloads. A filter on ``ext`` is applied while headers
are read, if spark.sql.python.filterPushdown.enabled is on. A member cut short by the end of the file
ends that file's rows, or raises with ``on_error=fail``.
"""

from __future__ import annotations

import fnmatch
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from weftline.sources.store import listed, opened, published

SCHEMA = "file string, ordinal long, name string, ext string, size long, content binary"


def extension(name: str) -> str:
    base = name.rpartition("/")[2]
    return base.rpartition(".")[2].lower() if "." in base else ""


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = listed(options["path"], options.get("glob", "*.tar"))
        self.wanted = {e.strip().lower() for e in options.get("extensions", "").split(",") if e.strip()}
        self.with_content = options.get("content", "true").lower() != "false"
        self.fail = options.get("on_error", "skip") == "fail"
        self.only: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ext",) and self.only is None:
                self.only = f.value
            else:
                yield f

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(p) for p in self.files]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        ordinal = -1
        with opened(partition.path) as raw:
            try:
                with tarfile.open(fileobj=raw, mode="r|*") as tar:
                    for member in tar:
                        ext = extension(member.name)
                        if not member.isfile() or (self.wanted and ext not in self.wanted):
                            continue
                        ordinal += 1
                        if self.only is not None and ext != self.only:
                            continue
                        content = None
                        if self.with_content:
                            content = tar.extractfile(member).read()
                            if len(content) < member.size:
                                raise tarfile.ReadError("unexpected end of data")
                        yield partition.path, ordinal, member.name, ext, member.size, content
            except (tarfile.ReadError, EOFError):
                if self.fail:
                    raise


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    return spark


def write_archives(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """One TAR a partition, members in partition order; returns (file, members, bytes).

    A file appears under its name only when whole, and a repeated task writes the same again.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        context = TaskContext.get()
        target = f"shard-{context.partitionId():06d}.tar"
        members = 0
        with published(folder, target, str(context.taskAttemptId())) as sink:
            with tarfile.open(fileobj=sink, mode="w|", format=tarfile.GNU_FORMAT) as tar:
                for batch in batches:
                    for member, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        info = tarfile.TarInfo(member)
                        info.size = len(data or b"")
                        tar.addfile(info, io.BytesIO(data or b""))
                        members += 1
            size = sink.size()
        yield pa.RecordBatch.from_pylist([{"file": target, "members": members, "bytes": size}])

    return df.select(df[name].cast("string"), df[content].cast("binary")).mapInArrow(run, "file string, members long, bytes long")


def folder_classes(df: DataFrame, path: str = "path", root: str = "") -> DataFrame:
    """binaryFile rows of root/class/...: member names relative to the root, classes numbered in sorted order."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    relative = F.regexp_replace(F.col(path), "^.*?" + (root.strip("/").replace(".", r"\.") or "^") + "/", "")
    named = df.withColumn("name", relative).withColumn("class", F.split("name", "/")[0])
    classes = named.select("class").distinct().withColumn("label", (F.row_number().over(W.orderBy("class")) - 1).cast("long"))
    return named.join(classes, "class")


def matches(name: str, pattern: str) -> bool:
    return fnmatch.fnmatch(name, pattern)


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """One file a row, by its name (no folders in it); returns (file, bytes). Names that come again are written again."""
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        attempt = str(TaskContext.get().taskAttemptId())
        for batch in batches:
            out = []
            for member, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with published(folder, member, attempt) as sink:
                    sink.write(data or b"")
                out.append({"file": member, "bytes": len(data or b"")})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), ("bytes", pa.int64())]))

    return df.select(df[name].cast("string"), df[content].cast("binary")).mapInArrow(run, "file string, bytes long")


def to_records(members: DataFrame, folder: str, compress: bool = False) -> DataFrame:
    """Members of archives (name, content) that are images, as they are, into record files, a file a partition.

    Sizes come from the heads of the contents and the format from their first bytes; a size that a head does not tell is 0.
    Members that are no images are left out. Returns (file, samples, bytes).
    """
    from pyspark.sql import functions as F

    from weftline.sources import codecs, formats, records

    @F.pandas_udf("struct<width int, height int>")
    def size(heads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([codecs.size_of(h) or (0, 0) for h in heads], columns=["width", "height"]).astype("int32")

    images = members.withColumn("format", formats.by_magic(F.col("content"))).filter(F.col("format") != "unknown")
    rows = images.withColumn("__s", size(F.substring("content", 1, 1 << 16))).select("content", "format", "__s.width", "__s.height", F.to_json(F.struct("name")).alias("metadata"))
    return records.write_records(rows, folder, compress)
