"""Flat files of token ids: a data source that reads ranges, and a writer.

``spark.read.format("tokens").option("path", ..).option("dtype", "uint16")`` gives (pos, token), pos running on over the
files in order of their names. A partition is ``block`` tokens of one file, read as one range. Bytes that make no whole
token at a file's end raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.sources.store import listed, published, read_range, resolved

#: Types of ids that files may have.
DTYPES = ("uint8", "uint16", "uint32", "int32", "int64")


class TokenRange(InputPartition):
    def __init__(self, path: str, first: int, count: int, pos: int):
        self.path, self.first, self.count, self.pos = path, first, count, pos


class TokenReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        dtype = options.get("dtype", "uint16")
        if dtype not in DTYPES:
            raise ValueError(f"tokens are of {', '.join(DTYPES)}, not {dtype}")
        self.dtype = np.dtype(dtype).newbyteorder("<")
        self.block = int(options.get("block", 1 << 24))
        self.files = listed(options["path"], options.get("glob", "*.bin"))

    def partitions(self) -> list[TokenRange]:
        out, pos = [], 0
        for path in self.files:
            store, at = resolved(path)
            size = store.get_file_info(at).size
            if size % self.dtype.itemsize:
                raise ValueError(f"{path}: {size} bytes are no whole tokens of {self.dtype.itemsize}")
            n = size // self.dtype.itemsize
            out += [TokenRange(path, first, min(self.block, n - first), pos + first) for first in range(0, n, self.block)]
            pos += n
        return out

    def read(self, partition: TokenRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no tokens at all
            return
        step = 1 << 18
        for low in range(0, partition.count, step):
            n, size = min(step, partition.count - low), self.dtype.itemsize
            ids = np.frombuffer(read_range(partition.path, (partition.first + low) * size, n * size), self.dtype).astype(np.int64)
            at = np.arange(partition.pos + low, partition.pos + low + n, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids)], names=["pos", "token"])


class TokenSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokens"

    def schema(self) -> str:
        return "pos long, token long"

    def reader(self, schema) -> TokenReader:
        return TokenReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(TokenSource)
    return spark


def write_tokens(df: DataFrame, folder: str, dtype: str = "uint16", token: str = "token") -> DataFrame:
    """One file a partition, in partition order; an id that does not fit the type raises. Returns (file, tokens)."""
    from pyspark import TaskContext

    if dtype not in DTYPES:
        raise ValueError(f"tokens are of {', '.join(DTYPES)}, not {dtype}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name, n, kind = f"part-{context.partitionId():06d}.bin", 0, np.dtype(dtype).newbyteorder("<")
        with published(folder, name, str(context.taskAttemptId())) as sink:
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                if len(ids) and (ids.dtype.kind == "f" or ids.min() < np.iinfo(kind).min or ids.max() > np.iinfo(kind).max):
                    raise ValueError(f"a null or an id beyond {dtype}")
                sink.write(ids.astype(kind).tobytes())
                n += len(ids)
        yield pa.RecordBatch.from_pylist([{"file": name, "tokens": n}])

    return df.select(df[token].cast("long")).mapInArrow(run, "file string, tokens long")
