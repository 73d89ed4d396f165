"""Operator 3: token-id files with shuffled planes.

File, all integers little-endian: ``WLPLANE1``; the chunks, each the compressed planes of one block
of ids, one after another; the document table (ids, then lengths, both 64-bit, compressed); the
chunk index (JSON, compressed); its place and size (two 64-bit); ``WLPLANE1`` again.

A block of ``block`` ids is written with the fewest bytes that its largest id needs, and transposed:
plane k holds byte k (``planes="byte"``) or bit k (``planes="bit"``) of every id. Each plane is
compressed with zstandard by itself. The index has for each chunk its place, its first id, how many
ids, the width in bytes, and the sizes of its planes, so a range of ids is read from its chunks alone.

Null text is an empty text: its document has the end id only. A table without rows gives no files.
Rows that repeat a doc_id are all written, next to each other, ordered by text; a null doc_id comes
first. Columns beyond the two named are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch, size_estimate
from weftline.llm.tokens import END_ID, encoded, vocabulary_path

MAGIC = b"WLPLANE1"
NO_KEY = -(1 << 63)


def to_planes(ids: np.ndarray, planes: str = "byte") -> tuple[int, list[bytes]]:
    """Width in bytes, and the planes of one block."""
    top = int(ids.max()) if len(ids) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 3 if top < 1 << 24 else 4
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    if planes == "byte":
        return width, [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(width)]
    bits = np.unpackbits(np.ascontiguousarray(rows), axis=1, bitorder="little")
    return width, [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(8 * width)]


def from_planes(stored: list[bytes], width: int, n: int, planes: str = "byte") -> np.ndarray:
    rows = np.zeros((n, 4), np.uint8)
    if planes == "byte":
        for k, plane in enumerate(stored):
            rows[:, k] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in stored], axis=1)
        rows[:, :width] = np.packbits(bits, axis=1, bitorder="little")
    return rows.view("<u4").reshape(-1)


class PlaneWriter:
    """Writes blocks as they fill; holds one block and the document table."""

    def __init__(self, sink, block: int = 1 << 16, planes: str = "byte", level: int = 3):
        import zstandard

        self.sink, self.block, self.planes = sink, block, planes
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.chunks: list[list] = []
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.at = len(MAGIC)
        sink.write(MAGIC)

    def add(self, doc: int, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._blocks(last=False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) // self.block * self.block
        for low in range(0, whole, self.block):
            one = ids[low : min(low + self.block, whole)]
            width, stored = to_planes(one, self.planes)
            packed = [self.compress(p) for p in stored]
            self.chunks.append([self.at, self.total, len(one), width, [len(p) for p in packed]])
            self.total += len(one)
            self._put(b"".join(packed))
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> int:
        self._blocks(last=True)
        docs_at = self.at
        packed = self.compress(np.array([*self.docs, *self.lengths], "<i8").tobytes())
        self._put(packed)
        index = {"planes": self.planes, "ids": self.total, "docs": [docs_at, len(packed), len(self.docs)], "chunks": self.chunks}
        at = self.at
        packed = self.compress(json.dumps(index).encode())
        self._put(packed)
        self._put(np.array([at, len(packed)], "<u8").tobytes() + MAGIC)
        return self.at


class PlaneReader:
    def __init__(self, source, size: int):
        import zstandard

        self.source, self.open = source, zstandard.ZstdDecompressor().decompress
        tail = self._read(size - 16 - len(MAGIC), 16 + len(MAGIC))
        if tail[16:] != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a plane file")
        at, n = np.frombuffer(tail[:16], "<u8").tolist()
        self.index = json.loads(self.open(self._read(at, n)))
        at, n, docs = self.index["docs"]
        table = np.frombuffer(self.open(self._read(at, n)), "<i8")
        self.docs, self.lengths = table[:docs], table[docs:]
        self.firsts = np.array([c[1] for c in self.index["chunks"]], np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, _, n, width, sizes = self.index["chunks"][k]
        data, stored, low = self._read(at, sum(sizes)), [], 0
        for size in sizes:
            stored.append(self.open(data[low : low + size]))
            low += size
        return from_planes(stored, width, n, self.index["planes"])

    def ids(self, low: int, high: int) -> np.ndarray:
        """The ids low:high of the file, from the chunks that hold them."""
        if low >= high:
            return np.zeros(0, "<u4")
        first = int(np.searchsorted(self.firsts, low, "right")) - 1
        last = int(np.searchsorted(self.firsts, high, "left"))
        got = np.concatenate([self.chunk(k) for k in range(first, last)])
        base = int(self.firsts[first])
        return got[low - base : high - base]

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) in file order; one chunk and one document in memory."""
        k, rest = 0, np.zeros(0, "<u4")
        for doc, n in zip(self.docs.tolist(), self.lengths.tolist(), strict=True):
            got = [rest]
            have = len(rest)
            while have < n:
                got.append(self.chunk(k))
                have += len(got[-1])
                k += 1
            joined = np.concatenate(got) if len(got) > 1 else got[0]
            yield doc, joined[:n]
            rest = joined[n:]


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, *, end_id: int | None = END_ID, block: int = 1 << 16, planes: str = "byte", file_bytes: int = 32 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ascending ranges of the key as files below ``folder`` and returns how: one row a file.

    A range partition is one file. The file gets its name only when it is whole, and a repeated
    task writes the same bytes again, so lost executors leave nothing half done.
    """
    size = size_estimate(docs)
    files = -(-size // file_bytes) if size < 1 << 60 else docs.rdd.getNumPartitions()  # of frames that are not files Spark knows no size
    n = max(1, files, docs.sparkSession.sparkContext.defaultParallelism)
    dealt = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/part-{context.partitionId():06d}.planes"
        draft = f"{name}.{context.taskAttemptId()}.draft"
        writer = sink = None
        for keys, ids in encoded(batches, vocabulary, end_id):
            if writer is None:
                sink = store.open_output_stream(draft)
                writer = PlaneWriter(sink, block, planes)
            for doc, one in zip(keys, ids, strict=True):
                writer.add(NO_KEY if doc is None else doc, one)
        if writer is None:
            return
        size = writer.close()
        sink.close()
        store.move(draft, name)
        yield pa.RecordBatch.from_pylist([{"part": context.partitionId(), "file": name.rpartition("/")[2], "bytes": size, "docs": len(writer.docs), "ids": writer.total}])

    return dealt.mapInArrow(write, "part long, file string, bytes long, docs long, ids long")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    placed = manifest.withColumn("base", F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as source:
                    reader = PlaneReader(source, row["bytes"])
                    starts = (row["base"] + np.concatenate([[0], np.cumsum(reader.lengths)])[:-1]).astype(np.int64)
                    crc = np.fromiter((zlib.crc32(np.ascontiguousarray(ids)) for _, ids in reader.documents()), np.int64, len(reader.docs))
                    doc = pa.array(reader.docs, pa.int64(), mask=reader.docs == NO_KEY)
                    yield pa.RecordBatch.from_arrays([doc, pa.array(starts), pa.array(reader.lengths), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("file", "bytes", "base").coalesce(1).repartition(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, **how) -> DataFrame:
    """Writes the files and reads them back."""
    scratch = Scratch(spark, "token-files")
    folder = folder or scratch.path("files")
    manifest = scratch.save(write_token_files(docs, folder, vocabulary or vocabulary_path(), **how), "manifest")
    return read_token_files(manifest, folder)
