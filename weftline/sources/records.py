"""Indexed binary record files: a data source for the index and payloads, and a writer.

Layout, little-endian: a header of 64 bytes, an index entry of 24 bytes a sample, payloads, metadata
blocks. ``spark.read.format("records")`` gives the index; ``payload=true`` adds contents, decompressed and,
with ``verify=true``, checked. Filters on format are applied to the index. 0 as a size is null.
"""

from __future__ import annotations

import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from weftline.sources.store import listed, opened, published

#: Fixed values of the format.
MAGIC, VERSION = b"TBL\x02", 2
HEADER, ENTRY, BLOCK = struct.Struct("<4sIQIIQQII16s"), struct.Struct("<QIIHHBBH"), struct.Struct("<QIHH")
FORMATS = {0: "unknown", 1: "jpeg", 2: "png", 3: "webp", 4: "bmp", 5: "tiff", 6: "mp4", 7: "avi", 8: "raw_u8"}
FILE_COMPRESSED, FILE_METADATA, FILE_CHECKSUMS = 1, 2, 4
SAMPLE_COMPRESSED, SAMPLE_METADATA = 1, 2
METADATA = {0: "none", 1: "json", 2: "protobuf", 3: "msgpack", 255: "custom"}
_CODES = {name: code for code, name in FORMATS.items()}
_KINDS = {name: code for code, name in METADATA.items()}

SCHEMA = "file string, sample_id long, offset long, size long, raw_size long, width int, height int, format string, compressed boolean, crc16 int, content binary, metadata_type string, metadata binary"


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xA001 if byte & 1 else 0)
        out.append(byte)
    return out


_TABLE = _crc_table()


def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc = crc >> 8 ^ _TABLE[(crc ^ byte) & 0xFF]
    return crc


def _codec():
    import pyarrow as pa

    return pa.Codec("lz4_raw")


def read_header(f) -> tuple[int, int, int, int]:
    """Samples, metadata offset and size, flags; raises on anything that is not such a file."""
    raw = f.read(HEADER.size)
    if len(raw) < HEADER.size:
        raise ValueError("too short for a record file")
    magic, version, n, _, _, at, size, flags, crc, _ = HEADER.unpack(raw)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a record file, or of another version")
    if flags & FILE_CHECKSUMS and zlib.crc32(raw[:44] + bytes(4) + raw[48:]) != crc:
        raise ValueError("the header's checksum is wrong")
    if HEADER.size + n * ENTRY.size > f.size():
        raise ValueError("the index goes beyond the file")
    return n, at, size, flags


def read_metadata(f, at: int, size: int) -> dict[int, tuple[str, bytes]]:
    """The first block of each sample."""
    out: dict[int, tuple[str, bytes]] = {}
    f.seek(at)
    data, low = f.read(size), 0
    while low + BLOCK.size <= len(data):
        sample, n, kind, _ = BLOCK.unpack_from(data, low)
        low += BLOCK.size
        out.setdefault(sample, (METADATA.get(kind, "custom"), data[low : low + n]))
        low += n
    return out


class RecordPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = listed(options["path"], options.get("glob", "*.tbl"))
        self.payload, self.verify, self.meta = (options.get(k, "false").lower() == "true" for k in ("payload", "verify", "metadata"))
        self.format: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("format",) and self.format is None:
                self.format = f.value
            else:
                yield f

    def partitions(self) -> list[RecordPartition]:
        return [RecordPartition(p) for p in self.files]

    def read(self, partition: RecordPartition) -> Iterator[tuple]:
        with opened(partition.path) as f:
            n, at, size, _ = read_header(f)
            index = f.read(n * ENTRY.size)
            notes = read_metadata(f, at, size) if self.meta and at else {}
            for i in range(n):
                offset, stored, raw, w, h, code, flags, crc = ENTRY.unpack_from(index, i * ENTRY.size)
                kind = FORMATS.get(code, "unknown")
                if self.format is not None and kind != self.format:
                    continue
                packed, content = bool(flags & SAMPLE_COMPRESSED), None
                if self.payload:
                    f.seek(offset)
                    content = f.read(stored)
                    if packed:
                        content = _codec().decompress(content, raw, asbytes=True)
                    if self.verify and crc16(content) != crc:
                        raise ValueError(f"sample {i} of {partition.path}: wrong checksum")
                yield (partition.path, i, offset, stored, raw, w or None, h or None, kind, packed, crc, content, *notes.get(i, (None, None)))


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordSource)
    return spark


def _framed(entries: list[tuple], notes: list[tuple[int, bytes]], flags: int, payload: int) -> tuple[bytes, bytes, bytes]:
    """Header, index and metadata blocks around a payload of so many bytes."""
    base = HEADER.size + len(entries) * ENTRY.size
    blocks = b"".join(BLOCK.pack(i, len(x), _KINDS["json"], 0) + x for i, x in notes)
    fields = [MAGIC, VERSION, len(entries), base & 0xFFFFFFFF, 0, base + payload if notes else 0, len(blocks), flags]
    crc = zlib.crc32(HEADER.pack(*fields, 0, bytes(16)))
    return HEADER.pack(*fields, crc, bytes(16)), b"".join(ENTRY.pack(e[0] + base, *e[1:]) for e in entries), blocks


def write_records(df: DataFrame, folder: str, compress: bool = False, checksums: bool = True) -> DataFrame:
    """df: content, format, width, height and, if given, metadata (JSON). One file a partition, in partition order.

    Payloads go to a spool first, since the index before them holds their places; memory holds the index only.
    LZ4 is kept where it is smaller. Returns (file, samples, bytes).
    """
    import pyarrow as pa
    from pyspark import TaskContext

    with_notes = "metadata" in df.columns

    def run(batches):
        context = TaskContext.get()
        entries, notes, flags = [], [], FILE_CHECKSUMS
        with tempfile.TemporaryFile() as spool:
            at = 0
            for batch in batches:
                for row in batch.to_pylist():
                    raw = row["content"] or b""
                    stored, mark = raw, 0
                    if compress and raw:
                        packed = _codec().compress(raw, asbytes=True)
                        if len(packed) < len(raw):
                            stored, mark = packed, SAMPLE_COMPRESSED
                            flags |= FILE_COMPRESSED
                    if with_notes and row["metadata"] is not None:
                        notes.append((len(entries), row["metadata"].encode()))
                        mark |= SAMPLE_METADATA
                        flags |= FILE_METADATA
                    entries.append((at, len(stored), len(raw), row["width"] or 0, row["height"] or 0, _CODES.get(row["format"], 0), mark, crc16(raw) if checksums else 0))
                    spool.write(stored)
                    at += len(stored)
            name = f"part-{context.partitionId():06d}.tbl"
            with published(folder, name, str(context.taskAttemptId())) as sink:
                head, index, blocks = _framed(entries, notes, flags, at)
                sink.write(head + index)
                spool.seek(0)
                while data := spool.read(1 << 20):
                    sink.write(data)
                sink.write(blocks)
                size = sink.size()
        yield pa.RecordBatch.from_pylist([{"file": name, "samples": len(entries), "bytes": size}])

    columns = ["content", "format", "width", "height", *(["metadata"] if with_notes else [])]
    return df.select(columns).mapInArrow(run, "file string, samples long, bytes long")


def raw_view(index: DataFrame) -> tuple[int, int]:
    """(height, width) of files that hold uncompressed raw images of one size; raises and says why otherwise."""
    from pyspark.sql import functions as F

    raw = F.col("format") == "raw_u8"
    row = index.agg(F.count("*").alias("n"), F.count_if(~raw).alias("other"), F.count_if("compressed").alias("packed"), F.countDistinct("height", "width").alias("sizes"), F.count_if(F.col("size") != F.col("height") * F.col("width") * 3).alias("odd"), F.first("height").alias("h"), F.first("width").alias("w")).first()
    for bad, why in ((not row["n"], "no samples"), (row["other"], "samples that are not raw"), (row["packed"], "compressed samples"), (row["sizes"] > 1, "several sizes"), (row["odd"], "samples whose size is not height * width * 3")):
        if bad:
            raise ValueError(f"no fixed-width view: {why}")
    return row["h"], row["w"]


def images(content: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(content, np.uint8).reshape(h, w, 3)
