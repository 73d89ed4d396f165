"""Archives, record files, image kernels, streams: what SQL has no word for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weftline.catalog import query, table
from weftline.catalog.images import PIXELS, N
from weftline.operators import mapped, multi, order, transforms
from weftline.shared import folder, sharded
from weftline.sources import archive, codecs, records
from weftline.streaming import buckets


def _images(spark, sf_dir):
    return transforms.rows_from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _encoded(spark, sf_dir, kind: str):
    @F.pandas_udf("binary")
    def encode(h: pd.Series, w: pd.Series, data: pd.Series) -> pd.Series:
        write = codecs.encode_bmp if kind == "bmp" else codecs.encode_png
        return pd.Series([write(np.frombuffer(d, np.uint8).reshape(a, b, 3)) for a, b, d in zip(h, w, data, strict=True)])

    return _images(spark, sf_dir).select("img", "h", "w", "data", encode("h", "w", "data").alias("content"))


@query("archive_roundtrip", "SELECT doc_id || '.txt' AS name, 'txt' AS ext, octet_length(encode(text)) AS size, md5(text) AS md5 FROM documents UNION ALL SELECT doc_id || '.json', 'json', length('{\"label\": ' || quality || '}'), md5('{\"label\": ' || quality || '}') FROM labels")
def archive_roundtrip(spark, sf_dir):
    """Documents and labels as members of TAR shards, read back: name, size, ext."""
    docs = table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("name"), F.col("text").alias("content"))
    labels = table(spark, sf_dir, "labels").select(F.concat("doc_id", F.lit(".json")).alias("name"), F.concat(F.lit('{"label": '), "quality", F.lit("}")).alias("content"))
    to = folder(spark, "archive")
    archive.write_archives(sharded(docs.unionByName(labels), "name", 4), to).collect()
    back = archive.register(spark).read.format("archive").option("path", to).load()
    return back.select("name", "ext", "size", F.md5("content").alias("md5"))


@query("archive_index")
def archive_index(spark, sf_dir):
    """The JSON members' ordinals alone: the extension is pushed into the header scan, payloads stay unread."""
    labels = table(spark, sf_dir, "labels").select(F.concat("doc_id", F.lit(".json")).alias("name"), F.lit("{}").alias("content"))
    to = folder(spark, "archive")
    archive.write_archives(sharded(labels, "name", 2), to).collect()
    back = archive.register(spark).read.format("archive").option("path", to).option("content", "false").load()
    return back.filter("ext = 'json'").select("name", "ordinal", "size")


@query("folder_archive")
def folder_archive(spark, sf_dir):
    """Class folders to shards: names keep their relative path, classes are numbered in sorted order."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("/data/root/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    classed = archive.folder_classes(docs, root="root")
    to = folder(spark, "folder")
    archive.write_archives(sharded(classed, "name", 3), to).collect()
    back = archive.register(spark).read.format("archive").option("path", to).load()
    return back.join(classed.select("name", "class", "label"), "name").select("name", "class", "label", "size")


@query("records_roundtrip", f"WITH p AS ({PIXELS}) SELECT img, {N} AS width, {N} AS height, 'raw_u8' AS format, md5(unhex(string_agg(printf('%02x', v), '' ORDER BY y, x, c))) AS md5 FROM p GROUP BY img")
def records_roundtrip(spark, sf_dir):
    """Raw images with JSON notes in indexed record files, LZ4 where smaller, read back and checked."""
    rows = _images(spark, sf_dir).select(F.col("data").alias("content"), F.lit("raw_u8").alias("format"), F.col("w").alias("width"), F.col("h").alias("height"), F.concat(F.lit('{"id": '), "img", F.lit("}")).alias("metadata"), "img")
    to = folder(spark, "records")
    records.write_records(sharded(rows, "img", 4), to, compress=True).collect()
    back = records.register(spark).read.format("records").option("path", to).option("payload", "true").option("verify", "true").option("metadata", "true").load()
    return back.select(F.get_json_object(F.col("metadata").cast("string"), "$.id").cast("long").alias("img"), "width", "height", "format", F.md5("content").alias("md5"))


@query("preprocess")
def preprocess(spark, sf_dir):
    """BMP archive, decoded and resized once, as raw records that a fixed-width view takes."""
    bmp = _encoded(spark, sf_dir, "bmp").select(F.concat(F.format_string("%06d", "img"), F.lit(".bmp")).alias("name"), "content")
    tar, out = folder(spark, "archive"), folder(spark, "records")
    archive.write_archives(sharded(bmp, "name", 3), tar).collect()

    members = archive.register(spark).read.format("archive").option("path", tar).load()
    images = mapped.arrow_images(members.select(F.regexp_extract("name", r"(\d+)", 1).alias("img"), "content"), codecs.decode)
    small = transforms.chain(("Resize", 4, 4)).apply(images)
    rows = small.select(F.col("data").alias("content"), F.lit("raw_u8").alias("format"), F.col("w").alias("width"), F.col("h").alias("height"), "img")
    records.write_records(sharded(rows, "img", 2, of=bmp), out).collect()
    index = records.register(spark).read.format("records").option("path", out).load()
    h, w = records.raw_view(index)
    back = spark.read.format("records").option("path", out).option("payload", "true").load()
    return back.select("file", "sample_id", F.lit(h).alias("h"), F.lit(w).alias("w"), F.md5("content").alias("md5")).withColumn("file", F.regexp_extract("file", "([^/]+)$", 1))


@query("image_heads", f"SELECT vec_id AS img, {N} AS w, {N} AS h FROM embeddings")
def image_heads(spark, sf_dir):
    """Width and height from the first bytes of PNG files."""

    @F.pandas_udf("struct<w int, h int>")
    def size(heads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([codecs.size_of(h) for h in heads], columns=["w", "h"]).astype("int32")

    return _encoded(spark, sf_dir, "png").select("img", size(F.substring("content", 1, 64)).alias("s")).select("img", "s.w", "s.h")


def _kernel(name: str, *steps: tuple) -> None:
    @query(name)
    def run(spark, sf_dir):
        return transforms.chain(*steps, seed=11, epoch=1).apply(_images(spark, sf_dir)).select("img", "h", "w", F.md5("data").alias("md5"))

    run.__name__, run.__doc__ = name, "Arrow: " + ", ".join(s[0] for s in steps)


_kernel("resize_bicubic", ("Resize", 5, 11, "bicubic"))
_kernel("resize_lanczos", ("Resize", 5, 11, "lanczos"))
_kernel("resize_antialias", ("Resize", 3, 3, "antialias"))
_kernel("blur", ("GaussianBlur", 5, 1.2))
_kernel("sharpness", ("Sharpness", 1.8))
_kernel("rotate", ("Rotate", 30, True))
_kernel("random_affine", ("RandomAffine", 20, 0.1, 0.1, (0.8, 1.2), 10))
_kernel("random_perspective", ("RandomPerspective", 0.3, 0.7))
_kernel("color_jitter", ("ColorJitter", 0.4, 0.4, 0.4, 0.1))
_kernel("autoaugment", ("AutoAugment", "imagenet"))
_kernel("randaugment", ("RandAugment", 2, 9))
_kernel("trivialaugment", ("TrivialAugment",))
_kernel("transform_chain", ("Resize", 16, 16), ("RandomHorizontalFlip",), ("ColorJitter", 0.2), ("CenterCrop", 8, 8), ("Solarize", 200))


@query("mosaic")
def mosaic(spark, sf_dir):
    """Four images in a row, around a drawn centre."""
    rows = order.with_sample_id(_images(spark, sf_dir), "img", "pos")
    return transforms.mosaics(multi.groups_of(rows, 4, ["data", "h", "w"]), 32, seed=4).select("img", "h", "w", F.md5("data").alias("md5"))


@query("stream_smart_batch")
def stream_smart_batch(spark, sf_dir):
    """Parts streamed into size buckets of 16; what is left at the end is given out too."""
    schema = table(spark, sf_dir, "part").schema
    bucketed = lambda df: df.select(F.concat(F.lit("w"), F.floor(F.col("p_size") / 8)).alias("bucket"), F.col("p_partkey").alias("sample_id"))
    stream = bucketed(spark.readStream.schema(schema).option("pathGlobFilter", "part.parquet").parquet(sf_dir))
    to = folder(spark, "stream")
    run = buckets.size_batches(stream, 16).writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    full = spark.read.schema("bucket string, batch long, sample_ids array<long>").parquet(f"{to}/out")
    rest = bucketed(table(spark, sf_dir, "part")).join(full.select(F.explode("sample_ids").alias("sample_id")), "sample_id", "left_anti")
    tail = rest.groupBy("bucket").agg(F.lit(-1).cast("long").alias("batch"), F.array_sort(F.collect_list("sample_id")).alias("sample_ids"))
    return full.unionByName(tail).select("bucket", "batch", F.size("sample_ids").alias("n"), F.array_join(F.transform(F.array_sort("sample_ids"), lambda x: x.cast("string")), ",").alias("ids"))


@query("stream_tumbling")
def stream_tumbling(spark, sf_dir):
    """Hourly counts of a stream of events, as far as the watermark closed them."""
    schema = table(spark, sf_dir, "events").schema
    stream = buckets.tumbling(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    to = folder(spark, "stream")
    run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{to}/out")
