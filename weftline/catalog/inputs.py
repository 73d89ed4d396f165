"""Sources by file kind and by index, functions of whole batches, batches as tensors, the SQL interface."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weftline import interface
from weftline.catalog import query, table
from weftline.catalog.images import PIXELS, N
from weftline.catalog.loading import _TOKENS, _tokens
from weftline.catalog.samples import ids, shuffled_sql, udraw
from weftline.functions import rng
from weftline.operators import batch, mapped, order, transforms
from weftline.shared import folder, sharded
from weftline.sources import archive, codecs, csv_files, flat_tokens, image_files, records, remote


def _images(spark, sf_dir):
    return transforms.rows_from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _png(spark, sf_dir):
    @F.pandas_udf("binary")
    def encode(h: pd.Series, w: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([codecs.encode_png(np.frombuffer(d, np.uint8).reshape(a, b, 3)) for a, b, d in zip(h, w, data, strict=True)])

    return _images(spark, sf_dir).select("img", F.concat(F.format_string("%08d", "img"), F.lit(".png")).alias("name"), encode("h", "w", "data").alias("content"))


_CSV = "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, coalesce(text, '') AS text FROM conversations ORDER BY conversations.conv_id, conversations.turn, text"


def _csv(spark, sf_dir, header: bool):
    to = folder(spark, "csv")
    rows = sharded(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", 3).sortWithinPartitions("conv_id", "turn", "text")
    rows.write.option("header", header).option("escape", '"').csv(to)
    return to


@query("csv_scan", _CSV)
def csv_scan(spark, sf_dir):
    """Three of four columns of CSV files with quoted commas and line ends, all cells text."""
    return csv_files.scan(spark, _csv(spark, sf_dir, True), columns=[0, 1, 3, 9])


@query("csv_rows", f"SELECT conv_id AS column_0, turn AS column_1 FROM ({_CSV} LIMIT 300 OFFSET 120)")
def csv_rows(spark, sf_dir):
    """Rows 120 to 419 in file order, columns without a header."""
    return csv_files.scan(spark, _csv(spark, sf_dir, False), header=False, skip_rows=120, max_rows=300, columns=[0, 1])


@query("token_files_scan", _TOKENS)
def token_files_scan(spark, sf_dir):
    """Token ids written as flat files of 16 bits and read by ranges, with their places."""
    to = folder(spark, "tokens")
    flat_tokens.write_tokens(sharded(_tokens(spark, sf_dir), "pos", 4), to).collect()
    return flat_tokens.register(spark).read.format("tokens").option("path", to).option("dtype", "uint16").option("block", "700").load()


@query("image_files", f"WITH p AS ({PIXELS}) SELECT printf('%08d.png', img) AS name, {N} AS h, {N} AS w, md5(unhex(string_agg(printf('%02x', v), '' ORDER BY y, x, c))) AS md5 FROM p GROUP BY img")
def image_scan(spark, sf_dir):
    """Image files by Spark's image reader, as RGB rows."""
    to = folder(spark, "images")
    archive.write_files(_png(spark, sf_dir), to).collect()
    return image_files.scan(spark, to).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "h", "w", F.md5("data").alias("md5"))


@query("unified_read", "SELECT s_suppkey, s_suppkey % 7 = 0 AS failed, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE octet_length(encode(s_name)) - s_suppkey % 3 END AS bytes, 'local' AS source FROM supplier")
def unified_read(spark, sf_dir):
    """Ranges of files by path, with error, time, size and kind of source; missing files do not stop the others."""
    to = folder(spark, "files")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    archive.write_files(rows.select(F.concat("s_suppkey", F.lit(".txt")).alias("name"), F.col("s_name").alias("content")), to).collect()
    there = F.when(F.col("s_suppkey") % 7 == 0, "none").otherwise("txt")
    paths = rows.select(F.concat(F.lit(f"{to}/"), "s_suppkey", F.lit("."), there).alias("path"), (F.col("s_suppkey") % 3).alias("offset"))
    got = remote.read_all(paths)
    return got.select(F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long").alias("s_suppkey"), F.col("error").isNotNull().alias("failed"), "bytes", "source")


class Squares:
    """A source by index."""

    def __len__(self) -> int:
        return 5000

    def __getitem__(self, i: int) -> tuple[int, str]:
        return i * i % 97, f"item-{i}"


@query("map_source", "SELECT range AS sample_id, range * range % 97 AS x, 'item-' || range AS name FROM range(5000)")
def map_source(spark, sf_dir):
    """Any object with __getitem__ and __len__; workers ask for the items."""
    return mapped.from_items(spark, Squares(), "x long, name string")


@query("collate_function", f"SELECT sample_id // 32 AS batch_id, max(n_chars) AS longest, sum(n_chars) / (count(*) * max(n_chars)) AS filled FROM ({ids('documents', 'doc_id', 'doc_id, n_chars')}) GROUP BY 1")
def collate_function(spark, sf_dir):
    """A collate function of one's own: the padded length of each batch and the share that is text."""
    def padded(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows["n_chars"]
        return pd.DataFrame({"batch_id": rows["batch_id"][:1], "longest": [n.max()], "filled": [n.sum() / (len(n) * n.max())]})

    rows = batch.fixed(order.with_sample_id(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"), 32, "sample_id")
    return mapped.collated_by(rows, padded, "batch_id long, longest long, filled double", order="row_in_batch")


@query("label_function", "SELECT page_id, length(url) % 10 AS label FROM pages")
def label_function(spark, sf_dir):
    return mapped.labelled_by(table(spark, sf_dir, "pages").select("page_id", "url"), lambda url: len(url) % 10, "url").select("page_id", "label")


_BLOCK = "md5(unhex(string_agg(printf('%02x', v), '' ORDER BY {}))) AS md5"


@query("batch_tensor", f"WITH p AS ({PIXELS}), s AS ({ids('embeddings', 'vec_id', 'vec_id AS img')}) SELECT sample_id // 16 AS batch_id, count(DISTINCT img) AS n, {N} AS h, {N} AS w, {_BLOCK.format('sample_id, c, y, x')} FROM p JOIN s USING (img) GROUP BY 1")
def batch_tensor(spark, sf_dir):
    """Images of a batch as one dense block of channels, rows and columns."""
    rows = order.with_sample_id(_images(spark, sf_dir), "img")
    return mapped.tensors(batch.fixed(rows, 16, "sample_id").withColumn("pos", F.col("row_in_batch"))).select("batch_id", "n", "h", "w", F.md5("data").alias("md5"))


@query("raw_serve", f"WITH p AS ({PIXELS}), s AS ({shuffled_sql('embeddings', 'vec_id', 6, 2, 'vec_id AS img')}), r AS (SELECT *, pos // 16 AS batch_id, {udraw(6, 2, 'sample_id', 'flip')} < 0.5 AS flip FROM s) SELECT batch_id, count(DISTINCT img) AS n, {_BLOCK.format(f'pos, y, CASE WHEN flip THEN {N - 1} - x ELSE x END, c')} FROM p JOIN r USING (img) WHERE batch_id >= 2 GROUP BY 1")
def raw_serve(spark, sf_dir):
    """Raw records as an epoch serves them: order, mirror, stack; from the third batch on."""
    to = folder(spark, "records")
    rows = _images(spark, sf_dir).select(F.col("data").alias("content"), F.lit("raw_u8").alias("format"), F.col("w").alias("width"), F.col("h").alias("height"), F.to_json(F.struct("img")).alias("metadata"), "img")
    records.write_records(sharded(rows, "img", 4), to).collect()
    back = records.register(spark).read.format("records").option("path", to).option("payload", "true").option("metadata", "true").load()
    h, w = records.raw_view(back.drop("content"))
    images = order.with_sample_id(back.select(F.get_json_object(F.col("metadata").cast("string"), "$.img").cast("long").alias("img"), F.lit(h).alias("h"), F.lit(w).alias("w"), F.col("content").alias("data")), "img")
    plan = batch.resumed(batch.fixed(order.shuffled(images.select("sample_id"), 6, 2), 16), 2)
    return mapped.served(images, plan, rng.uniform(6, 2, F.col("sample_id"), "flip"), layout="NHWC").select("batch_id", "n", F.md5("data").alias("md5"))


@query("archive_to_records", f"SELECT printf('%08d.png', vec_id) AS name, {N} AS width, {N} AS height, 'png' AS format FROM embeddings")
def archive_to_records(spark, sf_dir):
    """PNG members of archives as record files; notes are no images and stay out."""
    tar, out = folder(spark, "archive"), folder(spark, "records")
    png = _png(spark, sf_dir).select("name", "content")
    notes = table(spark, sf_dir, "region").select(F.concat("r_name", F.lit(".txt")).alias("name"), F.col("r_name").cast("binary").alias("content"))
    archive.write_archives(sharded(png.unionByName(notes), "name", 3), tar).collect()
    archive.to_records(archive.register(spark).read.format("archive").option("path", tar).load(), out).collect()
    back = records.register(spark).read.format("records").option("path", out).option("metadata", "true").load()
    return back.select(F.get_json_object(F.col("metadata").cast("string"), "$.name").alias("name"), "width", "height", "format")


@query("sql_interface", f"SELECT sample_id % 4 AS part, count(*) AS n, round(sum({udraw(9, 1, 'sample_id', 'x')}), 6) AS total, min({udraw(9, 1, 'sample_id', 'x')}) AS least FROM (SELECT vec_id AS sample_id FROM embeddings) GROUP BY 1")
def sql_interface(spark, sf_dir):
    """The same draws by SQL functions over a registered view."""
    interface.register(spark, {"weft_embeddings": f"{sf_dir}/embeddings.parquet"})
    return spark.sql("SELECT vec_id % 4 AS part, count(*) AS n, round(sum(weft_uniform(9, 1, vec_id, 'x')), 6) AS total, min(weft_uniform(9, 1, vec_id, 'x')) AS least FROM weft_embeddings GROUP BY 1")
