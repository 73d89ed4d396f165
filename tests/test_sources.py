"""Files, addresses and sources by index: odd inputs, errors, retries."""

from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import interface
from weftline.operators import mapped
from weftline.sources import archive, codecs, csv_files, flat_tokens, image_files, records, remote


def test_csv_cells_and_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;text\n1;"a ""quoted"" ; cell"\n\n2;"two\nlines"\n3;\n;  x \n')
    got = [tuple(r) for r in csv_files.scan(spark, str(tmp_path), ";").collect()]
    assert got == [("1", 'a "quoted" ; cell'), ("2", "two\nlines"), ("3", ""), ("", "  x ")]
    assert [tuple(r) for r in csv_files.scan(spark, str(tmp_path), ";", skip_rows=1, max_rows=2, columns=[1, 7]).collect()] == [("two\nlines",), ("",)]
    assert [r["text"] for r in csv_files.scan(spark, str(tmp_path), ";", trim=True, skip_rows=3).collect()] == ["x"]
    rows = csv_files.scan(spark, str(tmp_path), ";", header=False, max_rows=1)
    assert rows.columns == ["column_0", "column_1"] and tuple(rows.first()) == ("id", "text")
    assert csv_files.column(rows, "nope").count() == 0 and csv_files.column(rows, "column_1").count() == 1


def test_csv_files_in_order_of_names(spark, tmp_path):
    for name, low in (("b", 100), ("a", 0), ("c", 200)):
        (tmp_path / f"{name}.csv").write_text("x\n" + "".join(f"{low + i}\n" for i in range(100)))
    assert [int(r["x"]) for r in csv_files.scan(spark, str(tmp_path), skip_rows=95, max_rows=110, multiline=False).collect()] == list(range(95, 205))


def test_token_files(spark, tmp_path):
    (tmp_path / "b.bin").write_bytes(np.arange(10, 25, dtype="<u4").tobytes())
    (tmp_path / "a.bin").write_bytes(np.arange(10, dtype="<u4").tobytes())
    (tmp_path / "c.bin").write_bytes(b"")
    read = flat_tokens.register(spark).read.format("tokens").option("path", str(tmp_path))
    assert sorted(tuple(r) for r in read.option("dtype", "uint32").option("block", "4").load().collect()) == [(i, i) for i in range(25)]
    with pytest.raises(Exception, match="no whole tokens"):
        (tmp_path / "d.bin").write_bytes(b"abc")
        read.option("dtype", "uint32").load().count()
    with pytest.raises(Exception, match="beyond uint8"):
        flat_tokens.write_tokens(spark.createDataFrame([(300,)], "token long"), str(tmp_path / "out"), "uint8").collect()
    with pytest.raises(ValueError):
        flat_tokens.write_tokens(spark.range(1), str(tmp_path), "float32", "id")
    assert read.option("path", str(tmp_path / "c.bin")).load().count() == 0


BODY = bytes(range(256)) * 4


class Handler(BaseHTTPRequestHandler):
    asked: dict[str, int] = {}

    def do_GET(self):
        n = self.asked[self.path] = self.asked.get(self.path, 0) + 1
        status, body = 200, BODY
        if self.path.startswith("/flaky") and n < 3:
            status, body = 503, b""
        elif self.path == "/down":
            status, body = 500, b""
        elif self.path == "/bucket/error":
            body = b"<?xml version='1.0'?><Error><Code>NoSuchKey</Code></Error>"
        elif self.path == "/none":
            status, body = 404, b""
        elif (wanted := self.headers.get("Range")) and self.path != "/whole":
            low, _, high = wanted.removeprefix("bytes=").partition("-")
            body = BODY[int(low) : int(high) + 1 if high else None]
            status = 206 if int(low) < len(BODY) else 416
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def address():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_ranges_and_retries(address):
    assert remote.fetched(f"{address}/x") == BODY
    assert remote.fetched(f"{address}/x", 10, 5) == remote.fetched(f"{address}/whole", 10, 5) == BODY[10:15]
    assert remote.fetched(f"{address}/x", 1000) == BODY[1000:] and remote.fetched(f"{address}/x", 5000, 1) == b""
    assert remote.fetched(f"{address}/flaky") == BODY and Handler.asked["/flaky"] == 3
    with pytest.raises(OSError, match="404"):
        remote.fetched(f"{address}/none")
    assert Handler.asked["/none"] == 1
    with pytest.raises(OSError, match="500"):
        remote.fetched(f"{address}/down", retries=1)
    assert Handler.asked["/down"] == 2
    with pytest.raises(OSError, match="no answer"):
        remote.fetched("http://127.0.0.1:9/x", retries=0, timeout=2)


def test_object_addresses(address):
    assert remote.object_url("s3://b/k/x") == "https://b.s3.us-east-1.amazonaws.com/k/x"
    assert remote.object_url("s3://b/k", region="eu-west-1", path_style=True) == "https://s3.eu-west-1.amazonaws.com/b/k"
    assert remote.object_url("gs://b/k") == "https://storage.googleapis.com/b/k"
    assert remote.read_one("s3://bucket/key", 3, 2, endpoint=address) == BODY[3:5]
    with pytest.raises(OSError, match="error page"):
        remote.read_one("gs://bucket/error", endpoint=address)
    with pytest.raises(ValueError):
        remote.object_url("s3://bucket")


def test_read_all_keeps_errors_apart(spark, address, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    paths = [f"{address}/x", f"{address}/none", str(tmp_path / "f"), str(tmp_path / "missing"), None]
    got = {r["path"]: r for r in remote.read_all(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert bytes(got[paths[0]]["data"]) == BODY and got[paths[0]]["source"] == "http" and got[paths[0]]["ms"] > 0
    assert got[paths[1]]["error"] == "HTTP 404" and got[paths[1]]["data"] is None and got[paths[1]]["bytes"] == 0
    assert bytes(got[paths[2]]["data"]) == b"abc" and got[paths[2]]["error"] is None and got[paths[2]]["source"] == "local"
    assert got[paths[3]]["error"] and got[None]["error"]


def test_jpeg_files(spark, tmp_path):
    """A smooth image as JPEG, written by the JVM, comes back close to itself."""
    y, x = np.mgrid[0:32, 0:48]
    image = np.stack([x * 5, y * 7, np.full_like(x, 90)], -1).astype(np.uint8)
    (tmp_path / "a.bmp").write_bytes(codecs.encode_bmp(image))
    jvm = spark._jvm
    jvm.javax.imageio.ImageIO.write(jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(tmp_path / "a.bmp"))), "jpg", jvm.java.io.File(str(tmp_path / "b.jpg")))
    got = {r["path"][-5:]: r for r in image_files.scan(spark, str(tmp_path)).collect()}
    assert (np.frombuffer(got["a.bmp"]["data"], np.uint8).reshape(32, 48, 3) == image).all()
    off = np.abs(np.frombuffer(got["b.jpg"]["data"], np.uint8).reshape(32, 48, 3).astype(int) - image)
    assert off.mean() < 4
    (tmp_path / "c.jpg").write_bytes(b"no image")
    assert image_files.scan(spark, str(tmp_path), drop_invalid=True).count() == 2
    with pytest.raises(Exception, match="is no image"):
        image_files.scan(spark, str(tmp_path)).collect()


def test_sources_by_index(spark):
    got = mapped.from_items(spark, [{"a": 1, "b": "x"}, {"b": "y", "a": 2}], "a long, b string", 1).collect()
    assert [tuple(r) for r in got] == [(0, 1, "x"), (1, 2, "y")]
    assert [tuple(r) for r in mapped.from_items(spark, [5, 6], "v long", 1).collect()] == [(0, 5), (1, 6)]
    assert mapped.from_items(spark, [], "v long").count() == 0
    with pytest.raises(TypeError):
        mapped.from_items(spark, iter([1]), "v long")


def test_strict_gathering(spark):
    data = spark.range(5).select(F.col("id").alias("sample_id"), (F.col("id") * 2).alias("v"))
    asked = spark.createDataFrame([(0, 3), (1, 3)], "pos long, sample_id long")
    assert [r["v"] for r in mapped.gathered(data, asked).orderBy("pos").collect()] == [6, 6]
    with pytest.raises(Exception, match="no row has sample_id 99"):
        mapped.gathered(data, spark.createDataFrame([(0, 99)], "pos long, sample_id long")).select("pos").collect()


def test_tensors(spark):
    some = np.random.default_rng(3).integers(0, 256, (3, 2, 4, 3), np.uint8)
    rows = spark.createDataFrame([(0, 2 - i, 2, 4, some[i].tobytes()) for i in range(3)], "batch_id long, pos long, h int, w int, data binary")
    want = some[::-1]
    assert mapped.tensors(rows, "NHWC").first()["data"] == want.tobytes()
    mean, std = [0.5, 0.4, 0.3], [0.2, 0.25, 0.3]
    got = np.frombuffer(mapped.tensors(rows, "NCHW", mean, std).first()["data"], "<f4").reshape(3, 3, 2, 4)
    assert np.allclose(got, ((want / 255 - mean) / std).transpose(0, 3, 1, 2), atol=1e-5)
    assert mapped.tensors(rows.limit(0)).count() == 0
    with pytest.raises(Exception, match="2 sizes in one batch"):
        mapped.tensors(rows.withColumn("h", F.when(F.col("pos") == 0, 4).otherwise(2)).withColumn("w", F.when(F.col("pos") == 0, 2).otherwise(4))).collect()
    for bad in ({"layout": "HWC"}, {"mean": mean}, {"mean": mean, "std": [0, 1, 1]}):
        with pytest.raises(ValueError):
            mapped.tensors(rows, **bad)


def test_archive_members_to_records(spark, tmp_path):
    image = np.full((3, 5, 3), 9, np.uint8)
    rows = spark.createDataFrame([("a.png", codecs.encode_png(image)), ("b.txt", b"hello, no image"), ("c.bmp", codecs.encode_bmp(image)), ("d.png", b"")], "name string, content binary").coalesce(1)
    assert archive.to_records(rows, str(tmp_path)).first()["samples"] == 2
    back = records.register(spark).read.format("records").option("path", str(tmp_path)).option("payload", "true").load().orderBy("sample_id").collect()
    assert [(r["format"], r["width"], r["height"]) for r in back] == [("png", 5, 3), ("bmp", 5, 3)]
    assert (codecs.decode(bytes(back[0]["content"])) == image).all()


def test_sql_functions(spark):
    interface.register(spark)
    row = spark.sql("SELECT weft_format('s3://b/x.JPEG') AS f, weft_format('x') AS u, weft_extension('/a.b/c.Tar') AS e, weft_below(10, 1, 0, 3, 'd') AS b").first()
    assert (row["f"], row["u"], row["e"]) == ("jpeg", "unknown", "tar") and 0 <= row["b"] < 10
