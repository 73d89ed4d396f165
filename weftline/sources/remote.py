"""Reads over HTTP and object stores' HTTP gates: ranges, retries, and a result that carries its error."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.formats import by_scheme
from weftline.sources.store import read_range

#: Statuses that are worth another try, and the first pause in seconds, which doubles.
RETRIED = (408, 429, 500, 502, 503, 504)
FIRST_PAUSE = 0.1
RESULT = "data binary, error string, ms double, bytes long, source string"


def object_url(uri: str, endpoint: str | None = None, region: str = "us-east-1", path_style: bool = False) -> str:
    """The HTTP address of s3://bucket/key or gs://bucket/key; an endpoint of one's own is addressed by path."""
    scheme, rest = uri.split("://", 1)
    bucket, _, key = rest.partition("/")
    if not bucket or not key:
        raise ValueError(f"no bucket or no key: {uri}")
    if endpoint:
        return f"{endpoint.rstrip('/')}/{bucket}/{key}"
    if scheme == "gs":
        return f"https://storage.googleapis.com/{bucket}/{key}"
    return f"https://s3.{region}.amazonaws.com/{bucket}/{key}" if path_style else f"https://{bucket}.s3.{region}.amazonaws.com/{key}"


def fetched(url: str, offset: int = 0, size: int | None = None, retries: int = 3, timeout: float = 30, headers: dict[str, str] | None = None) -> bytes:
    """A body or a range of it. Broken connections and ``RETRIED`` statuses are tried again; other statuses raise at once."""
    wanted = dict(headers or {})
    if offset or size is not None:
        wanted["Range"] = f"bytes={offset}-" + ("" if size is None else str(offset + size - 1))
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=wanted), timeout=timeout) as answer:
                body = answer.read()
                # A server that knows no ranges sends the whole.
                return body if "Range" not in wanted or answer.status == 206 else body[offset : None if size is None else offset + size]
        except urllib.error.HTTPError as e:
            if e.code == 416:  # beyond the end
                return b""
            if e.code not in RETRIED or attempt == retries:
                raise OSError(f"HTTP {e.code}") from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if attempt == retries:
                raise OSError(f"no answer: {e}") from e
        time.sleep(FIRST_PAUSE * 2**attempt)
    raise AssertionError


def read_one(path: str, offset: int = 0, size: int | None = None, endpoint: str | None = None, retries: int = 3) -> bytes:
    """Any path: HTTP, object stores (by their gate where an endpoint is given, else by Arrow's store), local files."""
    low = path.lower()
    if size == 0:
        return b""
    if low.startswith(("http://", "https://")):
        return fetched(path, offset, size, retries)
    if endpoint and low.startswith(("s3://", "gs://")):
        body = fetched(object_url(path, endpoint), offset, size, retries)
        if body.lstrip()[:6] == b"<?xml " and b"<Error>" in body[:4096]:
            raise OSError("the store answered with an error page")
        return body
    return read_range(path, offset, size)


def read_all(paths: DataFrame, path: str = "path", endpoint: str | None = None, retries: int = 3) -> DataFrame:
    """Adds data, error, ms, bytes and source to a table of paths; offset and size columns, if there are any, ask for ranges.

    A path that cannot be read has a null data and its error; the others go on. Rows leave a task one by one, so memory
    holds one body of a batch at a time.
    """
    extra = [c for c in ("offset", "size") if c in paths.columns]
    rows = paths.select(F.col(path).cast("string").alias("path"), *(F.col(c).cast("long").alias(c) for c in extra), by_scheme(F.col(path)).alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                began, data, error = time.perf_counter(), None, None
                try:
                    data = read_one(row["path"], row.get("offset") or 0, row.get("size"), endpoint, retries)
                except (OSError, ValueError, AttributeError, pa.ArrowException) as e:
                    error = str(e) or type(e).__name__
                ms = (time.perf_counter() - began) * 1000
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]], pa.string()), *(pa.array([row[c]], pa.int64()) for c in extra), pa.array([data], pa.binary()), pa.array([error], pa.string()), pa.array([ms]), pa.array([len(data or b"")], pa.int64()), pa.array([row["source"]], pa.string())], names=["path", *extra, "data", "error", "ms", "bytes", "source"])

    return rows.mapInArrow(run, ", ".join(["path string", *(f"{c} long" for c in extra), RESULT]))
