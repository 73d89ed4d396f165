"""The library in SQL: tables as views, files as sources, expressions as functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from weftline.session import ship
from weftline.sources import archive, flat_tokens, formats, records

_KINDS = " ".join(f"WHEN weft_extension(path) IN ({', '.join(repr(e) for e in exts)}) THEN '{kind}'" for kind, exts in formats.KINDS.items())

#: SQL functions by signature; each is an expression that Catalyst inlines.
FUNCTIONS = {
    "weft_extension(path STRING) RETURNS STRING": "regexp_extract(lower(path), '[.]([^./]+)$', 1)",
    "weft_format(path STRING) RETURNS STRING": f"CASE {_KINDS} ELSE 'unknown' END",
    "weft_uniform(seed BIGINT, epoch BIGINT, sample BIGINT, draw STRING) RETURNS DOUBLE": "CAST(conv(substr(md5(concat(seed, ':', epoch, ':', sample, ':', draw)), 1, 13), 16, 10) AS BIGINT) / 4503599627370496D",
    "weft_order_key(seed BIGINT, epoch BIGINT, sample BIGINT) RETURNS STRING": "md5(concat(seed, ':', epoch, ':', sample))",
    "weft_below(n BIGINT, seed BIGINT, epoch BIGINT, sample BIGINT, draw STRING) RETURNS BIGINT": "pmod(CAST(conv(substr(md5(concat(seed, ':', epoch, ':', sample, ':', draw)), 1, 13), 16, 10) AS BIGINT), n)",
}


def register(spark: SparkSession, tables: dict[str, str] | None = None) -> SparkSession:
    """Adds the functions, the sources `archive`, `records` and `tokens`, and Parquet tables (name: path) as views."""
    ship(spark)
    for source in (archive, records, flat_tokens):
        source.register(spark)
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    for name, path in (tables or {}).items():
        spark.read.parquet(path).createOrReplaceTempView(name)
    return spark
