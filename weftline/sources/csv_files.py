"""CSV files as text columns, with rows skipped and counted in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', header: bool = True, skip_rows: int = 0, max_rows: int | None = None, columns: list[int] | None = None, trim: bool = False, skip_empty: bool = True, multiline: bool = True) -> DataFrame:
    """All cells are text. Without a header columns are column_0, column_1 and so on.

    ``skip_rows`` counts after the header of the whole scan, in order of file names and places in them; ``columns`` are
    numbers, those out of range are left out. Without ``skip_rows`` and ``max_rows`` nothing is sorted. ``multiline``
    keeps quoted line ends together, at the price of one task a file; an empty file has no rows. A row of empty cells
    alone is an empty line.
    """
    reader = spark.read.option("sep", delimiter).option("quote", quote).option("escape", quote).option("header", header).option("multiLine", multiline).option("nullValue", "").option("emptyValue", "")
    rows = reader.option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim).csv(path)
    names = rows.columns
    if not header:
        rows, names = rows.toDF(*(f"column_{i}" for i in range(len(names)))), [f"column_{i}" for i in range(len(names))]
    wanted = [names[i] for i in columns if 0 <= i < len(names)] if columns is not None else names
    cells = [F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in wanted]
    if skip_empty and names:
        rows = rows.filter(F.coalesce(*(F.col(f"`{n}`") for n in names)).isNotNull())
    if not skip_rows and max_rows is None:
        return rows.select(cells)
    at = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row")]
    rows = rows.select(*cells, *at).orderBy("__file", "__block", "__row")
    rows = rows.offset(skip_rows) if skip_rows else rows
    return (rows if max_rows is None else rows.limit(max_rows)).drop("__file", "__block", "__row")


def column(rows: DataFrame, name: str) -> DataFrame:
    """One column by name; no rows where there is none of that name."""
    return rows.select(name) if name in rows.columns else rows.sparkSession.createDataFrame([], f"`{name}` string")
