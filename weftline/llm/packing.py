"""Operator 4: best-fit packing by exact complements.

Only the histogram of piece lengths, at most ``size`` rows however many documents there are, goes to
the driver. There an index holds the totals that one, two and three available lengths make. The longest
length still available opens a sequence; the gap it leaves is looked up and filled exactly, else the longest length that
fits goes in and the smaller gap is tried again. The resulting pattern is used as often as the
counts permit. Pieces then find their place by their rank among pieces of equal length: the ranks
come from salted groups, so that a length that a third of all pieces share is no single task.

Null text is an empty text, one piece with the end id only. Rows that repeat a doc_id are packed
like any others. A table without rows gives no rows. Columns beyond the two named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch
from weftline.llm.tokens import END_ID, encoded, vocabulary_path

SIZE = 4096
#: Pieces of one length that are ranked in one group.
SALT_ROWS = 20_000


class SumIndex:
    """Which totals one, two and three available lengths make.

    For each total the largest length of a pair, and of a triple, that may still be available. Counts only
    fall, so an entry that has run out moves on to the next smaller length and never back.
    """

    def __init__(self, count: np.ndarray):
        self.count, size = count, len(count) - 1
        some = np.flatnonzero(count)
        self.pair, self.triple = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        for x in some.tolist():  # ascending: the largest stays
            self.pair[x + some[some <= min(x, size - x)]] = x
        two = np.flatnonzero(self.pair)
        for x in some.tolist():
            self.triple[x + two[two <= size - x]] = x

    def _two(self, total: int, high: int) -> int:
        """The largest length up to ``high`` that is available together with the rest of the total; 0 if none is."""
        low = -(-total // 2)
        while high >= low:
            rest = total - high
            if rest > 0 and self.count[high] > (rest == high) and self.count[rest]:
                return high
            high -= 1
        return 0

    def exact(self, gap: int) -> list[int] | None:
        """One, two or three available lengths that sum to the gap; the fewest, and of those the longest."""
        if self.count[gap]:
            return [gap]
        x = self.pair[gap] = self._two(gap, int(self.pair[gap]))
        if x:
            return [int(x), int(gap - x)]
        x = int(self.triple[gap])
        while 3 * x >= gap and x:
            if self.count[x] and (top := int(self.pair[gap - x])):
                self.count[x] -= 1
                y = self._two(gap - x, min(x, top))
                self.count[x] += 1
                if y:
                    self.triple[gap] = x
                    return [x, y, gap - x - y]
            x -= 1
        self.triple[gap] = 0
        return None


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, how many such sequences), all pieces of the histogram used once."""
    count = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} does not fit {size}")
        count[length] = n
    out: list[tuple[list[int], int]] = []
    index = SumIndex(count)
    while True:
        support = np.flatnonzero(count)
        if not len(support):
            return out
        one, gap = [int(support[-1])], size - int(support[-1])
        count[one[0]] -= 1
        while gap:
            fill = index.exact(gap)
            if fill is None:
                below = np.flatnonzero(count[: gap + 1])
                if not len(below):
                    break
                fill = [int(below[-1])]
            for x in fill:
                count[x] -= 1
            one += fill
            gap -= sum(fill)
        uses = {x: one.count(x) for x in set(one)}
        again = min(int(count[x]) // n for x, n in uses.items())
        for x, n in uses.items():
            count[x] -= again * n
        out.append((one, 1 + again))


def slots(found: list[tuple[list[int], int]]) -> pd.DataFrame:
    """For each length, which of its ranks go to which sequences: rank low + i to sequence first + i, at offset."""
    rows, used, first = [], {}, 0
    for lengths, times in found:
        at = 0
        for x in lengths:
            low = used.get(x, 0)
            rows.append((x, low, first, at))
            used[x] = low + times
            at += x
        first += times
    return pd.DataFrame(rows, columns=["length", "low", "first", "offset"]).sort_values(["length", "low"], ignore_index=True)


def token_pieces(docs: DataFrame, vocabulary: str, *, end_id: int | None = END_ID, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document cut every ``size`` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in encoded(batches, vocabulary, end_id):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            parts = -(-n // size)
            row = np.repeat(np.arange(len(ids)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * size
            length = np.minimum(size, n[row] - start)
            crc = np.fromiter((zlib.crc32(ids[r][s : s + m]) for r, s, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)), np.int64, len(row))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a length column."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    table = slots(patterns(histogram, size))
    spark = pieces.sparkSession
    hot = [x for n, m in histogram.items() if m > SALT_ROWS for x in (F.lit(n).cast("long"), F.lit(-(-m // SALT_ROWS)))]
    salts = F.coalesce(F.create_map(*hot)[F.col("length")], F.lit(1)) if hot else F.lit(1)
    order = [F.col(c) for c in pieces.columns if c != "length"]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), salts).cast("int"))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy(*order)).cast("long") - 1)
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    shared = spark.sparkContext.broadcast((table["length"].to_numpy() * (1 << 40) + table["low"].to_numpy(), table["low"].to_numpy(), table["first"].to_numpy(), table["offset"].to_numpy()))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, low, first, offset = shared.value
        for part in batches:
            rank = part["rank"].to_numpy()
            at = np.searchsorted(keys, part["length"].to_numpy() * (1 << 40) + rank, "right") - 1
            yield part.drop(columns="rank").assign(sequence_id=first[at] + rank - low[at], offset=offset[at])

    joined = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).select(*pieces.columns, "rank")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return joined.mapInPandas(find, f"{fields}, sequence_id long, offset long")


def packed(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, *, size: int = SIZE, **how) -> DataFrame:
    """All pieces of all documents with their place."""
    pieces = Scratch(spark, "packing").save(token_pieces(docs, vocabulary or vocabulary_path(), size=size, **how), "pieces")
    return place(pieces, size)
