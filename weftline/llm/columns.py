"""Arrow text columns as NumPy: whole batches are cut into words and hashed without a loop over rows."""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 16
_BLOCK = 1 << 20
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _grown(have: np.ndarray, base: int, n: int) -> np.ndarray:
    full = np.full(n, base, np.uint64)
    full[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(full)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i below n."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        n = (n + _STEP - 1) // _STEP * _STEP
        _POWERS = _grown(_POWERS, int(_BASE), n)
        _INVERSE = _grown(_INVERSE, pow(int(_BASE), -1, 1 << 64), n)
    return _POWERS, _INVERSE


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after another, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    if n == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """Maps separators to 0 and, on demand, A-Z to a-z."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


#: [^\x20\x09-\x0D]+
SPACE = byte_table(bytes([32, *range(9, 14)]), lower=False)
SPACE_LOWER = byte_table(bytes([32, *range(9, 14)]), lower=True)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM_LOWER = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


@dataclass
class Words:
    """The words of a batch. ``first`` has n + 1 entries: words of row i are first[i]:first[i + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words(column, table: np.ndarray, hashed: bool = True) -> Words:
    """Cuts each text into maximal runs of bytes that the table does not map to 0."""
    data, offsets = text_buffer(column)
    n = len(data)
    mapped = table[data]
    inside = np.zeros(n + 1, bool)
    np.not_equal(mapped, 0, out=inside[:n])
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1] if n else begins[1:]
    ends = inside[:n] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    first[-1] = len(start)
    return Words(mapped, offsets, start, end, first, hash_spans(mapped, start, end) if hashed else np.zeros(0, np.uint64))


#: Longer spans are hashed one by one: a polynomial modulo 2**64 has structured collisions from some
#: hundred letters on (Thue-Morse words), whatever its base.
LONG_SPAN = 64


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ordered, disjoint byte spans; equal bytes give equal hashes in any batch.

    Short spans go through a polynomial, about a megabyte at a time, so that the wide intermediate columns
    stay in cache; the few long ones (no word of prose, but base64, URLs, unspaced scripts) through xxh3.
    """
    out = np.empty(len(start), np.uint64)
    long = end - start > LONG_SPAN
    if long.any():
        at, view = np.flatnonzero(long), memoryview(np.ascontiguousarray(data))
        out[at] = [xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        short = np.flatnonzero(~long)
        out[short] = _short_hashes(data, start[short], end[short])
        return out
    return _short_hashes(data, start, end)


def _short_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    edges = np.searchsorted(start, np.arange(0, len(data) + _BLOCK, _BLOCK)) if len(start) else np.zeros(1, np.int64)
    with np.errstate(over="ignore"):
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if i == j:
                continue
            low, high = start[i], end[j - 1]
            p, inverse = powers(high - low + 1)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * p[: high - low], out=total[1:])
            s, e = start[i:j] - low, end[i:j] - low
            got = (total[e] - total[s]) * inverse[s]
            out[i:j] = mix(got + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def spans_equal(data: np.ndarray, start: np.ndarray, end: np.ndarray, like: np.ndarray) -> bool:
    """Whether each span holds the same bytes as the span that ``like`` names for it."""
    rows = np.flatnonzero(like != np.arange(len(like)))
    size = end - start
    if (size[rows] != size[like[rows]]).any():
        return False
    done = np.concatenate([[0], np.cumsum(size[rows])])
    edges = np.unique(np.append(np.searchsorted(done, np.arange(0, done[-1], _BLOCK)), len(rows)))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        some = rows[i:j]
        n = size[some]
        step = np.arange(done[j] - done[i]) - np.repeat(done[i:j] - done[i], n)
        if (data[np.repeat(start[some], n) + step] != data[np.repeat(start[like[some]], n) + step]).any():
            return False
    return True


def window_hashes(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words that lie within one row, and the index of their first word."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = h[: n - width + 1].copy()
        for k in range(1, width):
            out *= np.uint64(0x9DDFEA08EB382D69)
            out ^= out >> np.uint64(32)
            out += h[k : n - width + 1 + k]
    row_end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n - width + 1) + width <= row_end[: n - width + 1])
    return mix(out[at]), at


#: Bits of ``bit_table``: 8 MB however many keys there are.
TABLE_BITS = 26


def bit_table(keys, column: str) -> np.ndarray:
    """A table of 2 ** TABLE_BITS bits, set where the upper bits of a 64-bit key of the frame fall."""
    place = F.shiftrightunsigned(column, 64 - TABLE_BITS) + 1
    parts = keys.select(place.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros((1 << TABLE_BITS) // 8, np.uint8)
    for row in parts.collect():  # at most 2 ** (TABLE_BITS - 15) rows of 4 kB
        out[(row["part"] - 1) * 4096 : row["part"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def in_bits(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit keys the table may hold."""
    at = (keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def give_back() -> None:
    """Returns freed memory to the system: workers live on, and the next operator's heap may need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def pieces(batches, most: int = 4 << 20):
    """Re-cuts record batches so that each holds at most about ``most`` bytes; a single longer row stays whole."""
    for batch in batches:
        rows, size = batch.num_rows, batch.nbytes
        if size <= most or rows <= 1:
            yield batch
            continue
        step = max(1, rows * most // size)
        for at in range(0, rows, step):
            yield batch.slice(at, step)
    give_back()


def with_columns(df, run, more: str):
    """df.mapInArrow(run) where ``run`` keeps all columns of ``df`` and adds those of the schema ``more``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, {more}" if more else fields)
