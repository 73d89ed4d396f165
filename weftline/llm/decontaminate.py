"""Operator 6: benchmark passages in documents, as a prefix-filtered set join.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased. Every run of ``width`` words of an item is a
window; an item of fewer words is one window. A window is the set of its shingles of ``SHINGLE`` words
with their places (a shorter window is one shingle). Shingles are ordered by rarity: how often each
occurs in all documents. With containment ``t`` of n shingles, a match must hold one of the window's
n - ceil(t n) + 1 rarest shingles, its prefix; for exact containment that is the rarest alone. The
prefixes are joined with the shingles of documents. A hit fixes where the window would have to start;
it must lie within the text (the length and positional bounds), and there the document's words are
compared with the window's, byte by byte: t of its shingles must stand in their places.

A batch of texts is hashed as a whole. Windows of ``BROADCAST_BYTES`` or less are sent to all workers,
and shingles are looked up in the sorted prefixes. Those of a larger benchmark stay a table: a bit table
of fixed size turns most shingles of documents away, the rest, each with the words around it, meet the
prefixes in a join, and verdicts come back by the digest of the text. Both ways give the same rows.

Null texts have no words. Items without words have no windows. Items that repeat a text, or an
item_id, each count; equal item_ids count once in n_items. Rows that repeat a doc_id are rows of their own.
Columns of the documents that are named like a result are replaced by it; ``clean_documents`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.columns import ALNUM_LOWER, Words, bit_table, in_bits, mix, pieces, window_hashes, with_columns, words
from weftline.llm.scratch import Scratch

WIDTH, SHINGLE = 10, 3
#: Words, shingles and item_ids of windows that are sent to each worker.
BROADCAST_BYTES = 48 << 20
#: Windows that leave a worker at once.
FLUSH_WINDOWS = 20_000


def shingles_of(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of all runs of ``k`` words; the length is part of the hash."""
    h, at = window_hashes(w.hash, w.first, k)
    return mix(h ^ np.uint64(k)), at


def _lists(table: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, table.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(table).view(np.int64).reshape(-1)))


def benchmark_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct windows: their words between spaces, those words' and their shingles' 64-bit hashes in order, the item_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = words(batch.column(1), ALNUM_LOWER)
            size = np.minimum(width, np.diff(w.first))
            for n in np.unique(size[size > 0]).tolist():
                row = np.flatnonzero(size == n)
                each = w.first[row + 1] - w.first[row] - n + 1
                owner = np.repeat(row, each)
                start = np.repeat(w.first[row] - np.cumsum(each) + each, each) + np.arange(each.sum())
                k = min(SHINGLE, n)
                h, at = shingles_of(w, k)
                dense = np.zeros(len(w.hash), np.uint64)
                dense[at] = h
                for low in range(0, len(start), FLUSH_WINDOWS):
                    s = start[low : low + FLUSH_WINDOWS]
                    text = [b" ".join(w.word(j) for j in range(i, i + n)) for i in s.tolist()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[low : low + FLUSH_WINDOWS])), pa.array(text, pa.binary()), _lists(w.hash[s[:, None] + np.arange(n)]), _lists(dense[s[:, None] + np.arange(n - k + 1)])], names=["item_id", "text", "seq", "shingles"])

    found = items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, text binary, seq array<long>, shingles array<long>")
    return found.groupBy("text").agg(F.first("seq").alias("seq"), F.first("shingles").alias("shingles"), F.array_sort(F.collect_set("item_id")).alias("items"))


@dataclass
class Lookup:
    """Sorted distinct 64-bit keys, with a bit table that turns most others away at once."""

    keys: np.ndarray

    def __post_init__(self):
        self.bits = max(10, int(len(self.keys) * 16).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.keys >> np.uint64(64 - self.bits)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that are keys, and which."""
        some = np.flatnonzero(self.table[h >> np.uint64(64 - self.bits)])
        at = np.searchsorted(self.keys, h[some])
        at[at == len(self.keys)] = 0
        same = self.keys[at] == h[some] if len(self.keys) else np.zeros(len(some), bool)
        return some[same], at[same]


def shingle_counts(docs: DataFrame, lookup, lengths: list[int]) -> DataFrame:
    """How often each benchmark shingle occurs in all documents: (shingle, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Lookup = lookup.value
        total = np.zeros(len(known.keys), np.int64)
        for batch in pieces(batches):
            w = words(batch.column(0), ALNUM_LOWER)
            for k in lengths:
                total += np.bincount(known.find(shingles_of(w, k)[0])[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known.keys[some].view(np.int64)), pa.array(total[some])], names=["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def prefix_size(n, containment: float):
    """How many of n shingles the prefix has."""
    return n - np.ceil(containment * n - 1e-9).astype(np.int64) + 1


@dataclass
class Prefixes:
    """Distinct windows and, for each prefix shingle, the windows that have it and where."""

    lookup: Lookup
    begin: np.ndarray  # of each shingle's entries
    window: np.ndarray  # entry -> window
    offset: np.ndarray  # entry -> place of the shingle in the window
    seq: np.ndarray  # all words of all windows
    seq_at: np.ndarray  # window -> bounds in seq
    texts: list[bytes]
    items: list[list[str]]  # window -> item_ids
    lengths: list[int]  # of shingles


def prefixes(windows: pa.Table, counted: pa.Table, containment: float = 1.0) -> Prefixes:
    """From the windows, and how often their shingles occur (shingle, n)."""
    seq, shingles = (windows.column(c).combine_chunks() for c in ("seq", "shingles"))
    flat = shingles.flatten().to_numpy()
    n = np.diff(shingles.offsets.to_numpy())
    window = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    keys, counts = counted.column("shingle").to_numpy(), counted.column("n").to_numpy()
    order = np.argsort(keys)
    at = np.searchsorted(keys[order], flat)
    at[at == len(keys)] = 0
    rarity = np.where(keys[order][at] == flat, counts[order][at], 0) if len(keys) else np.zeros(len(flat), np.int64)
    order = np.lexsort((offset, flat, rarity, window))  # of each window the rarest first
    order = order[offset < prefix_size(n, containment)[window]]  # offset counts places within a window in either order
    order = order[np.argsort(flat[order].view(np.uint64), kind="stable")]
    distinct, begin = np.unique(flat[order].view(np.uint64), return_index=True)
    lengths = np.diff(seq.offsets.to_numpy())
    return Prefixes(Lookup(distinct), np.append(begin, len(order)), window[order], offset[order], seq.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lengths)]), windows.column("text").to_pylist(), windows.column("items").to_pylist(), sorted(set((lengths - n + 1).tolist())))


def contains(got: list[bytes], want: list[bytes], containment: float) -> bool:
    """Whether as much as asked of the window's shingles stand in their places."""
    if containment >= 1 or len(want) < SHINGLE:
        return got == want
    same = [x == y for x, y in zip(got, want, strict=True)]
    whole = [all(same[j : j + SHINGLE]) for j in range(len(want) - SHINGLE + 1)]
    return len(got) == len(want) and sum(whole) >= containment * len(whole) - 1e-9


def occurrences(w: Words, p: Prefixes, containment: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of all windows that occur in a batch."""
    starts, found = [], []
    for k in p.lengths:
        h, at = shingles_of(w, k)
        hit, key = p.lookup.find(h)
        n = p.begin[key + 1] - p.begin[key]
        entry = np.repeat(p.begin[key] - np.cumsum(n) + n, n) + np.arange(n.sum())
        place, window = np.repeat(at[hit], n), p.window[entry]
        start = place - p.offset[entry]
        size = p.seq_at[window + 1] - p.seq_at[window]
        row = np.searchsorted(w.first, place, "right") - 1
        fits = (start >= w.first[row]) & (start + size <= w.first[row + 1])
        start, window, size = start[fits], window[fits], size[fits]
        if containment >= 1:
            same = np.ones(len(start), bool)
            for j in range(int(size.max()) if len(size) else 0):
                some = np.flatnonzero(same & (size > j))
                same[some] = w.hash[start[some] + j] == p.seq[p.seq_at[window[some]] + j]
            start, window = start[same], window[same]
        starts.append(start)
        found.append(window)
    start, window = np.concatenate(starts or [[]]).astype(np.int64), np.concatenate(found or [[]]).astype(np.int64)
    both = np.unique(np.stack([start, window], axis=1), axis=0)
    true = np.zeros(len(both), bool)
    for i, (at, one) in enumerate(both.tolist()):
        want = p.texts[one].split(b" ")
        true[i] = contains([w.word(j) for j in range(at, at + len(want))], want, containment)
    return both[true, 0], both[true, 1]


RESULT = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"}


def _verdicts(w: Words, start: np.ndarray, window: np.ndarray, p: Prefixes) -> list[pa.Array]:
    rows = len(w.first) - 1
    size = p.seq_at[window + 1] - p.seq_at[window]
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + size, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    n_hit = hit[w.first[1:]] - hit[w.first[:-1]]
    items: list[set[str]] = [set() for _ in range(rows)]
    for row, one in zip((np.searchsorted(w.first, start, "right") - 1).tolist(), window.tolist(), strict=True):
        items[row].update(p.items[one])
    return [pa.array(np.diff(w.first)), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]), pa.array(n_hit > 0)]


def _judged(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int, containment: float) -> tuple[DataFrame, str]:
    """``docs`` and the results, whose names begin with the prefix that is returned too."""
    prefix = "__"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    scratch = Scratch(spark, "decontaminate")
    windows = scratch.save(benchmark_windows(items, width), "windows")
    size = windows.select(F.sum(F.length("text") + 8 * (F.size("seq") + F.size("shingles")) + F.aggregate("items", F.lit(0), lambda n, x: n + F.length(x) + 8))).first()[0] or 0
    if size > BROADCAST_BYTES:
        return _joined(docs, windows, scratch, prefix, width, containment), prefix
    held = windows.toArrow()  # at most BROADCAST_BYTES
    asked = np.unique(held.column("shingles").combine_chunks().flatten().to_numpy().view(np.uint64))
    lengths = [r[0] for r in windows.select(F.size("seq") - F.size("shingles") + 1).distinct().collect()]  # at most SHINGLE
    counts = shingle_counts(docs, spark.sparkContext.broadcast(Lookup(asked)), sorted(lengths)).toArrow()  # of the benchmark's shingles
    shared = spark.sparkContext.broadcast(prefixes(held, counts, containment))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = words(batch.column("text"), ALNUM_LOWER)
            start, window = occurrences(w, shared.value, containment)
            yield pa.RecordBatch.from_arrays([*batch.columns, *_verdicts(w, start, window, shared.value)], names=[*batch.schema.names, *(prefix + c for c in RESULT)])

    return with_columns(docs, run, ", ".join(f"{prefix}{c} {kind}" for c, kind in RESULT.items())), prefix


def _joined(docs: DataFrame, windows: DataFrame, scratch: Scratch, prefix: str, width: int, containment: float) -> DataFrame:
    """For a benchmark too large to send around. A verdict depends on the text alone, so its digest is the key."""
    spark = docs.sparkSession
    lengths = sorted(r[0] for r in windows.select(F.size("seq") - F.size("shingles") + 1).distinct().collect())  # at most SHINGLE
    each = scratch.save(windows.select("text", F.size("shingles").alias("n"), F.posexplode("shingles").alias("offset", "shingle")), "shingles")
    all_bits = spark.sparkContext.broadcast(bit_table(each, "shingle"))
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("of", F.md5(F.col("text").cast("binary")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = words(batch.column("text"), ALNUM_LOWER)
            for k in lengths:
                h, _ = shingles_of(w, k)
                found, n = np.unique(h[in_bits(all_bits.value, h)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    counts = texts.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("times"))
    ranked = each.join(counts, "shingle", "left").groupBy("text", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "shingle", "offset"))).alias("by"))  # at most `width` a window
    need = F.col("n") - F.ceil(F.lit(containment) * F.col("n") - 1e-9).cast("int") + 1
    chosen = scratch.save(ranked.select("text", F.explode(F.slice("by", F.lit(1), need)).alias("p")).select("text", "p.shingle", "p.offset"), "prefixes")
    bits = spark.sparkContext.broadcast(bit_table(chosen, "shingle"))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles that may be a prefix, with the words around them."""
        for batch in pieces(batches):
            w = words(batch.column("text"), ALNUM_LOWER)
            for k in lengths:
                h, at = shingles_of(w, k)
                found = np.flatnonzero(in_bits(bits.value, h))
                for low in range(0, len(found), FLUSH_WINDOWS):
                    some = found[low : low + FLUSH_WINDOWS]
                    row = np.searchsorted(w.first, at[some], "right") - 1
                    begin, end = np.maximum(w.first[row], at[some] - width + 1), np.minimum(w.first[row + 1], at[some] + width)
                    around = [b" ".join(w.word(j) for j in range(i, e)) for i, e in zip(begin.tolist(), end.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("of").take(pa.array(row)), pa.array(h[some].view(np.int64)), pa.array(at[some] - w.first[row]), pa.array(at[some] - begin), pa.array(around, pa.binary())], names=["of", "shingle", "pos", "back", "around"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keep, starts, sizes = [], [], []
            for i, (pos, back, around, text, offset) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("pos", "back", "around", "text", "offset")), strict=True)):
                want, low = text.split(b" "), back - offset
                if low >= 0 and contains(around.split(b" ")[low : low + len(want)], want, containment):
                    keep.append(i)
                    starts.append(pos - offset)
                    sizes.append(len(want))
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("of").take(take), batch.column("text").take(take), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["of", "text", "start", "size"])

    met = texts.mapInArrow(hits, "of string, shingle long, pos long, back long, around binary").join(chosen, "shingle").select("of", "pos", "back", "around", "text", "offset")
    found = scratch.save(met.mapInArrow(verified, "of string, text binary, start long, size long").distinct(), "found")
    covered = found.select("of", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("word")).distinct().groupBy("of").agg(F.count("*").alias("n_hit"))
    listed = found.select("of", "text").distinct().join(windows.select("text", "items"), "text").select("of", F.explode("items").alias("item")).groupBy("of").agg(F.array_sort(F.collect_set("item")).alias("items"))
    verdicts = covered.join(listed, "of").select(F.col("of").alias(f"{prefix}of"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    verdicts = scratch.save(verdicts, "verdicts").select(f"{prefix}of", *(F.col(c).alias(prefix + c) for c in ("n_hit", "n_items", "items_sha256")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = words(batch.column("text"), ALNUM_LOWER, hashed=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(w.first))], names=[*batch.schema.names, f"{prefix}n_words"])

    sized = with_columns(docs, counted, f"{prefix}n_words long").withColumn(f"{prefix}of", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    whole = sized.join(verdicts, f"{prefix}of", "left")
    for c in ("n_hit", "n_items"):
        whole = whole.withColumn(prefix + c, F.coalesce(prefix + c, F.lit(0)))
    none = hashlib.sha256(b"").hexdigest()
    return whole.withColumns({f"{prefix}items_sha256": F.coalesce(f"{prefix}items_sha256", F.lit(none)), f"{prefix}contaminated": F.col(f"{prefix}n_hit") > 0}).drop(f"{prefix}of")


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, *, width: int = WIDTH, containment: float = 1.0) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated."""
    found, prefix = _judged(spark, docs, items, width, containment)
    return found.select(*(c for c in docs.columns if c not in RESULT), *(F.col(prefix + c).alias(c) for c in RESULT))


def clean_documents(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows; all columns as they were."""
    found, prefix = _judged(spark, docs, items, WIDTH, 1.0)
    return found.filter(f"NOT {prefix}contaminated").select(docs.columns)
