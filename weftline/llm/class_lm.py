"""Operator 9: class-based bigrams (Brown), classes by exchange.

Tokens are words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, then one end a text. The model learns from the
texts whose crc32(doc_id as text) mod 7 is not 2; null text is an empty one, its end is a token all the same.

Classes come in two steps. First the exchange algorithm proper, on a matrix of fixed size: its units are
``CORE`` most frequent words of all training texts, each by itself, all others in ``BUCKETS`` provisional groups by their last three bytes, and the end with a
class of its own. One unit after another moves to the class that raises the likelihood of class bigrams
most, until none moves. Then every other word of the vocabulary, however many there are, is exchanged by
itself: the counts of the classes before and after it, over all training texts, go to where the word's
counts meet, and it takes the class c that makes them likeliest, sum n(c', w) log P(c' before c) + sum
n(w, c'') log P(c'' after c). Only words that no training text has keep their group's class. Then class
bigrams are counted anew, and

    P(w | before) = (n(c', c) + KAPPA * p(c)) / (n(c') + KAPPA) * (n(w) + 1) / (n(c) + words(c) + 1)

with c' the class before (the end's at the start) and p(c) = (n(c) + 1) / (N + classes). Everything
counted, words, contexts and pairs, comes from all training texts and grows with them. The vocabulary is
never sent around: blocks of texts send their distinct words, each with its counts, to one place a word
and get back the sum and the class, unless no other block has the word.

Words are told apart by 64-bit hashes. Rows that repeat a doc_id are rows of their own. A null
doc_id is no held-out text. Without training texts every count is 0 and ``score`` is the base score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.columns import SPACE_LOWER, bit_table, give_back, in_bits, mix, pieces, text_buffer, words
from weftline.llm.scratch import Scratch

CORE, BUCKETS, CLASSES, KAPPA = 768, 255, 64, 50.0
#: Words of a block that give a first bound on how frequent the core is; no word goes for being beyond them.
BLOCK_TOP = 4096
UNITS = CORE + BUCKETS + 1
BLOCK_BYTES = 8 << 20


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(False))


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of texts: their distinct words (hash, bucket, count in training), and each text's words as places in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 32, 0
        for batch in pieces(batches, BLOCK_BYTES):
            w = words(batch.column("text"), SPACE_LOWER)
            codes, distinct = pd.factorize(w.hash)
            where = np.zeros(len(distinct), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            tail = np.zeros(len(distinct), np.uint64)
            for k in range(3):
                at = w.end[where] - 1 - k
                tail = tail * np.uint64(257) + np.where(at >= w.start[where], w.data[np.maximum(at, 0)], 0).astype(np.uint64)
            bucket = (mix(tail) % np.uint64(BUCKETS)).astype(np.uint8)
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            training = np.repeat(~held, np.diff(w.first))
            count = np.bincount(codes[training], minlength=len(distinct)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([base + seen]), "doc_ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), "held": pa.array([held.tolist()], pa.list_(pa.bool_())),
                "lengths": pa.array([_pack(np.diff(w.first).astype("<i8"))]), "words": pa.array([_pack(codes.astype("<u4"))]),
                "hashes": pa.array([distinct.astype("<u8").tobytes()]), "buckets": pa.array([bucket.tobytes()]), "counts": pa.array([_pack(count)]),
            })
            seen += 1

    schema = "block long, doc_ids array<long>, held array<boolean>, lengths binary, words binary, hashes binary, buckets binary, counts binary"
    return docs.mapInArrow(run, schema)


def _counted(table: DataFrame, chosen) -> DataFrame:
    """(hash, n) of those training words of each block that ``chosen``, a function of hashes and counts, picks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, n = np.frombuffer(row["hashes"], np.int64), _unpack(row["counts"], "<i4")
                h, n = h[n > 0], n[n > 0]
                at = chosen(h, n)
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(n[at].astype(np.int64))], names=["hash", "n"])

    return table.select("hashes", "counts").mapInArrow(run, "hash long, n long")


def frequent_words(table: DataFrame, most: int = CORE) -> list[int]:
    """The ``most`` most frequent training words, by hash where counts are equal: exactly, however texts are dealt.

    Sums over each block's ``BLOCK_TOP`` words give a bound that ``most`` words reach. A word that reaches it
    has an even share of it in some block; all words with such a share are counted in every block.
    """
    total = lambda found: found.groupBy("hash").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(most).collect()
    top = total(_counted(table, lambda h, n: np.lexsort((h, -n))[:BLOCK_TOP]))
    share = -(-top[-1]["n"] // table.count()) if len(top) == most else 1
    bits = table.sparkSession.sparkContext.broadcast(bit_table(_counted(table, lambda h, n: n >= share), "hash"))
    return [row["hash"] for row in total(_counted(table, lambda h, n: in_bits(bits.value, h.view(np.uint64))))]


class Core:
    """Units of words: the core's hashes, sorted; others by bucket."""

    def __init__(self, hashes: list[int]):
        all_ = np.array(hashes, np.int64)
        order = np.argsort(all_)
        self.hashes, self.unit = all_[order], order

    def units(self, hashes: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        out = CORE + buckets.astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            out[known] = self.unit[at[known]]
        return out


def _with_ends(values: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values and then ``end``; bounds of texts."""
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(bounds[-1], end, values.dtype)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[np.arange(len(values)) + row] = values
    return out, bounds


def unit_pairs(table: DataFrame, core) -> DataFrame:
    """(pair, n): counts of neighbouring units over all training texts; at most UNITS ** 2 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(UNITS * UNITS, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                of = core.value.units(np.frombuffer(row["hashes"], np.int64), np.frombuffer(row["buckets"], np.uint8))
                lengths = _unpack(row["lengths"], "<i8")
                seq, bounds = _with_ends(of[_unpack(row["words"], "<u4")], lengths, UNITS - 1)
                before = np.concatenate([[UNITS - 1], seq[:-1]])  # each text follows an end
                keep = np.repeat(~np.array(row["held"], bool), lengths + 1)
                total += np.bincount((before * UNITS + seq)[keep], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["pair", "n"])

    return table.select("hashes", "buckets", "lengths", "words", "held").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchanged(pairs: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each unit. The last unit keeps the last class to itself.

    Starts with units dealt out by falling frequency. The likelihood, up to what classes do not
    change, is sum xlogx n(a, b) - sum xlogx n(a, .) - sum xlogx n(., b).
    """
    units = len(pairs)
    free = classes - 1
    order = np.argsort(-pairs.sum(1), kind="stable")
    order = order[order != units - 1]
    of = np.full(units, classes - 1)
    of[order] = np.arange(len(order)) % free
    member = np.eye(classes)[of]
    right = pairs @ member  # unit -> class after
    left = member.T @ pairs  # class before -> unit
    n = member.T @ right
    moved = 1
    while moved:  # each move raises the likelihood
        moved = 0
        for u in order.tolist():
            a, self_ = of[u], pairs[u, u]
            out, into = right[u].copy(), left[:, u].copy()
            if not out.sum() + into.sum():
                continue
            # Without u.
            n[a] -= out
            n[:, a] -= into
            n[a, a] += self_
            out[a] -= self_
            into[a] -= self_
            rows, cols = n.sum(1), n.sum(0)
            gain = (_xlogx(n + out) - _xlogx(n)).sum(1) + (_xlogx(n + into[:, None]) - _xlogx(n)).sum(0)
            # Where row and column of the new class cross, both parts and u beside itself meet.
            d = np.diagonal(n)
            gain += _xlogx(d + out + into + self_) - _xlogx(d + out) - _xlogx(d + into) + _xlogx(d)
            gain -= _xlogx(rows + out.sum() + self_) - _xlogx(rows) + _xlogx(cols + into.sum() + self_) - _xlogx(cols)
            gain[free:] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            n[b] += out
            n[:, b] += into
            n[b, b] += self_
            if b != a:
                moved += 1
                of[u] = b
                right[:, a] -= pairs[:, u]
                right[:, b] += pairs[:, u]
                left[a] -= pairs[u]
                left[b] += pairs[u]
    return of


class Units:
    """The classes of units, and how likely contexts are in each class."""

    def __init__(self, pairs: np.ndarray, core: Core):
        self.core, self.of = core, exchanged(pairs)
        self.counts = pairs.sum(0).astype(np.int64)  # each token follows one
        member = np.eye(CLASSES)[self.of]
        n = member.T @ pairs @ member
        before, after = (n.sum(k) for k in (1, 0))  # of each class as the one before, and as the one after
        prior_before, prior_after = ((x + 1) / (x.sum() + CLASSES) for x in (before, after))
        left = np.log((n + KAPPA * prior_before[:, None]) / (after + KAPPA))  # (class before, class)
        right = np.log((n.T + KAPPA * prior_after[:, None]) / (before + KAPPA))  # (class after, class)
        self.context = np.concatenate([left, right])
        self.context[:, -1] = -1e9  # the end's class is its own

    def chosen(self, contexts: np.ndarray) -> np.ndarray:
        """The classes of words, from rows of 2 * CLASSES counts."""
        return np.argmax(contexts @ self.context, axis=1).astype(np.uint8)


class Block:
    """A block's words: their units and provisional classes, and the contexts of those beyond the core."""

    def __init__(self, row: dict, units: Units):
        hashes = np.frombuffer(row["hashes"], np.int64)
        unit = units.core.units(hashes, np.frombuffer(row["buckets"], np.uint8))
        self.hashes, self.counts = hashes, _unpack(row["counts"], "<i4").astype(np.int64)
        self.lengths, self.words = _unpack(row["lengths"], "<i8"), _unpack(row["words"], "<u4")
        self.core = unit < CORE
        self.unit, self.kind = unit, units.of[unit].astype(np.uint8)
        self.training = np.repeat(~np.array(row["held"], bool), self.lengths)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """(word * 2 * CLASSES + context, count), ascending, over training texts."""
        kinds, _ = _with_ends(self.kind[self.words], self.lengths, CLASSES - 1)
        at = np.arange(len(self.words)) + np.repeat(np.arange(len(self.lengths)), self.lengths)
        some = np.flatnonzero(self.training & ~self.core[self.words])
        at, word = at[some], self.words[some].astype(np.int64) * (2 * CLASSES)
        before = np.concatenate([[CLASSES - 1], kinds[:-1]])[at].astype(np.int64)
        return np.unique(np.concatenate([word + before, word + CLASSES + kinds[at + 1]]), return_counts=True)

    def local_kinds(self, units: Units, step: int = 1 << 14) -> np.ndarray:
        """The class of each word as far as this block alone tells."""
        kind = self.kind.copy()
        keys, n = self.contexts()
        word, context = np.divmod(keys, 2 * CLASSES)
        edges = np.searchsorted(word, np.arange(0, len(self.hashes) + step, step))
        for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if i < j:
                low, size = k * step, min(step, len(self.hashes) - k * step)
                dense = np.bincount((word[i:j] - low) * (2 * CLASSES) + context[i:j], n[i:j], size * 2 * CLASSES).reshape(size, -1)
                own = np.unique(word[i:j] - low)
                kind[low + own] = units.chosen(dense[own])
        return kind


def word_rows(table: DataFrame, units) -> DataFrame:
    """(hash, n, block, place, contexts) of each block's distinct words beyond the core; contexts as pairs of bytes, which and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, units.value)
                keys, n = block.contexts()
                times = -(-n // 255)  # a count that exceeds a byte is several
                word, context = np.divmod(np.repeat(keys, times), 2 * CLASSES)
                each = np.full(len(word), 255)
                each[np.cumsum(times) - 1] = n - 255 * (times - 1)
                coded = np.stack([context, each], axis=1).astype(np.uint8)
                bounds = 2 * np.searchsorted(word, np.arange(len(block.hashes) + 1))
                packed = pa.Array.from_buffers(pa.binary(), len(block.hashes), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(coded.tobytes())])
                at = np.flatnonzero(~block.core)
                yield pa.RecordBatch.from_arrays([pa.array(block.hashes[at]), pa.array(block.counts[at]), pa.array(np.full(len(at), row["block"])), pa.array(at.astype(np.int32)), packed.take(pa.array(at))], names=["hash", "n", "block", "place", "contexts"])
        give_back()

    return table.select("block", "hashes", "buckets", "counts", "lengths", "words", "held").mapInArrow(run, "hash long, n long, block long, place int, contexts binary")


def looked_up(rows: DataFrame, units) -> DataFrame:
    """(block, places, counts_all, kinds, firsts): for words of a block that occur in training texts of other blocks."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by hash. ``first`` marks one row of a word that no block has for itself."""

        def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
            h, n, block, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            begins = np.concatenate([[True], h[1:] != h[:-1]])
            group = np.cumsum(begins) - 1
            total = np.bincount(group, n).astype(np.int64)
            data, offsets = text_buffer(batch.column(4))
            coded = data.reshape(-1, 2)
            of = np.repeat(group, np.diff(offsets) // 2)
            kind = np.zeros(len(total), np.uint8)
            for low in range(0, len(total), 4096):
                i, j = np.searchsorted(of, [low, low + 4096])
                size = min(4096, len(total) - low)
                kind[low : low + size] = units.value.chosen(np.bincount((of[i:j] - low) * (2 * CLASSES) + coded[i:j, 0], coded[i:j, 1], size * 2 * CLASSES).reshape(size, -1))
            open_ = n < total[group]
            whole = np.bincount(group, ~open_, len(total)) > 0  # a block has all of it
            at = np.flatnonzero(open_)
            return pa.RecordBatch.from_arrays([pa.array(block[at]), pa.array(place[at]), pa.array(total[group[at]]), pa.array(kind[group[at]].astype(np.int16)), pa.array((begins & ~whole[group])[at])], names=["block", "place", "c", "kind", "first"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            if held and held[0].column(0)[0].as_py() != h[-1]:
                cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
                yield emit(pa.concat_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                if not held and h[0] != h[-1]:
                    cut = int(np.flatnonzero(h != h[-1])[-1]) + 1
                    yield emit(batch.slice(0, cut))
                    batch = batch.slice(cut)
                held.append(batch)
        if held:
            yield emit(pa.concat_batches(held))
        give_back()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def flush() -> pa.RecordBatch:
            place, c, kind, first = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_pydict({"block": pa.array([block]), "places": pa.array([_pack(place.astype("<u4"))]), "counts_all": pa.array([_pack(c.astype("<i8"))]), "kinds": pa.array([_pack(kind.astype(np.uint8))]), "firsts": pa.array([_pack(first.astype(np.uint8))])})

        for batch in batches:
            b, *rest = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            cuts = np.flatnonzero(b[1:] != b[:-1]) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
                if i == j:
                    continue
                if block is not None and b[i] != block:
                    yield flush()
                    held = []
                block = int(b[i])
                held.append(tuple(x[i:j] for x in rest))
        if held:
            yield flush()

    found = rows.repartition("hash").sortWithinPartitions("hash").mapInArrow(summed, "block long, place int, c long, kind short, first boolean")
    return found.repartition("block").sortWithinPartitions("block").mapInArrow(gathered, "block long, places binary, counts_all binary, kinds binary, firsts binary")


def finished(whole: DataFrame, units) -> DataFrame:
    """Blocks with the final count and class of each word, and what they add to class bigrams and to the types of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, u = Block(row, units.value), units.value
                c, kind = block.counts.copy(), block.local_kinds(u)
                mine = (c > 0) & ~block.core
                types = np.zeros(CLASSES, np.int64)
                if row["places"] is not None:
                    at, kinds = _unpack(row["places"], "<u4"), _unpack(row["kinds"], np.uint8)
                    c[at], kind[at], mine[at] = _unpack(row["counts_all"], "<i8"), kinds, False
                    types += np.bincount(kinds, _unpack(row["firsts"], np.uint8), CLASSES).astype(np.int64)
                types += np.bincount(kind[mine], minlength=CLASSES)
                c[block.core] = u.counts[block.unit[block.core]]
                seq, _ = _with_ends(kind[block.words].astype(np.int64), block.lengths, CLASSES - 1)
                before = np.concatenate([[CLASSES - 1], seq[:-1]])
                keep = np.repeat(~np.array(row["held"], bool), block.lengths + 1)
                pairs = np.bincount((before * CLASSES + seq)[keep], minlength=CLASSES * CLASSES)
                yield pa.RecordBatch.from_pydict({
                    "doc_ids": pa.array([row["doc_ids"]], pa.list_(pa.int64())), "held": pa.array([row["held"]], pa.list_(pa.bool_())), "lengths": pa.array([row["lengths"]], pa.binary()), "words": pa.array([row["words"]], pa.binary()),
                    "c": pa.array([_pack(c.astype("<i8"))]), "kind": pa.array([_pack(kind)]), "pairs": pa.array([_pack(pairs.astype("<i8"))]), "types": pa.array([_pack(types.astype("<i8"))]),
                })
        give_back()

    return whole.mapInArrow(run, "doc_ids array<long>, held array<boolean>, lengths binary, words binary, c binary, kind binary, pairs binary, types binary")


def class_counts(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Class bigrams, and the types of each class beyond the core, over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES + CLASSES, np.int64)
        for batch in batches:
            for pairs, types in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                total += np.concatenate([_unpack(pairs, "<i8"), _unpack(types, "<i8")])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["cell", "n"])

    out = np.zeros(CLASSES * CLASSES + CLASSES)
    for row in table.select("pairs", "types").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most so many rows
        out[row["cell"]] = row["n"]
    return out[: CLASSES * CLASSES].reshape(CLASSES, CLASSES), out[CLASSES * CLASSES :]


class Model:
    def __init__(self, n: np.ndarray, types: np.ndarray):
        """n: class bigrams; types: words of each class, the end included."""
        self.total = float(n.sum())
        size = n.sum(0)
        prior = (size + 1) / (self.total + CLASSES)
        self.step = np.log10((n + KAPPA * prior) / (n.sum(1)[:, None] + KAPPA))
        self.room = np.log10(size + types + 1)
        self.ends, self.types = int(size[-1]), int(types.sum())


def scored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every text."""
    scratch = Scratch(spark, "class-lm")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out())
    table = scratch.save(blocks(named), "blocks")
    core = Core(frequent_words(table))
    cells = unit_pairs(table, spark.sparkContext.broadcast(core)).toArrow()  # at most UNITS ** 2 rows
    pairs = np.zeros(UNITS * UNITS)
    pairs[cells.column("pair").to_numpy()] = cells.column("n").to_numpy()
    units = Units(pairs.reshape(UNITS, UNITS), core)
    shared_units = spark.sparkContext.broadcast(units)
    found = scratch.save(looked_up(word_rows(table, shared_units), shared_units), "found")
    final = scratch.save(finished(table.join(found, "block", "left"), shared_units), "final")
    for name in ("blocks", "found"):
        scratch.drop(name)
    n, types = class_counts(final)
    types += np.bincount(units.of[: len(core.hashes)], units.counts[: len(core.hashes)] > 0, CLASSES)
    types[-1] = n[:, -1].sum() > 0
    shared = spark.sparkContext.broadcast(Model(n, types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        base_of = np.log10(m.total + m.types + 1)
        for batch in batches:
            for row in batch.to_pylist():
                c, kind = _unpack(row["c"], "<i8"), _unpack(row["kind"], np.uint8)
                lengths, codes = _unpack(row["lengths"], "<i8"), _unpack(row["words"], "<u4")
                n, bounds = _with_ends(c[codes], lengths, m.ends)
                k, _ = _with_ends(kind[codes].astype(np.int64), lengths, CLASSES - 1)
                before = np.concatenate([[CLASSES - 1], k[:-1]])
                base = np.log10(n + 1) - base_of
                model_ = m.step[before, k] + np.log10(n + 1) - m.room[k] if m.total else base
                base, model_, known = (np.add.reduceat(x, bounds[:-1]) if len(lengths) else np.zeros(0) for x in (base, model_, (n > 0).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths + 1), pa.array(known.astype(np.int64)), pa.array(np.full(len(lengths), int(m.total))),
                    pa.array(base), pa.array(model_), pa.array(10.0 ** (-model_ / (lengths + 1))),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])
        give_back()

    return final.drop("pairs", "types").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
