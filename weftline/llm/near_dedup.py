"""Operator 10: near-duplicate classes by order MinHash.

A text is its words (`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased; without such words, its white-space
words) and their runs of five. Each run is labelled with how often it has occurred before in the
text. Each of ``sketches`` hash orders picks the two least labelled runs; the pair, in text order, is
one bucket key, so a key agrees only where both runs and their order do. Two texts are linked when a
banded alignment of their words finds an edit similarity, 1 - edits / words of the longer, of
``threshold`` or more. Classes are the connected components of links.

Equal word sequences are one node from the start, by a 128-bit fingerprint, so thousands of exact
copies cost one row; all that follows works on distinct texts. In each bucket every text is first compared
with the bucket's least text. Then all pairs of a bucket that the links so far have not put in one class
are looked at, however large the bucket is, each in one of the buckets it shares: a pair whose lengths or
whose counts of words by hash differ by more than the edits allowed cannot be a link, and every other pair
is aligned where it meets. So each pair that shares a bucket is a link, or in one class by other links, or
known to be unlike.

Null text counts as empty; texts without words are copies of each other. Rows that repeat a doc_id
are rows of their own. Texts shorter than five words are one run. Columns beyond the two named are
not read; a table without rows gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.align import edit_distance
from weftline.llm.columns import ALNUM_LOWER, SPACE, Words, mix, pieces, window_hashes, with_columns, words
from weftline.llm.graph import components
from weftline.llm.scratch import Scratch

RUN, SKETCHES, THRESHOLD = 5, 24, 0.8
FILTER_BITS = 26
#: Words of a text are counted by hash in so many bins, a byte each.
BINS = 128
#: Buckets of more texts are split into tiles of two such parts, so that no task has all pairs of one.
TILE = 2048
#: As many words at most has a part, but for one text.
TILE_WORDS = 1 << 21
#: Pairs of a tile that are looked at together.
PAIRS = 1 << 18


def words_or_rest(column) -> Words:
    """Words; rows that have none by the main pattern are cut at white space instead."""
    w = words(column, ALNUM_LOWER)
    if not len(empty := np.flatnonzero(np.diff(w.first) == 0)):
        return w
    rest = words(column.take(pa.array(empty)), SPACE)
    if not len(rest.hash):
        return w
    n = np.diff(w.first)
    n[empty] = np.diff(rest.first)
    first = np.concatenate([[0], np.cumsum(n)])
    order = np.argsort(np.concatenate([w.row, empty[rest.row]]), kind="stable")
    return Words(w.data, w.offsets, w.start, w.end, first, np.concatenate([w.hash, rest.hash])[order])


def fingerprints(w: Words) -> np.ndarray:
    """16 bytes for each row, of its word sequence."""
    n = np.diff(w.first)
    place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)
    out = np.zeros((len(n), 2), np.uint64)
    with np.errstate(over="ignore"):
        for k, salt in enumerate((0xA24BAED4963EE407, 0x9FB21C651E98DF25)):
            each = mix(w.hash * np.uint64(2 * k + 1) + mix(place.astype(np.uint64) + np.uint64(salt)))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
            out[:, k] = mix(total[w.first[1:]] - total[w.first[:-1]] + n.astype(np.uint64))
    return out


def labelled_runs(w: Words, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs with their occurrence labels, and n + 1 bounds of rows. A shorter text is one run."""
    n = np.diff(w.first)
    h, at = window_hashes(w.hash, w.first, run)
    row = np.searchsorted(w.first, at, "right") - 1
    if len(short := np.flatnonzero((n > 0) & (n < run))):
        pad = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(run):
                has = n[short] > k
                pad[has] = mix(pad[has] + w.hash[w.first[short[has]] + k])
        h, row = np.concatenate([h, pad]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    bounds = np.searchsorted(row, np.arange(len(n) + 1))
    with np.errstate(over="ignore"):
        key = mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    if same.any():
        begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        label = np.zeros(len(h), np.uint64)
        label[order] = (np.arange(len(same)) - begin).astype(np.uint64)
        again = label > 0
        h[again] = mix(h[again] ^ mix(label[again]))
    return h, bounds


def order_sketches(h: np.ndarray, bounds: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """(rows, sketches): of each hash order, the key of the two least runs in text order. Rows without runs get 0."""
    n = np.diff(bounds)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), sketches), np.uint64)
    if not len(full):
        return out
    begin = bounds[:-1][full]
    owner = np.repeat(np.arange(len(full)), n[full])
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        for k in range(sketches):
            v = (h ^ mix(np.full(1, k + 1, np.uint64))) * np.uint64(0xFF51AFD7ED558CCD)
            v ^= v >> np.uint64(32)
            v *= np.uint64(0xC4CEB9FE1A85EC53)
            first, second = (_least(v, begin, owner, most) for _ in range(2))
            alone = n[full] == 1
            second = np.where(alone, first, second)
            low, high = np.minimum(first, second), np.maximum(first, second)
            out[full, k] = mix(h[low] + mix(h[high] + np.uint64(k)))
    return out


def _least(v: np.ndarray, begin: np.ndarray, owner: np.ndarray, most: np.uint64) -> np.ndarray:
    """The place of the least value of each segment, which is then set to ``most``."""
    low = np.minimum.reduceat(v, begin)
    at = np.flatnonzero(v == low[owner])
    _, one = np.unique(owner[at], return_index=True)
    at = at[one]
    v[at] = most
    return at


def word_bins(w: Words) -> np.ndarray:
    """(rows, BINS): words of each text by hash. A bin stays at 255, which can only bring two texts closer."""
    n = len(w.first) - 1
    at = w.row * BINS + (w.hash >> np.uint64(57)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=n * BINS), 255).astype(np.uint8).reshape(n, BINS)


def sketch_rows(docs: DataFrame, sketches: int = SKETCHES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, n_words, sketch, bins of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = words_or_rest(batch.column(1))
            table = order_sketches(*labelled_runs(w), sketches).view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, sketches, dtype=np.int32)), pa.array(table.reshape(-1)))
            fp = fingerprints(w)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in fp], pa.binary()), pa.array(np.diff(w.first)), flat, pa.array([x.tobytes() for x in word_bins(w)], pa.binary())], names=["doc_id", "fp", "n_words", "sketch", "bins"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp binary, n_words long, sketch array<long>, bins binary")


def fingerprint_bits(wanted: DataFrame) -> np.ndarray:
    """A table of 2 ** FILTER_BITS bits, set where a wanted fingerprint falls: 8 MB however many there are."""
    place = F.shiftright(F.conv(F.hex(F.substring("fp", 1, 4)), 16, 10).cast("long"), 32 - FILTER_BITS) + 1
    parts = wanted.select(place.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in parts.collect():  # at most 2 ** (FILTER_BITS - 15) rows of 4 kB
        out[(row["part"] - 1) * 4096 : row["part"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def sequences(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """fp and the words as 32-bit hashes, of the distinct texts whose fp is wanted.

    A bit table turns most other texts away before the shuffle; the join after it is exact.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fingerprint_bits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = words_or_rest(batch.column(0))
            fp = fingerprints(w)
            at = np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 16)[:, :4].copy().view(">u4")[:, 0].astype(np.int64) >> (32 - FILTER_BITS)
            rows = np.flatnonzero(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            short = (w.hash >> np.uint64(32)).astype("<u4")
            seqs = [short[w.first[i] : w.first[i + 1]].tobytes() for i in rows.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([fp[i].tobytes() for i in rows.tolist()], pa.binary()), pa.array(seqs, pa.binary())], names=["fp", "seq"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "fp binary, seq binary")
    return found.join(wanted, "fp", "left_semi").dropDuplicates(["fp"])


def verified(pairs: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of fingerprints whose alignment is similar enough, with the similarity."""
    left = seqs.select(F.col("fp").alias("b"), F.col("seq").alias("seq_b"))
    right = seqs.select(F.col("fp").alias("a"), F.col("seq").alias("seq_a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keep, how = [], []
            for i, (x, y) in enumerate(zip(batch.column("seq_a").to_pylist(), batch.column("seq_b").to_pylist(), strict=True)):
                longer = max(len(x), len(y)) // 4
                most = int((1 - threshold) * longer + 1e-9)
                edits = edit_distance(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), most)
                if edits is not None:
                    keep.append(i)
                    how.append(1 - edits / max(1, longer))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(how, pa.float64())], names=["a", "b", "similarity"])

    return pairs.join(left, "b").join(right, "a").select("a", "b", "seq_a", "seq_b").mapInArrow(run, "a binary, b binary, similarity double")


def _led(entries: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Of (bucket, fp, n_words): each entry with its bucket's least other text.

    The leaders are a table of their own: both sides of the join are then plain shuffles, so that Spark
    can split a bucket that very many texts share.
    """
    leader = entries.groupBy("bucket").agg(F.min(F.struct("fp", "n_words")).alias("lead"), F.count("*").alias("n")).filter("n > 1").select("bucket", "lead")
    leader = scratch.save(leader, name)
    return entries.join(leader, "bucket").select("bucket", "fp", "n_words", F.col("lead.fp").alias("lead"), F.col("lead.n_words").alias("lead_words")).filter("fp <> lead")


def _tied(links: DataFrame) -> DataFrame:
    """(fp, tie): from a text to its verified leader, that one's, and so on, up to eight steps. Equal ties are one class."""
    up = links.groupBy(F.col("b").alias("fp")).agg(F.min("a").alias("tie"))
    for _ in range(3):
        further = up.select(F.col("fp").alias("tie"), F.col("tie").alias("next"))
        up = up.join(further, "tie", "left").select("fp", F.coalesce("next", "tie").alias("tie"))
    return up


def _apart(pairs: DataFrame, tied: DataFrame) -> DataFrame:
    """Pairs (a, b, ..) that no ties have put in one class yet."""
    a, b = (tied.select(F.col("fp").alias(c), F.col("tie").alias(f"tie_{c}")) for c in "ab")
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.filter(F.coalesce("tie_a", "a") != F.coalesce("tie_b", "b")).select(pairs.columns)


def _met(threshold: float):
    """A function of tiles, sorted: links (a, b, similarity) that put all texts of a tile that are like in one class."""

    def emit(rows: pa.RecordBatch) -> pa.RecordBatch:
        n = rows.num_rows
        ids = np.stack([rows.column(c).to_numpy() for c in ("bucket", "p", "q")], axis=1)
        begins = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)]))
        end = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n)))
        side, size = (rows.column(c).to_numpy() for c in ("side", "n_words"))
        _, of = np.unique(np.array(rows.column("class").to_pylist(), object), return_inverse=True)
        bins = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(n, BINS)
        shared = rows.column("buckets").flatten().to_numpy().reshape(n, -1)
        fp, seq = (rows.column(c).to_pylist() for c in ("fp", "seq"))
        within = ids[:, 1] == ids[:, 2]
        above = list(range(n))  # classes that links of these rows join

        def root(c: int) -> int:
            while above[c] != c:
                above[c] = c = above[above[c]]
            return c

        partners = end - np.arange(n) - 1  # each row meets those after it
        done = np.concatenate([[0], np.cumsum(partners)])
        low, out = 0, []
        while low < n:
            high = max(low + 1, int(np.searchsorted(done, done[low] + PAIRS, "right")) - 1)
            x = np.repeat(np.arange(low, high), partners[low:high])
            y = x + 1 + np.arange(len(x)) - np.repeat(done[low:high] - done[low], partners[low:high])
            low = high
            most = ((1 - threshold) * np.maximum(size[x], size[y]) + 1e-9).astype(np.int64)
            some = np.flatnonzero((of[x] != of[y]) & (within[x] | (side[x] != side[y])) & (np.abs(size[x] - size[y]) <= most))
            x, y, most = x[some], y[some], most[some]
            for k in range(0, len(x), 1 << 14):
                i, j, m = (z[k : k + (1 << 14)] for z in (x, y, most))
                apart = bins[i].astype(np.int16) - bins[j]  # an edit moves at most one word out of a bin and one into another
                like = np.flatnonzero((np.abs(apart).sum(axis=1) + np.abs(apart.sum(axis=1))) // 2 <= m)
                i, j, m = i[like], j[like], m[like]
                least = np.where(shared[i] == shared[j], shared[i], np.iinfo(np.int64).max).min(axis=1)
                here = np.flatnonzero(least == ids[i, 0])
                for u, v, e in zip(i[here].tolist(), j[here].tolist(), m[here].tolist(), strict=True):
                    a, b = root(of[u]), root(of[v])
                    if a == b:
                        continue
                    edits = edit_distance(np.frombuffer(seq[u], "<u4"), np.frombuffer(seq[v], "<u4"), e)
                    if edits is not None:
                        above[a] = b
                        out.append((min(fp[u], fp[v]), max(fp[u], fp[v]), 1 - edits / max(size[u], size[v])))
        a, b, how = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(how, pa.float64())], names=["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy() for c in ("bucket", "p", "q")], axis=1)
            differ = np.flatnonzero((ids != ids[-1]).any(axis=1))
            if held and (len(differ) or [held[0].column(c)[0].as_py() for c in ("bucket", "p", "q")] != ids[-1].tolist()):
                cut = int(differ[-1]) + 1 if len(differ) else 0
                yield emit(pa.concat_batches([*held, batch.slice(0, cut)]))
                held, batch = [], batch.slice(cut)
            elif len(differ):
                cut = int(differ[-1]) + 1
                yield emit(batch.slice(0, cut))
                batch = batch.slice(cut)
            held.append(batch)
        if held:
            yield emit(pa.concat_batches(held))

    return run


def _rest(led: DataFrame, nodes: DataFrame, seqs: DataFrame, found: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """Links between texts of a bucket that those found do not put in one class."""
    classes = components(found.select("a", "b"), scratch.below("classes")).select(F.col("node").alias("fp"), F.col("root").alias("class"))
    entries = led.select("bucket", "fp", "n_words").union(led.select("bucket", F.col("lead").alias("fp"), F.col("lead_words").alias("n_words")).distinct())
    entries = scratch.save(entries.join(classes, "fp", "left").withColumn("class", F.coalesce("class", "fp")), "entries")
    parts = F.ceil(F.greatest(F.col("n") / TILE, F.col("words") / TILE_WORDS)).cast("int")
    mixed = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("bucket", parts.alias("parts"))
    mixed = scratch.save(mixed, "mixed")  # as the leaders: a plain shuffle to the join
    buckets = F.transform("sketch", lambda key, band: F.xxhash64(band, key))
    texts = nodes.select("fp", "bins", buckets.alias("buckets")).join(seqs, "fp")
    rows = entries.join(mixed, "bucket").withColumn("side", F.pmod(F.xxhash64("fp"), "parts").cast("int")).join(texts, "fp")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("bucket", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "fp", "class", "n_words", "bins", "buckets", "seq")
    return rows.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInArrow(_met(threshold), "a binary, b binary, similarity double")


def links(docs: DataFrame, nodes: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """Verified links (a, b, similarity) between distinct texts; ``nodes`` has fp, n_words, sketch, bins.

    Two texts that share a bucket and are like are connected by links, in as many steps as it takes.
    """
    some = nodes.filter("n_words > 0")
    keys = some.select("fp", "n_words", F.posexplode("sketch").alias("band", "key"))
    entries = keys.select(F.xxhash64("band", "key").alias("bucket"), "fp", "n_words")
    led = scratch.save(_led(entries, scratch, "leaders1"), "led1")
    close = F.least("n_words", "lead_words") >= threshold * F.greatest("n_words", "lead_words") - 1e-9
    pairs = led.filter(close).groupBy(F.col("lead").alias("a"), F.col("fp").alias("b")).agg(F.count("*").alias("shared"))
    first = scratch.save(pairs, "pairs1")
    # Each text first meets the leader it shares most buckets with; then only leaders that this has not tied it to.
    best = first.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    wanted = scratch.save(led.select("fp").union(led.select(F.col("lead").alias("fp"))).distinct(), "wanted")
    seqs = scratch.save(sequences(docs, wanted), "seqs")
    links1 = scratch.save(verified(scratch.save(best, "best"), seqs, threshold), "links1")
    tie = scratch.save(_tied(links1), "tied")
    rest = _apart(first.join(best, ["a", "b"], "left_anti").select("a", "b"), tie)
    found = links1.union(scratch.save(verified(scratch.save(rest, "rest"), seqs, threshold), "links1b"))
    # A text unlike its bucket's least one may be like any other.
    return found.union(scratch.save(_rest(led, some, seqs, found, scratch, threshold), "links2"))


def near_duplicates(spark: SparkSession, docs: DataFrame, *, threshold: float = THRESHOLD, sketches: int = SKETCHES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row: doc_id, fp, class_id (the least doc_id of its class), copies (rows of equal words),
    leader_links (verified links, which pairs in one class by others are without), keep.

    ``keep`` is true for one row of each class, one that has the least doc_id (any one of rows that agree in all).
    """
    scratch = Scratch(spark, "near-dedup")
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = scratch.save(sketch_rows(named, sketches), "rows", zstd=True)
    nodes = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("sketch").alias("sketch"), F.first("bins").alias("bins")), "nodes", zstd=True)
    found = scratch.save(links(named, nodes, scratch, threshold), "links")
    ends = found.select("a").union(found.select("b")).groupBy(F.col("a").alias("fp")).agg(F.count("*").alias("leader_links"))
    node = F.struct("rep", "fp")  # in the order of doc_id, so that a component's least node names its class
    named_a, named_b = (nodes.select(F.col("fp").alias(c), node.alias(f"node_{c}")) for c in "ab")
    edges = found.join(named_a, "a").join(named_b, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    roots = components(edges, scratch).select(F.col("node.fp").alias("fp"), "root")
    of = nodes.select("fp", "copies", node.alias("node")).join(ends, "fp", "left").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "node"))
    classed = of.select("fp", F.col("root.rep").alias("class_id"), "copies", F.coalesce("leader_links", F.lit(0)).alias("leader_links"), (F.col("root.fp") == F.col("fp")).alias("leads"))
    out = rows.select("doc_id", "fp").join(classed, "fp")
    return out.select("doc_id", F.hex("fp").alias("fp"), "class_id", "copies", "leader_links", (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("keep"))


def deduplicated(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` with one row of each class, all columns as they were."""
    classes = near_duplicates(spark, docs, **how).filter("keep").select(F.col("doc_id").alias("__doc"), F.col("fp").alias("__of")).dropDuplicates(["__of"])
    fps = _row_fingerprints(docs)
    kept = fps.join(classes, (F.col("__fp") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi")
    return kept.dropDuplicates(["__fp"]).select(docs.columns)


def _row_fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with the fingerprint of each row's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [x.tobytes().hex().upper() for x in fingerprints(words_or_rest(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "__fp"])

    return with_columns(docs, run, "__fp string")
