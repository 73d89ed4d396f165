"""Operator 2: base rules, and an isolation forest over rule statistics.

Every text gets the counts of ``rule_statistics``. Trees are grown on labelled documents of good
quality, at most ``FIT_ROWS`` of them (chosen by the hash of doc_id; the one bounded sample), each
tree on ``TREE_ROWS``. A split takes a random statistic and a random value within the range that all
labelled rows, good and bad, have there: a document off the beaten range falls into an empty branch
early, so its path is short. score = 2 ** (-mean path length / expected length), between 0 and 1.
The threshold comes from the scores of all labelled rows, by their histogram in ``BINS`` steps: the
one that errs least, a good document dropped weighing ``GOOD_WEIGHT`` bad ones kept.

Null text has no words and fails the base rules. Rows without a label only get scored; without any
labelled good row the verdict is that of the base rules alone. Rows that repeat a doc_id are rows of
their own; a doc_id with several labels counts with each. Columns beyond the ones named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.columns import SPACE, hash_spans, mix, pieces, text_buffer, window_hashes, with_columns, words
from weftline.llm.scratch import Scratch

FIT_ROWS, TREES, TREE_ROWS, DEPTH, BINS, GOOD_WEIGHT = 4096, 128, 256, 12, 2000, 20
TRUST_WORDS = 24
#: The base rules: fewer words than this fail; so does a larger share of words in repeated windows.
LEAST_WORDS, MOST_REPEATED, REPEAT_WINDOW = 20, 30, 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["symbols", "distinct", "upper", "stops", "marks", "word_length", "short_words", "line_words"]
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), [*range(65, 91)])
_STOPS = np.isin(np.arange(256), list(b".!?"))
_MARKS = np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def rule_statistics(column) -> tuple[np.ndarray, np.ndarray]:
    """(rows, COUNTS) as integers, and (rows, SHARES) as floats, of a text column."""
    w = words(column, SPACE)
    data, offsets, n = w.data, w.offsets, np.diff(w.first)
    rows = len(n)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    raw, _ = text_buffer(column)
    inside = data != 0
    chars = per_row(inside & ((data & 0xC0) != 0x80))
    symbols = per_row(_SYMBOLS[raw])
    # Lines.
    newline = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    begin = begin[begin < len(raw)]
    owner = np.searchsorted(offsets, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], len(raw)), offsets[owner + 1])
    ends_nl = (end > begin) & (raw[np.maximum(end - 1, 0)] == 10) if len(raw) else np.zeros(len(begin), bool)
    end = end - ends_nl
    any_word = np.concatenate([[0], np.cumsum(inside)])
    full = any_word[end] > any_word[begin]
    begin, end, owner = begin[full], end[full], owner[full]
    with np.errstate(over="ignore"):
        line = mix(hash_spans(raw, begin, end) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    dup_lines = np.bincount(owner[pd.Series(line).duplicated().to_numpy()], minlength=rows)
    lines = np.bincount(owner, minlength=rows)
    # Windows of words found twice or more.
    h, at = window_hashes(w.hash, w.first, REPEAT_WINDOW)
    row = np.searchsorted(w.first, at, "right") - 1
    with np.errstate(over="ignore"):
        key = mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = at[pd.Series(key).duplicated(keep=False).to_numpy()]
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + REPEAT_WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    repeated = covered[w.first[1:]] - covered[w.first[:-1]]
    # Shares.
    with np.errstate(over="ignore"):
        key = mix(w.hash + w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(w.row[~pd.Series(key).duplicated().to_numpy()], minlength=rows)
    size = w.end - w.start
    count, char = np.maximum(n, 1), np.maximum(chars, 1)
    trust = n / (n + TRUST_WORDS)  # a few words say little of a share
    shares = np.stack([
        trust * symbols / char, distinct / count ** 0.75, trust * per_row(_UPPER[raw]) / char, trust * per_row(_STOPS[raw]) / count, trust * per_row(_MARKS[raw]) / char,
        np.minimum(chars / count, 40), trust * np.bincount(w.row[size < 3], minlength=rows) / count, np.log1p(n / np.maximum(lines, 1)),
    ], axis=1)
    return np.stack([n, chars, symbols, dup_lines, repeated], axis=1).astype(np.int64), shares


class Forest:
    """Trees as arrays: node k has children 2k + 1 and 2k + 2."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, size: int = TREE_ROWS, depth: int = DEPTH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth, nodes = depth, (1 << (depth + 1)) - 1
        self.feature = np.zeros((trees, nodes), np.int16)
        self.value = np.zeros((trees, nodes))
        self.path = np.zeros((trees, nodes))
        self.leaf = np.ones((trees, nodes), bool)
        self.size = min(size, len(rows))
        for t in range(trees):
            mine = rows[rng.choice(len(rows), self.size, replace=False)]
            self._grow(t, 0, 0, mine, low.copy(), high.copy(), rng)

    def _grow(self, t: int, node: int, level: int, rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng) -> None:
        open_ = np.flatnonzero(high > low)
        if level == self.depth or len(rows) <= 1 or not len(open_):
            self.path[t, node] = level + _expected(len(rows))
            return
        f = int(rng.choice(open_))
        v = float(rng.uniform(low[f], high[f]))
        self.leaf[t, node], self.feature[t, node], self.value[t, node] = False, f, v
        left = rows[:, f] < v
        lower, upper = high.copy(), low.copy()
        lower[f] = upper[f] = v
        self._grow(t, 2 * node + 1, level + 1, rows[left], low, lower, rng)
        self._grow(t, 2 * node + 2, level + 1, rows[~left], upper, high, rng)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = ~self.leaf[t, node]
                if not inner.any():
                    break
                right = x[np.arange(len(x)), self.feature[t, node]] >= self.value[t, node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += self.path[t, node]
        return 2.0 ** (-total / len(self.feature) / max(_expected(self.size), 1e-9))


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts, and the shares as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counts, shares = rule_statistics(batch.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, shares.size + 1, shares.shape[1], dtype=np.int32)), pa.array(shares.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T), flat], names=["doc_id", *COUNTS, "shares"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, shares array<double>")


def base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def calibrated(counted: list, bins: int = BINS) -> float:
    """From (bin, quality, rows): the score from which on documents are dropped."""
    good, bad = np.zeros(bins + 1), np.zeros(bins + 1)
    for at, quality, n in counted:
        (good if quality else bad)[at] += n
    dropped_good = np.append(np.cumsum(good[::-1])[::-1], 0)
    kept_bad = np.concatenate([[0], np.cumsum(bad)])
    cost = GOOD_WEIGHT * dropped_good + kept_bad
    best = np.flatnonzero(cost == cost.min())
    return float(best[len(best) // 2]) / bins  # in the middle of a gap, should there be one


def fitted(spark: SparkSession, counted: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[Forest, float] | None:
    """The forest and its threshold, from ``statistics`` and labels; None without a labelled good row."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality IS NOT NULL")
    labelled = scratch.save(counted.filter(~base_failed()).join(known, "doc_id").select("doc_id", "quality", "shares"), "labelled")
    fit = labelled.filter("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).collect()
    if not fit:
        return None
    ends = labelled.select([f(F.col("shares")[k]).alias(f"{f.__name__}{k}") for k in range(len(SHARES)) for f in (F.min, F.max)]).first()
    forest = Forest(np.array([r["shares"] for r in fit]), np.array(ends[::2]), np.array(ends[1::2]))
    bins = labelled.select(F.floor(scorer(spark, forest)("shares") * BINS).cast("int").alias("bin"), "quality").groupBy("bin", "quality").agg(F.count("*").alias("n"))
    return forest, calibrated(bins.collect())  # at most 2 * BINS rows


def scorer(spark: SparkSession, forest: Forest):
    """The forest's score as a function of the column of shares."""
    shared = spark.sparkContext.broadcast(forest)  # trees * 2 ** (depth + 1) nodes

    @F.pandas_udf("double")
    def score(shares: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(np.stack(shares.to_numpy())) if len(shares) else [], dtype=float)

    return score


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, score (null without a forest), kept."""
    scratch = Scratch(spark, "quality")
    counted = scratch.save(statistics(docs), "statistics")
    model = fitted(spark, counted, labels, scratch)
    verdict = counted.withColumn("base_failed", base_failed())
    if model is None:
        return verdict.select("doc_id", *COUNTS, "base_failed", F.lit(None).cast("double").alias("score"), (~F.col("base_failed")).alias("kept"))
    forest, threshold = model
    scored = verdict.withColumn("score", scorer(spark, forest)("shares"))
    return scored.select("doc_id", *COUNTS, "base_failed", "score", (~F.col("base_failed") & (F.col("score") < threshold)).alias("kept"))


def kept_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the verdict rejects; all columns as they were.

    Each row is judged where it is, by its own text, so no join brings the verdicts back.
    """
    scratch = Scratch(spark, "quality")
    model = fitted(spark, scratch.save(statistics(docs), "statistics"), labels, scratch)
    scratch.drop("statistics")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counts, shares = rule_statistics(batch.column("text"))
            keep = (counts[:, 0] >= LEAST_WORDS) & (100 * counts[:, 4] <= MOST_REPEATED * counts[:, 0])
            if shared.value is not None:
                forest, threshold = shared.value
                some = np.flatnonzero(keep)
                keep[some] = forest.scores(shares[some]) < threshold
            yield batch.filter(pa.array(keep))

    return with_columns(docs, run, "")
