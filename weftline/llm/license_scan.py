"""Operator 8: license notices by template automata.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased. A template is plain wording with markup:
`[[words]]` may be missing, `{{name:1-6}}` stands for one to six words of any kind. Each is compiled to
a token automaton: one state a word, skips over optional regions, any-word steps for replaceable ones.
A text gets a template's label where the automaton accepts, that is where all mandatory words follow
each other exactly but for those regions. The automata start at words that can begin a template,
found for a whole batch at once by hash.

Phrases with labels of their own are found the same way, as places of consecutive words. ``score`` is
the largest share of a template's mandatory words that stood in order, 1 where one is complete, 0
where none has begun. Null text has no words, no labels and score 0. Rows that repeat a doc_id are rows of
their own; columns beyond the two named are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.columns import ALNUM_LOWER, Words, pieces, words

#: Phrases and their labels: fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates and their labels: notices as their licenses word them.
TEMPLATES = [
    ("apache-2.0", "licensed under the Apache License Version 2.0 [[the License]] [[you may not use this file except in compliance with the License]]"),
    ("mit", "[[released]] [[licensed]] [[distributed]] under the MIT License"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the Software]] to deal in the Software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "[[licensed]] [[released]] under the [[new]] [[revised]] [[3 clause]] BSD [[3 clause]] License"),
    ("gpl-2.0", "[[this]] [[{{kind:1-3}} is]] licensed under the [[terms of the]] GNU General Public License version 2 [[or any later version]]"),
    ("gpl-3.0", "[[this]] [[{{kind:1-3}} is]] licensed under the [[terms of the]] GNU General Public License version 3 [[or any later version]]"),
    ("gpl-any", "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the [[terms of the]] GNU Lesser General Public License [[version 2.1]] [[version 3]]"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License v 2.0"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] CC BY 4.0 [[International]] [[license]]"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] CC BY SA 4.0 [[International]] [[license]]"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] CC BY NC 4.0 [[International]] [[license]]"),
    ("cc-by-nc-nd-4.0", "licensed under [[a]] [[the]] CC BY NC ND 4.0 [[International]] [[license]]"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] Creative Commons Attribution 4.0 International [[License]]"),
    ("cc0-1.0", "[[dedicated]] to the public domain under CC0 1.0 [[Universal]]"),
    ("copyright", "copyright [[c]] {{year:1-2}} [[by]] {{holder:1-6}} all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_PART = re.compile(r"\[\[|\]\]|\{\{\s*\w+\s*:\s*(\d+)\s*-\s*(\d+)\s*\}\}|[^\[\]{}]+")


def word_hashes(text: str) -> np.ndarray:
    return words(pa.array([text]), ALNUM_LOWER).hash


class Automaton:
    """States are bits; a step consumes one word and moves each live state one on."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.on: dict[int, int] = {}  # word -> states that it moves
        self.any = 0
        self.skips: list[tuple[int, int]] = []
        state, opened, self.mandatory = 0, [], [0]
        for part in _PART.finditer(template):
            if part[0] == "[[":
                opened.append((state, self.mandatory[-1]))
            elif part[0] == "]]":
                begin, before = opened.pop()
                self.skips.append((begin, state))
                self.mandatory[-1] = before
            elif part[1]:
                low, high = int(part[1]), int(part[2])
                for k in range(high):
                    if k >= low:
                        self.skips.append((state, state + high - k))
                    self.any |= 1 << state
                    state += 1
                    self.mandatory.append(self.mandatory[-1])
            else:
                for h in word_hashes(part[0]).tolist():
                    self.on[h] = self.on.get(h, 0) | 1 << state
                    state += 1
                    self.mandatory.append(self.mandatory[-1] + (not opened))
        self.final = state
        self.skips.sort()
        self.begin = self._skipped(1)
        self.first = {h for h, states in self.on.items() if states & self.begin}

    def _skipped(self, live: int) -> int:
        for a, b in self.skips:
            if live >> a & 1:
                live |= 1 << b
        return live

    def run(self, tokens: list[int]) -> tuple[bool, float]:
        """Whether a prefix of the tokens is accepted, and the largest share of mandatory words met."""
        live, best = self.begin, 0
        for h in tokens:
            live = self._skipped((live & (self.on.get(h, 0) | self.any)) << 1)
            if not live:
                break
            best = max(best, self.mandatory[live.bit_length() - 1])
            if live >> self.final & 1:
                return True, 1.0
        return False, best / max(1, self.mandatory[self.final])


@functools.cache
def compiled() -> tuple[list[Automaton], np.ndarray, list[tuple[str, np.ndarray]]]:
    """Automata, the sorted words that can begin one, and phrases."""
    automata = [Automaton(*t) for t in TEMPLATES]
    first = np.array(sorted({h for a in automata for h in a.first}), np.uint64)
    return automata, first, [(label, word_hashes(phrase)) for phrase, label in PHRASES.items()]


def phrase_places(w: Words, phrase: np.ndarray) -> np.ndarray:
    """The first words of all places of a phrase."""
    at = np.flatnonzero(w.hash[: len(w.hash) - len(phrase) + 1] == phrase[0]) if len(w.hash) >= len(phrase) else np.zeros(0, np.int64)
    for k in range(1, len(phrase)):
        at = at[w.hash[at + k] == phrase[k]]
    row = np.searchsorted(w.first, at, "right") - 1
    return at[at + len(phrase) <= w.first[row + 1]]


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every text."""
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, first, phrases = compiled()
        reach = max(a.final for a in automata)
        for batch in pieces(batches):
            w = words(batch.column("text"), ALNUM_LOWER)
            n = batch.num_rows
            count, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set] = [set() for _ in range(n)]
            more: list[set] = [set() for _ in range(n)]
            score = np.zeros(n)
            for label, phrase in phrases:
                at = phrase_places(w, phrase)
                row = np.searchsorted(w.first, at, "right") - 1
                np.add.at(count, row, 1)
                np.minimum.at(low, row, at - w.first[row])
                np.maximum.at(high, row, at - w.first[row])
                for r in set(row.tolist()):
                    base[r].add(label)
            anchors = np.flatnonzero(np.isin(w.hash, first))
            rows = np.searchsorted(w.first, anchors, "right") - 1
            for at, r in zip(anchors.tolist(), rows.tolist(), strict=True):
                tokens = w.hash[at : min(at + reach, w.first[r + 1])].tolist()
                for a in automata:
                    if tokens[0] in a.first:
                        accepted, share = a.run(tokens)
                        score[r] = max(score[r], share)
                        if accepted:
                            more[r].add(a.label)
            none = count == 0
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(w.first)), pa.array(count), pa.array(low, mask=none), pa.array(high, mask=none),
                pa.array([",".join(sorted(b)) for b in base], pa.string()), pa.array([",".join(sorted(b | m)) for b, m in zip(base, more, strict=True)], pa.string()), pa.array(score),
            ], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
