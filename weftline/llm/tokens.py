"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once a worker.

The vocabulary's pre-tokenizer lets no token span white space, and cuts a word into runs of letters,
single digits and runs of other marks. A batch of texts is cut by the same rule in NumPy where that is
sure to agree: white-space separated words of ASCII and Latin-1 letters, which have one form under NFC
and one lower case, digits, and ASCII marks but for the apostrophe (contractions) and `<` (special
tokens). Any other word goes to the library whole, as it is. Distinct pieces are found by 64-bit
hashes and compared byte by byte, looked up by their bytes in the worker's store, and encoded by the
library where they are new.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from weftline.llm.columns import hash_spans, pieces, spans_equal, text_buffer

#: The vocabulary's file name for ``public_tokenizers.path``, and the id that ends each document.
VOCABULARY, END_ID = "word_bpe_49k.json", 1
#: Pieces that a worker remembers; beyond, its store starts anew.
STORE_ENTRIES = 300_000

_WHITE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[[32, *range(9, 14)]] = _WHITE
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[*range(33, 39), *range(40, 48), 58, 59, *range(61, 65), *range(91, 97), *range(123, 127)]] = _MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's bytes: the bytes lower-cased where that is sure, start and end of each piece, and which pieces are odd."""
    n = len(data)
    kind, low = _KIND[data], _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    second = data[lead + 1]
    good = (second != 0x97) & (second != 0xB7)
    kind[lead[~good]] = _ODD
    kind[lead[good] + 1] = _LETTER
    capital = lead[good & (second < 0x9F)] + 1
    low[capital] += 32
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if len(odd := np.flatnonzero(kind == _ODD)):
        white = kind == _WHITE
        begins = np.flatnonzero(~white & (edge[:n] | np.concatenate([[True], white[:-1]])))
        after = np.flatnonzero(~white & (edge[1:] | np.concatenate([white[1:], [True]]))) + 1
        word = np.unique(np.searchsorted(begins, odd, "right") - 1)
        size = after[word] - begins[word]
        at = np.repeat(begins[word] - np.cumsum(size) + size, size) + np.arange(size.sum())
        kind[at] = _ODD
        low[at] = data[at]
    change = edge
    change[1:n] |= kind[1:] != kind[:-1]
    change[:n] |= kind == _DIGIT
    bounds = np.flatnonzero(change)
    if n and bounds[0]:
        bounds = np.concatenate([[0], bounds])
    start, end = bounds[:-1], bounds[1:]
    if not n:
        start = end = np.zeros(0, np.int64)
    keep = kind[start] != _WHITE if n else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    return low, start, end, kind[start] == _ODD


class Encoder:
    """Ids of texts, ``end_id`` last."""

    def __init__(self, path: str, end_id: int | None = END_ID, entries: int = STORE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id, self.entries = end_id, entries
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))])
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for one in found for i in one], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of texts that are one pre-token each: many in one call, cut after each id that closes a word."""
        ids, sizes = [], []
        for at in range(0, len(texts), 2000):
            some = texts[at : at + 2000]
            one = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closes[one]) + 1
            n = np.diff(ends, prepend=0)
            if len(ends) != len(some) or ends[-1] != len(one):
                one, n = self._library(some)
            ids.append(one)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def _add(self, found: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        base = len(self.slot)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while base + len(found) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[base + 1 : base + 1 + len(found)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.slot.update(zip(found, range(base, base + len(found)), strict=True))

    @staticmethod
    def _distinct(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Which distinct piece each piece is, the first place of each distinct one, and their bytes."""
        text = low.tobytes()
        codes, distinct = pd.factorize(hash_spans(low, start, end))
        where = np.zeros(len(distinct), np.int64)
        where[codes[::-1]] = np.arange(len(codes))[::-1]
        if not spans_equal(low, start, end, where[codes]):  # two pieces of one hash
            every = np.empty(len(start), object)
            every[:] = [text[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]
            codes, keys = pd.factorize(every)
            where = np.zeros(len(keys), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
        return codes, where, [text[i:j] for i, j in zip(start[where].tolist(), end[where].tolist(), strict=True)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a batch's bytes: all ids, and n + 1 bounds of texts."""
        low, start, end, odd = cut(data, offsets)
        codes, where, keys = self._distinct(low, start, end)
        if len(self.slot) + len(keys) > self.entries:
            self._reset()
        new = [i for i, k in enumerate(keys) if k not in self.slot]
        if new:
            new = np.array(new)
            for some, encode in ((new[~odd[where[new]]], self._plain), (new[odd[where[new]]], self._library)):
                if len(some):
                    found = [keys[i] for i in some.tolist()]
                    self._add(found, *encode([k.decode("utf-8", "replace") for k in found]))
        slots = np.fromiter(map(self.slot.__getitem__, keys), np.int64, len(keys))[codes]
        size = self.at[slots + 1] - self.at[slots]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[slots] - ends[:-1], size) + np.arange(ends[-1])]
        bounds = ends[np.searchsorted(start, offsets)]
        if self.end_id is None:
            return ids, bounds
        out = np.full(len(ids) + len(offsets) - 1, self.end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))] = ids
        return out, bounds + np.arange(len(offsets))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None = END_ID) -> Encoder:
    """One a worker, kept over tasks."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None = END_ID, key: str = "doc_id", text: str = "text") -> Iterator[tuple[list, list[np.ndarray]]]:
    """Of record batches: keys and id arrays, some megabytes at a time."""
    enc = encoder(path, end_id)
    for batch in pieces(batches):
        ids, bounds = enc.encode(*text_buffer(batch.column(text)))
        cuts = bounds.tolist()
        yield batch.column(key).to_pylist(), [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
