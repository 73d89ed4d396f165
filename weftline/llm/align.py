"""Banded alignment of word sequences: edit distance by bit-parallel columns that slide along the diagonal."""

from __future__ import annotations

import numpy as np


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Length of the common prefix, and of the common suffix of what it leaves."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    n -= head
    if not n:
        return head, 0
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    return head, int(differ[0]) if len(differ) else n


#: Bits of the table that marks the places of each distinct word; larger ones are made column by column.
TABLE_BITS = 1 << 27


def edit_distance(a: np.ndarray, b: np.ndarray, most: int, band: int = 24) -> int | None:
    """Insertions, deletions and replacements that make b of a; None if over ``most``.

    Equal ends are cut off first, and sequences with too few words in common turned away. What is left is
    aligned in bands of growing width, from ``band`` on: like texts end in the first, and the last is as wide as ``most`` asks.
    """
    if abs(len(a) - len(b)) > most:
        return None
    head, tail = common_ends(a, b)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if not n:
        return m if m <= most else None
    _, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    words = int(codes.max()) + 1
    if m - np.minimum(np.bincount(codes[:m], minlength=words), np.bincount(codes[m:], minlength=words)).sum() > most:
        return None
    most, band = min(most, m), max(m - n, band)
    while 3 * band < most:
        found = _banded(codes[:m], codes[m:], words, band)
        if found is not None:
            return found
        band *= 4
    return _banded(codes[:m], codes[m:], words, most)


def _places(a: np.ndarray, words: int, width: int):
    """A function of a word and a row: as bits, where the word stands in the ``width`` rows from that one on."""
    full = (1 << width) - 1
    if words * len(a) <= TABLE_BITS:
        table = [0] * words
        for i, x in enumerate(a.tolist()):
            table[x] |= 1 << i
        return lambda x, row: (table[x] >> row if row >= 0 else table[x] << -row) & full
    order = np.argsort(a, kind="stable")
    first = np.searchsorted(a[order], np.arange(words + 1))

    def find(x: int, row: int) -> int:
        mine = order[first[x] : first[x + 1]]
        mine = mine[np.searchsorted(mine, row) : np.searchsorted(mine, row + width)] - row
        if len(mine) <= 8:
            bits = 0
            for k in mine.tolist():
                bits |= 1 << k
            return bits
        marks = np.zeros(width, bool)
        marks[mine] = True
        return int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")

    return find


def _banded(a: np.ndarray, b: np.ndarray, words: int, most: int) -> int | None:
    """Only the ``2 * most + 1`` diagonals that can matter are kept: one integer holds the vertical
    differences of a column within the band (Hyyrö 2003)."""
    m, n = len(a), len(b)
    # Rows i - most .. i + most of column i; bit k stands for row i - most + k, counted from 1.
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    place = _places(a, words, width)
    vp, vn = full & ~((1 << (most + 1)) - 1), 0
    # Column 0: rows 1..most lie most + 1 .. 2 * most bits up; their vertical difference is +1.
    distance = most  # of the band's last row, row i + most
    for i, x in enumerate(b.tolist(), 1):
        eq = place(x, i - most - 1)
        vp, vn = vp >> 1, vn >> 1
        # The row that enters the band below is at most one more than the one above it.
        vp |= top
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        # Along the diagonal the band's last row costs one unless d0 is set there.
        distance += not d0 & top
        vp = (hn << 1 | (full & ~(d0 | (hp << 1)))) & full
        vn = d0 & (hp << 1) & full
    # From row n + most back to row m.
    for row in range(n + most, m, -1):
        bit = 1 << (row - (n - most))
        distance -= bool(vp & bit) - bool(vn & bit)
    return distance if distance <= most else None


#: Band of ``near_distances``, whose columns are 64-bit numbers; longest sequence and most cells of one table there.
NEAR, NEAR_LENGTH, NEAR_CELLS = 31, 1 << 12, 1 << 20


def near_distances(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """The edit distances of many pairs of sequences of 32-bit words at once: as ``edit_distance`` gives them up to ``NEAR``,
    NEAR + 1 for those beyond, -1 for pairs with a sequence that is too long for this."""
    out, open_ = [NEAR + 1] * len(pairs), []
    for k, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > NEAR:
            continue
        head, tail = common_ends(a, b)
        a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        if len(a) < len(b):
            a, b = b, a
        if not len(b):
            out[k] = len(a)
        elif len(a) > NEAR_LENGTH:
            out[k] = -1
        else:
            open_.append((len(b), k, a, b))
    open_.sort(key=lambda one: (-one[0], one[1]))
    while open_:
        some = max(1, NEAR_CELLS // (open_[0][0] + 3 * NEAR))
        for (_, k, _, _), found in zip(open_[:some], _near(open_[:some]), strict=True):
            out[k] = found
        open_ = open_[some:]
    return out


def _near(some: list[tuple]) -> list[int]:
    """``_banded`` with ``NEAR`` as band, column by column for all pairs (longest b first); each stops at its own last column."""
    n, m = (np.array([len(one[c]) for one in some]) for c in (3, 2))
    rows, columns = np.full((len(some), int(n[0]) + 3 * NEAR + 2), 1 << 32, np.uint64), np.zeros((len(some), int(n[0])), np.uint64)
    for i, (_, _, a, b) in enumerate(some):
        rows[i, NEAR : NEAR + len(a)], columns[i, : len(b)] = a, b
    full, top, one = np.uint64((1 << 63) - 1), np.uint64(62), np.uint64(1)
    vp, vn = np.full(len(some), (1 << 63) - (1 << (NEAR + 1)), np.uint64), np.zeros(len(some), np.uint64)
    distance = np.full(len(some), NEAR)
    active = len(some) - np.searchsorted(n[::-1], np.arange(1, n[0] + 1))
    for i, live in enumerate(active.tolist()):
        eq = np.packbits(rows[:live, i : i + 64] == columns[:live, i, None], axis=1, bitorder="little").view(np.uint64)[:, 0] & full
        p, q = vp[:live] >> one | one << top, vn[:live] >> one
        d0 = ((((eq & p) + p) ^ p) | eq | q) & full
        hp, hn = (q | (full & ~(d0 | p))) << one, d0 & p
        distance[:live] += (d0 >> top == 0).astype(np.int64)
        vp[:live], vn[:live] = (hn << one | (full & ~(d0 | hp))) & full, d0 & hp & full
    below = full & ~((one << (m - n + NEAR + 1).astype(np.uint64)) - one)
    distance -= np.bitwise_count(vp & below).astype(np.int64) - np.bitwise_count(vn & below).astype(np.int64)
    return np.minimum(distance, NEAR + 1).tolist()
