"""Each operator on rows with every odd case, against brute force; and on empty tables."""

from __future__ import annotations

import collections
import functools
import hashlib
import io
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.compare import duck, rows
from weftline.llm import align, class_lm, decontaminate, html_text, license_scan, near_dedup, packing, passages, quality, queries, token_files, tokens, url_rules
from weftline.llm.columns import ALNUM_LOWER, SPACE_LOWER, words

random.seed(5)
VOCABULARY = ["".join(random.choice("abcdefghijklmno") for _ in range(random.randint(2, 8))) for _ in range(900)] + ["Étude", "naïve", "x-y", "3rd"]


def prose(n: int) -> str:
    return " ".join(random.choice(VOCABULARY) + random.choice(["", "", ".", ",", ".\n"]) for _ in range(n))


BASE, PASSAGE = prose(160), prose(70)
CHANGED = BASE.split(" ")
for _at in (3, 40, 41, 90):
    CHANGED[_at] = "zzz"
DOCS: list[tuple] = [
    (0, BASE), (1, BASE), (2, " ".join(CHANGED)), (3, prose(200)), (4, None), (5, ""), (6, " \n\t "), (7, prose(120) + " " + PASSAGE), (8, prose(90) + " " + PASSAGE + " " + prose(60)),
    (9, prose(3)), (10, "###$$$ &&& ***"), (11, prose(30000)), (12, "All rights reserved. Licensed under CC BY-NC 4.0. All Rights reserved"), (13, "same line here\n" * 9 + prose(30)),
    (14, prose(40)), (14, prose(40)), (3, None), (None, prose(50)), (15, "漢字 😀 <|endoftext|> don't 12a"), (16, "Released under the MIT License."),
]
SCHEMA = "doc_id long, text string, source string, n_words long, score double, fp string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, "s", -1, -1.0, "x") for d in DOCS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def alnum(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def spaced(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def library_ids(text: str | None) -> list[int]:
    return library().encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- 1


PAGE = """<html><head><title>t</title><script>var a = "</p>";</script></head><body class="has-sidebar"><header><div>Site</div><nav><a href=/>Home</a></nav></header>
<article><h1>Heading &amp; more</h1><p>First  paragraph with <a href="x>y">a link</a> &mdash; and<br>a break.<p>Short.<div class="ad">Buy it now, it is cheap!</div>
<ul><li>one item of the list<li>another</ul></article><section id=comments><div class="comment"><p>I liked this long article very much, and I say so in a comment.</p></div></section>
<form><label>Name</label><input></form><footer>&copy; Site. All rights reserved.</footer></body>"""


def test_html(spark):
    want = "Heading & more\nFirst paragraph with a link — and a break.\nShort.\none item of the list\nanother"
    assert html_text.main_text(PAGE) == want
    cases = [None, "", "<", "no markup but a sentence that goes on for quite a few words, so that it is content.", "<div", "<!-- x", "<script>x", "a <b> c"]
    got = html_text.extracted(spark, spark.createDataFrame([(i, None, c, "z") for i, c in enumerate([*cases, PAGE, PAGE])], "page_id long, url string, html string, text string")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 10 and by[0]["text"] == by[1]["text"] == "" and by[8]["text"] == by[9]["text"] == want and by[3]["text"] == cases[3]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    for broken in ("<a " * 350_000, '<a "' * 250_000, "<div>" * 100_000 + "</span></p></x>" * 40_000, "<a '\">" * 150_000):  # a second or two each if work is in proportion
        began = time.time()
        html_text.main_text(broken)
        assert time.time() - began < 20
    x, y = html_text.labelled_table()
    assert (html_text.trained_tree().predict(x) == y).mean() > 0.98
    assert html_text.extracted(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- 2


def base_counts(text: str | None) -> tuple:
    text = text or ""
    w = spaced(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if spaced(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in (0, 2, 3, 7, 8)] + [(10, 0, 0), (14, 0, 1), (99, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(spark, docs, labels).collect()
    assert sorted(map(repr, ((r["doc_id"], *(r[c] for c in quality.COUNTS)) for r in got))) == sorted(map(repr, ((d, *base_counts(t)) for d, t in DOCS)))
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    empty = labels.filter("doc_id < 0")
    assert all(r["kept"] != r["base_failed"] and r["score"] is None for r in quality.judged(spark, docs, empty).collect())
    kept = [(r["doc_id"], r["text"]) for r in quality.kept_documents(spark, docs, labels).collect()]
    assert sorted(repr(d) for d, _ in kept) == sorted(repr(r["doc_id"]) for r in got if r["kept"])
    again = spark.createDataFrame([(0, BASE), (0, "too short"), (0, BASE)], "doc_id long, text string")
    assert [r["text"] for r in quality.kept_documents(spark, again, empty).collect()] == [BASE, BASE]  # rows of their own
    assert quality.judged(spark, none, labels).count() == 0 and quality.kept_documents(spark, docs, labels).columns == docs.columns


def test_forest_parts_odd_rows_from_the_rest():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (600, 4)), rng.normal(8, 1, (60, 4))
    both = np.concatenate([good, bad])
    forest = quality.Forest(good[:400], both.min(0), both.max(0))
    assert (forest.scores(good[400:])[:, None] < forest.scores(bad)[None]).mean() > 0.99
    assert 0.2 < quality.calibrated([(100, 1, 50), (300, 1, 50), (700, 0, 9), (900, 0, 9)]) <= 0.35


# ---- 3 and 4


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_plane_files(planes):
    ids = [np.array(random.choices(range(top), k=n), "<u4") for top, n in ((200, 0), (200, 7), (60000, 5000), (1 << 30, 33))]
    sink = io.BytesIO()
    writer = token_files.PlaneWriter(sink, block=1024, planes=planes)
    for k, one in enumerate(ids):
        writer.add(k, one)
    size = writer.close()
    reader = token_files.PlaneReader(io.BytesIO(sink.getvalue()), size)
    assert [(d, x.tolist()) for d, x in reader.documents()] == [(k, x.tolist()) for k, x in enumerate(ids)]
    assert reader.ids(1000, 3000).tolist() == np.concatenate(ids)[1000:3000].tolist()
    with pytest.raises(ValueError):
        token_files.PlaneReader(io.BytesIO(b"x" * 64), 64)


def test_token_files(spark, docs, none, tmp_path):
    got = token_files.token_files(spark, docs, f"file://{tmp_path}", block=2048).collect()
    start, found = 0, {tuple(r) for r in got}
    for d, t in sorted(DOCS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = library_ids(t)
        assert (d, start, len(ids), crc(ids)) in found
        start += len(ids)
    assert len(got) == len(DOCS) and token_files.token_files(spark, none, f"file://{tmp_path}/none").count() == 0


def thue_morse(n: int, first: int) -> str:
    bits = [first]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits)


def test_long_words_that_polynomials_confuse(spark):
    x, y = thue_morse(4096, 0), thue_morse(4096, 1)
    texts = [x, y, f"{x} {y} {x}", f"{y} {x} {y}"] + [f"{w} {prose(30)}" for w in (x, y)]
    assert len(set(words(pa.array([x, y]), ALNUM_LOWER).hash.tolist())) == 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in packing.packed(spark, docs).collect() if r["piece"] == 0}
    read = {r["doc_id"]: r for r in token_files.token_files(spark, docs).collect()}
    for d, t in enumerate(texts):
        ids = library_ids(t)
        assert got[d]["ids_crc32"] == crc(ids[:4096]) and read[d]["ids_crc32"] == crc(ids)
    assert len({r["fp"] for r in near_dedup.near_duplicates(spark, docs).collect()}) == len(texts)
    items = [(1, f"{x} {x}"), (2, y)]
    found = decontaminate.contamination(spark, docs, spark.createDataFrame(items, "item_id long, text string")).drop("text").collect()
    assert sorted(map(tuple, found)) == sorted((d, *hits(t, items)) for d, t in enumerate(texts))
    n = {r["doc_id"]: r["n_known"] for r in class_lm.scored(spark, docs.filter("doc_id IN (0, 4)")).collect()}
    assert n[0] == 2 and n[4] >= 2


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "hash_spans", lambda data, start, end: np.zeros(len(start), np.uint64))
    enc, text = tokens.Encoder(tokens.vocabulary_path()), "one two don't two 12 one"
    ids, _ = enc.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert ids.tolist() == library_ids(text)


def test_packing(spark, docs, none):
    got = packing.packed(spark, docs).collect()
    want = sorted((d is None, d or 0, k, o, len(ids[o : o + 4096]), crc(ids[o : o + 4096])) for d, t in DOCS for ids in [library_ids(t)] for k, o in enumerate(range(0, len(ids), 4096)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = collections.defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert packing.packed(spark, none).count() == 0


def test_sums_equal_all_combinations():
    some = random.Random(3)
    for _ in range(400):
        size = some.randint(5, 30)
        count = np.zeros(size + 1, np.int64)
        for _ in range(some.randint(1, 9)):
            count[some.randint(1, size)] += some.randint(1, 2)
        index = packing.SumIndex(count)
        for _ in range(4):
            gap, bag = some.randint(1, size), [x for x in range(size + 1) for _ in range(count[x])]
            fits = [max(fit) for k in (1, 2, 3) if (fit := [tuple(sorted(c, reverse=True)) for c in itertools.combinations(bag, k) if sum(c) == gap])]
            found = index.exact(gap)
            assert (tuple(found) if found else None) == (fits[0] if fits else None)
            for x in found or ():
                count[x] -= 1


def test_patterns_use_each_piece_once_and_fill_exactly():
    histogram = {4096: 3, 3000: 5, 1096: 5, 2000: 4, 1048: 8, 17: 9, 4000: 2}
    used = collections.Counter()
    for lengths, times in packing.patterns(histogram):
        assert sum(lengths) <= 4096
        used.update({k: v * times for k, v in collections.Counter(lengths).items()})
    assert used == histogram
    assert ([3000, 1096], 5) in packing.patterns({3000: 5, 1096: 5}) and ([2000, 1048, 1048], 4) in packing.patterns({2000: 4, 1048: 8})
    with pytest.raises(ValueError):
        packing.patterns({5000: 1})


# ---- 5


def test_chains():
    x = np.array([0, 6, 12, 30, 31, 200])
    y = np.array([50, 56, 62, 80, 5, 250])
    found = passages.chains(x, y)
    assert found[0] == [0, 1, 2, 3] and sorted(sum(found, [])) == list(range(6))


def test_chains_turned_away_cannot_be_long_enough():
    """Few chains are extended one by one, and those that are not would have stayed below the least length."""
    rng, rows = np.random.default_rng(3), []
    for k in range(400):
        a, b = (rng.integers(0, 40 if k % 2 else 10**6, rng.integers(5, 200)).astype("<u4") for _ in range(2))
        x, y = (int(rng.integers(0, len(s) - 4)) for s in (a, b))
        n = int(min(len(a) - x, len(b) - y, (5, 30, 60)[k % 3]))
        b[y : y + n] = a[x : x + n]
        if k % 5 == 0:
            b[y + 5 : y + n : 9] = 7
        low, src_low = max(0, x - passages.PAD), max(0, y - passages.PAD)
        rows.append((x, x + 5, y, y + 5, low, src_low, a[low : x + 5 + passages.PAD].tobytes(), b[src_low : y + 5 + passages.PAD].tobytes()))
    batch = pa.RecordBatch.from_pylist([dict(zip(("x0", "x1", "y0", "y1", "low", "src_low", "seq", "src_seq"), r, strict=True)) for r in rows])
    long_ = []
    for x0, x1, y0, y1, low, src_low, seq, src in rows:
        u, v, *_ = passages.extended(np.frombuffer(seq, "<u4"), np.frombuffer(src, "<u4"), x0 - low, x1 - low, y0 - src_low, y1 - src_low)
        long_.append(v - u >= passages.MIN_WORDS)
    may = passages._may_reach(batch)
    assert sum(long_) > 10 and not (np.array(long_) & ~may).any() and may.sum() < 200


def test_chains_of_many_groups_are_those_of_each():
    rng = np.random.default_rng(4)
    rows = sorted({(int(d), 1, int(s), 1, int(x), int(x + 3 * s if d % 2 else y)) for d, s, x, y in zip(*(rng.integers(0, n, 900) for n in (9, 4, 300, 300)), strict=True)})
    names = ("doc", "ver", "src", "src_ver", "pos", "src_pos")
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    got = [r for b in passages._chained(iter([batch.slice(0, 100), batch.slice(100)])) for r in b.to_pylist()]
    want, leads = [], 0
    for of, group in itertools.groupby(rows, lambda r: r[:4]):
        x, y = np.array(list(group))[:, 4:].T
        spans = [(x[c].tolist(), y[c].tolist()) for c in passages.chains(x, y)]
        want += [(*of, u[0], u[-1] + 5, v[0], v[-1] + 5, np.array([u, v], "<i4").tobytes()) for u, v in spans]
        reach = -1
        for low, high in sorted(((u[0], u[-1] + 5) for u, _ in spans), key=lambda w: (w[0], -w[1])):
            if high > reach:
                reach, leads = high + passages.PAD, leads + 1
    assert sorted(tuple(r.values())[:-1] for r in got) == sorted(want) and sum(r["leads"] for r in got) == leads


def test_near_distances_are_those_of_each_pair():
    rng, pairs = np.random.default_rng(5), [(np.zeros(0, np.uint32), np.arange(3, dtype=np.uint32)), (np.arange(align.NEAR_LENGTH + 9, dtype=np.uint32) + 1, np.arange(align.NEAR_LENGTH + 9, dtype=np.uint32)[::-1])]
    for k in range(300):
        a = rng.integers(0, (3, 50, 1 << 32)[k % 3], rng.integers(0, 200)).tolist()
        b = [*a]
        for _ in range(rng.integers(0, 45)):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = rng.integers(0, 50, rng.integers(0, 2)).tolist()
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32)))
    want = [align.edit_distance(a, b, align.NEAR) for a, b in pairs]
    assert [None if d > align.NEAR else d for d in align.near_distances(pairs) if d >= 0] == [w for k, w in enumerate(want) if k != 1]
    assert align.near_distances(pairs)[1] == -1 and 100 < sum(w is not None for w in want) < 302


def test_documents_are_numbered_in_order(spark, tmp_path):
    """Numbers rise with (doc_id, ver) across partitions; sorts and aggregates are of one number."""
    rows = [(d % 700 - 350, d % 3, str(d % 2100)) for d in range(4200)]
    texts = passages.numbered(spark.createDataFrame(rows, "doc_id long, ver int, text string").repartition(5), passages.Scratch(spark, "numbered"))
    got = [tuple(r) for r in texts.select("n", "doc_id", "ver").collect()]
    assert sorted(got) == [(n, *key) for n, key in enumerate(sorted({r[:2] for r in rows}))]
    assert passages.seeds(texts.select("n", "text")).count() == 0  # no text has a run of words


def test_passages(spark, docs, none):
    got = passages.repeats(spark, docs).collect()
    spans = {(r["doc_id"], r["source_doc_id"]): r for r in got}
    assert set(spans) == {(1, 0), (2, 0), (8, 7)}
    r = spans[8, 7]
    assert alnum(DOCS[8][1])[r["start"] : r["end"]] == alnum(PASSAGE) and r["identity"] == 1
    assert spans[1, 0]["n_words"] == len(alnum(BASE)) and 0.9 < spans[2, 0]["identity"] < 1
    kept = {(k["doc_id"], k["text"]) for k in passages.without_repeats(spark, docs).collect()}
    assert 1 not in {d for d, _ in kept} and (3, DOCS[3][1]) in kept and (4, None) in kept
    assert all(len(alnum(t)) < 10 for d, t in kept if d == 2)  # what lies outside the aligned stretch
    cut = next(t for d, t in kept if d == 8)
    assert alnum(cut) == alnum(DOCS[8][1].replace(PASSAGE, ""))
    odd = spark.createDataFrame([(None, PASSAGE), (None, f"x {PASSAGE}"), (-(1 << 63), f"y y {PASSAGE}"), (5, PASSAGE), (5, PASSAGE), (5, f"z {PASSAGE}")], "doc_id long, text string")
    found = collections.Counter((r["doc_id"], r["start"], r["source_doc_id"]) for r in passages.repeats(spark, odd).collect())
    assert {d for d, _, _ in found} == {None, -(1 << 63), 5} and {s for _, _, s in found} == {None} and sum(n for (d, _, _), n in found.items() if d is None) == 1
    n = len(alnum(PASSAGE))
    assert sorted(len(alnum(r["text"])) for r in passages.without_repeats(spark, odd).collect()) in ([1, 1, 2, n], [1, 2, n + 1])
    assert passages.repeats(spark, none).count() == 0 and passages.without_repeats(spark, none).columns == none.columns


def test_passages_around_own_words(spark):
    """Two passages that are repeats by themselves, whatever lies between; checked to the word."""
    fresh = random.Random(11)
    own = lambda n: " ".join(f"w{fresh.randrange(10**9)}" for _ in range(n))
    head, foot, long = own(60), own(60), [own(100) for _ in range(2)]
    docs = [(0, f"{head} {own(300)} {foot}")]
    docs += [(1 + k, f"{head} {own(n)} {foot}") for k, n in enumerate((40, 70, 100))]
    docs += [(10, f"{long[0]} {long[1]}")] + [(11 + k, f"{own(9)} {long[0]} {own(n)} {long[1]} {own(7)}") for k, n in enumerate((60, 130, 200))]
    got = collections.defaultdict(set)
    for r in passages.repeats(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[r["doc_id"]] |= set(range(r["start"], r["end"]))
        assert r["n_words"] >= 50 and r["identity"] >= 0.8 and r["source_doc_id"] == (0 if r["doc_id"] < 10 else 10)
    words_of = {d: t.split() for d, t in docs}
    for first, n in ((1, 40), (2, 70), (3, 100)):
        assert got[first] == set(range(60)) | set(range(60 + n, 120 + n)), first
    for first, n in ((11, 60), (12, 130), (13, 200)):
        assert got[first] == set(range(9, 109)) | set(range(109 + n, 209 + n)), first
    assert set(got) == {1, 2, 3, 11, 12, 13} and len(words_of[13]) == 416


def test_passages_of_lines_from_elsewhere(spark):
    """A passage whose lines occur singly before, and one with a changed word near each end."""
    fresh = random.Random(12)
    own = lambda n: " ".join(f"w{fresh.randrange(10**9)}" for _ in range(n))
    lines, near = [own(20) for _ in range(3)], own(54).split()
    changed = [*near]
    changed[5] = changed[48] = "changed"
    docs = [(5 + k, f"{own(50)} {line} {own(50)}") for k, line in enumerate(lines)]
    docs += [(d, f"{own(40)} {' '.join(lines)} {own(40)}") for d in (10, 20)]
    docs += [(30, f"{own(40)} {' '.join(near)} {own(40)}"), (40, f"{own(40)} {' '.join(changed)} {own(40)}")]
    got = {(r["doc_id"], r["source_doc_id"], r["start"], r["end"]) for r in passages.repeats(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(20, 10, 40, 100), (40, 30, 40, 94)}


# ---- 6


def hits(text: str | None, items: list[tuple]) -> tuple:
    w, hit, found = alnum(text), set(), set()
    for item, body in items:
        b = alnum(body)
        n = min(10, len(b))
        for window in {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == window:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, 1])
def test_decontamination(spark, docs, none, most, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    items = [(1, PASSAGE), (20, " ".join(BASE.split()[30:45])), (3, "rights reserved"), (4, None), (5, "..."), (6, prose(30)), (7, "漢字"), (3, "rights reserved"), (8, BASE.upper())]
    table = spark.createDataFrame(items, "item_id long, text string")
    narrow = docs.select("doc_id", "text")
    got = decontaminate.contamination(spark, narrow, table).drop("text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, *hits(t, items))) for d, t in DOCS)
    assert decontaminate.contamination(spark, none.select("doc_id", "text"), table).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(spark, narrow, table.filter("item_id < 0")).collect())
    wide = docs.withColumns({"__n_words": docs.score, "n_hit": docs.score, "contaminated": docs.source})
    again = decontaminate.contamination(spark, wide, table)
    assert sorted(map(repr, map(tuple, again.select(got[0].__fields__).collect()))) == sorted(map(repr, map(tuple, got)))
    kept = decontaminate.clean_documents(spark, wide, table)
    assert kept.columns == wide.columns and kept.count() == sum(not r["contaminated"] for r in got)


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, 1])
def test_partial_containment(spark, docs, most, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    w = BASE.split()[20:40]
    w[7] = "changed"
    table = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    whole = {r["doc_id"] for r in decontaminate.contamination(spark, docs.select("doc_id", "text"), table, width=20).collect() if r["contaminated"]}
    most = {r["doc_id"] for r in decontaminate.contamination(spark, docs.select("doc_id", "text"), table, width=20, containment=0.8).collect() if r["contaminated"]}
    assert whole == set() and {0, 1} <= most


# ---- 7


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.com/en/x?q#f", "https://www.example.com/en/", "http://example.com", "http://x.net/es/1", "http://net/fr/", "ftp://casino-win.org/a", "http://notexample.com/en/y", "http://e.net?x=/es/", "x://y://z/es/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, host string").repartition(2)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    known = [(f"http://{sub}{host}.com/", "block" if "casino" in host else "allow") for host in ("casino-royal", "online-casino", "royal-museum", "online-library") for sub in ("", "www.", "m.")]
    seeds = spark.createDataFrame(known, "url string, class string")
    got = {r["page_id"]: r for r in url_rules.filtered(spark, pages, labels, seeds=seeds).collect()}
    want = {0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.com", "/en/x", "example.com/en/", "block"), 4: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 5: ("example.com", "", None, "allow"),
            6: ("x.net", "/es/1", "net/es/", "block"), 7: ("net", "/fr/", "net/fr/", "block"), 8: ("casino-win.org", "/a", None, "block"), 9: ("notexample.com", "/en/y", "com/", "allow"), 10: ("e.net", "", None, "allow"), 11: ("y:", "//z/es/", None, "allow")}
    assert {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items() if k < 12} == want and len(got) == 13
    assert url_rules.filtered(spark, pages.limit(0), labels, seeds=seeds).count() == 0
    bare = url_rules.filtered(spark, pages, labels).filter("page_id = 8").first()
    assert (bare["verdict"], bare["mined_rule"]) == ("allow", None)


def test_rules_are_mined_from_labels(spark):
    rows_ = [(i, f"http://{'evil-shop' if i % 2 else 'nice-shop'}.org/en/{i}") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(150)], "doc_id long, quality int, toxic int")
    got = url_rules.filtered(spark, spark.createDataFrame(rows_, "page_id long, url string"), labels).collect()
    assert all((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got)


def test_a_host_of_few_labelled_pages_is_mined_among_many(spark):
    from pyspark.sql import functions as F

    bad = F.col("id") % 240 == 7
    pages = spark.range(24000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), F.when(bad, "evil-shop").otherwise(F.concat(F.lit("shop"), F.col("id") % 240)), F.lit(".org/en/"), "id").alias("url"))
    labels = spark.range(24000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (bad | (F.floor(F.col("id") / 240) % 5 == 0)).cast("int").alias("toxic"))
    got = url_rules.filtered(spark, pages, labels).groupBy("host", "verdict").count().filter("verdict = 'block'").collect()
    assert [tuple(r) for r in got] == [("evil-shop.org", "block", 100)]


def test_rules_equal_all_sets_and_shared_tokens_do_no_harm(spark, monkeypatch):
    """Mined rules against counts of all sets of up to three tokens; then URLs that share 22 words."""
    from weftline.llm.scratch import Scratch

    some = random.Random(8)
    baskets = [({t for t in "abcdef" if some.random() < 0.5}, some.random()) for _ in range(400)]
    baskets = [(sorted(t), "block" if {"a", "b"} <= t or {"c", "d", "e"} <= t or x < 0.05 else "allow") for t, x in baskets]
    got = {tuple(r["tokens"]) for r in url_rules.mined(spark.createDataFrame(baskets, "tokens array<string>, class string"), Scratch(spark, "test"), "t", 20, False).collect()}
    want: set[tuple] = set()
    for size in (1, 2, 3):
        for one in itertools.combinations("abcdef", size):
            classes = [c for t, c in baskets if set(one) <= set(t)]
            bad = classes.count("block")
            if bad >= 20 and bad >= 0.9 * len(classes) and not any(set(w) <= set(one) for w in want):
                want.add(one)
    assert got == want and ("a", "b") in want
    shared = "/".join(f"word{chr(97 + k)}" for k in range(22))
    pages = spark.createDataFrame([(i, f"http://{'evil-shop' if i % 2 else 'nice-shop'}.org/en/{i}/{shared}") for i in range(60)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(url_rules, "MIN_COUNT", 10)
    assert url_rules.filtered(spark, pages, labels).count() == 60


# ---- 8


def test_licenses(spark, docs, none):
    got = sorted((r for r in license_scan.scan(spark, docs).collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(DOCS) and by[4]["n_words"] == 0 and by[4]["labels"] == "" and by[4]["score"] == 0
    r = by[12]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == (3, 0, 10, "cc-by,reserved", "cc-by,cc-by-nc-4.0,reserved") and r["score"] == 1
    assert by[16]["labels"] == "mit" and by[16]["base_labels"] == "" and by[16]["first_word"] is None
    assert license_scan.scan(spark, none).count() == 0


def test_automata():
    a = license_scan.Automaton("x", "copyright [[c]] {{year:1-2}} held by {{who:1-3}} end")
    run = lambda t: a.run(words(pa.array([t]), ALNUM_LOWER).hash.tolist())
    assert run("Copyright (c) 2020 held by A B end")[0] and run("copyright 2020 2021 held by a end")[0]
    assert not run("copyright held by a end")[0] and not run("copyright 2020 held by a b c d end")[0] and 0 < run("copyright 2020 held")[1] < 1


# ---- 9


def test_class_bigrams(spark, docs, none):
    got = class_lm.scored(spark, docs).collect()
    lower = lambda t: [w.lower() for w in spaced(t)] + [None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = collections.Counter(w for d, t in DOCS if not held(d) for w in lower(t))
    n, v = sum(count.values()), len(count)
    want = sorted((repr(d), held(d), len(lower(t)), sum(count[w] > 0 for w in lower(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in lower(t)), 4)) for d, t in DOCS)
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got) and class_lm.scored(spark, none).count() == 0


def test_class_bigrams_are_the_same_however_texts_are_dealt(spark, docs):
    one, many = (sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["score"]) for r in class_lm.scored(spark, docs.repartition(n)).collect()) for n in (1, 7))
    assert [r[:3] for r in one] == [r[:3] for r in many] and np.allclose([r[3] for r in one], [r[3] for r in many], atol=1e-6)


def test_most_frequent_words_beyond_the_first_of_each_block(spark, monkeypatch):
    """Words that are nowhere among a block's first, but frequent over all blocks."""
    monkeypatch.setattr(class_lm, "BLOCK_TOP", 4)
    texts = [" ".join(f"own{d}x{k} " * (9 - k) for k in range(6)) + " all some " * 3 + f"few{d % 2} " * 2 for d in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held_out", F.lit(False)).repartition(12)
    count = collections.Counter(w for t in texts for w in t.split())
    for most in (2, 3, 5, 1000):
        w = words(pa.array([" ".join(count)]), SPACE_LOWER)
        want = sorted(zip((-count[x] for x in count), w.hash.view(np.int64).tolist(), strict=True))[:most]
        assert class_lm.frequent_words(class_lm.blocks(docs).cache(), most) == [h for _, h in want]


def test_exchange_finds_classes():
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, 3, 30)
    kinds[-1] = 3
    pairs = np.zeros((30, 30))
    for a in range(29):
        for b in range(29):
            if kinds[b] == (kinds[a] + 1) % 3:
                pairs[a, b] = rng.integers(5, 20)
    of = class_lm.exchanged(pairs, classes=4)
    assert len({(k, c) for k, c in zip(kinds.tolist(), of.tolist(), strict=True)}) == 4


# ---- 10


def test_near_duplicates(spark, docs, none):
    got = near_dedup.near_duplicates(spark, docs).collect()
    classes = collections.defaultdict(set)
    for r in got:
        classes[r["class_id"]].add(r["doc_id"])
    assert len(got) == len(DOCS) and classes[0] == {0, 1, 2} and all(len(c) == 1 for k, c in classes.items() if k not in (0, 3))
    assert sum(r["keep"] for r in got if r["class_id"] == 0) == 1
    kept = near_dedup.deduplicated(spark, docs)
    assert kept.columns == docs.columns and kept.filter("doc_id IN (0, 1, 2)").count() == 1 and kept.filter("doc_id = 14").count() == 2
    assert near_dedup.near_duplicates(spark, none).count() == 0


@pytest.mark.parametrize("tile", [8, 2048])
def test_near_duplicates_in_a_bucket_of_many_unlike_texts(spark, monkeypatch, tile):
    """A passage of all texts fills buckets; like texts that meet there only are found, whatever the bucket's least text is."""
    monkeypatch.setattr(near_dedup, "TILE", tile, raising=False)
    rng = random.Random(8)
    common, texts = [f"c{k}" for k in range(40)], []
    for f in range(30):
        own = [f"w{rng.randrange(10**6)}" for _ in range(30)]
        texts += [common + own, common + [x if k % 3 else f"v{f}x{k}" for k, x in enumerate(own)]]
    w = words(pa.array([" ".join(t) for t in texts]), ALNUM_LOWER)
    keys = near_dedup.order_sketches(*near_dedup.labelled_runs(w))
    of = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = (w.hash[w.first[k] : w.first[k + 1]] for k in (i, j))
        if (keys[i] == keys[j]).any() and align.edit_distance(a, b, int(0.2 * max(len(a), len(b)) + 1e-9)) is not None:
            of = [of[i] if c == of[j] else c for c in of]
    assert len(set(of)) < 40  # most pairs of like texts share a bucket
    got = near_dedup.near_duplicates(spark, spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(of))


def test_banded_distance_equals_the_table(monkeypatch):
    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for step in range(400):
        monkeypatch.setattr(align, "TABLE_BITS", (1 << 27) * (step % 2))
        a, b = ([random.randint(0, 4) for _ in range(random.randint(0, 18))] for _ in range(2))
        k, d = random.randint(0, 9), table(a, b)
        assert align.edit_distance(np.array(a, int), np.array(b, int), k) == (d if d <= k else None)


def test_queries_equal_sql(spark, sf_dir):
    con = duck(sf_dir)
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, sf_dir), con.execute(sql)
        assert rows(got.columns, map(tuple, got.collect())) == rows([c[0] for c in want.description], want.fetchall())
