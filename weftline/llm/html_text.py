"""Operator 1: the main text of web pages.

A page is cut into flat text blocks at block-level tags. Each block is described by its words, the
share of them in links, the same of the blocks before and after it, and where it stands (kinds of
elements around it, words in their class and id). A decision tree (CART, Gini), trained on the small
labelled table ``PAGES`` below, tells content from the rest.

Character references are decoded, white space within a block becomes one space, blocks are joined by
one line feed. Comments, declarations and the contents of elements that never show prose (scripts,
styles, templates, controls) are no blocks. Markup may be broken: unclosed elements end with the
page, stray end tags are ignored, a `<` that starts no tag is text. Null html, like html without
content blocks, gives the empty string. Rows that repeat a page_id are rows of their own; columns
beyond the three named are not read.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The rest of a tag, with quoted values that may hold a `>`.
_QUOTED = re.compile(r"""(?>[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+)>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")

#: Their text, up to the end tag, is no prose.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas button select option textarea title audio video map datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img label".split())
#: Elements that hold what is not the article, and those that hold it.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
#: Words in class, id and role that say so.
ASIDE_WORDS = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|banner\w*|breadcrumbs?|comments?\w*|complementary|consent|contentinfo|cookies?|copyright|disclaimer|disqus|footer|gdpr|header|login|masthead|menus?|modal|nav\w*|newsletter|notices?|pag(?:er|ination)|popup|promo\w*|recommend\w*|related\w*|replies|reply|respond|search\w*|share|sharing|sidebar\w*|signup|skip|social\w*|sponsor\w*|subscribe\w*|toolbar|topbar|widgets?)(?![a-z])")
MAIN_WORDS = re.compile(r"(?:^|[^a-z])(?:article\w*|body|content|entry\w*|main|post\w*|prose|story\w*|text)(?![a-z])")

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "aside_tag", "aside_word", "main_tag", "main_word", "heading", "item", "sentence"]

#: The labelled table: pages as blocks, "where element words/linked words", times n; + marks content.
#: Where: page, main (article or main), mainword (content by class), the kinds of aside: nav, header,
#: footer, form (by tag), ad, side, comment, notice (by class), and inmain.x for such within main.
PAGES = """
nav li 1/1 x6; ad div 9/0; main h1 9/0 +; main p 14/0 +; main p 80/0 x6 +; footer div 12/0
nav li 1/1 x5; ad div 22/0; main h1 4/0 +; main p 1/0 x2 +; main p 30/2 x3 +; main p 160/0 +; footer div 18/0
nav li 2/2 x4; main h1 6/0 +; main p 5/0 +; main p 2/0 +; main p 45/1 x4 +; comment p 25/0 x3; footer p 9/4
header div 3/1; nav li 1/1 x8; main h1 8/0 +; main p 60/3 x5 +; side li 4/4 x5; footer p 15/2
header h1 3/0; nav li 1/1 x4; mainword h1 7/0 +; mainword p 70/2 x4 +; mainword p 8/0 +; side p 20/3 x2; comment p 40/0 x4; footer p 6/0
notice p 24/2; nav li 2/2 x6; mainword h2 5/0 +; mainword p 90/0 x3 +; mainword p 3/0 +; form p 8/0; footer li 2/2 x5
page li 1/1 x7; page h1 7/0 +; page p 55/1 x5 +; page p 12/0 x2 +; page p 7/3
page li 2/2 x5; page p 35/0 x6 +; page div 5/2; page li 3/3 x4
page div 3/3; page div 2/2; page h1 9/0 +; page div 120/4 x3 +; page div 4/4 x3; page div 7/1
notice div 30/1; header div 6/4; main h1 5/0 +; main li 12/0 x5 +; main p 40/5 x2 +; inmain.ad div 10/1; main p 66/0 +; footer div 20/6
nav li 1/1 x3; main h2 4/0 +; main p 33/0 x2 +; inmain.side p 28/2; main p 51/0 x2 +; inmain.comment p 60/0 x3; footer p 11/1
header p 12/0; ad p 45/1; main p 25/0 x8 +; comment h3 2/0; comment p 70/0 x2; comment p 9/0 x4; form div 5/0; footer div 30/10
header h2 5/1; page p 65/0 x4 +; comment p 33/0 x5; side p 40/0 x2; notice p 50/3; footer p 44/0
form p 20/0; main h1 3/0 +; main td 5/0 x6 +; main p 22/0 x3 +; inmain.form p 14/0; inmain.footer p 10/5; side li 6/6 x3
nav p 25/5; main h1 6/0 +; main p 18/9 +; main p 12/12 +; main p 80/8 x2 +; inmain.nav li 3/3 x4; footer p 60/2
ad div 60/2; mainword p 2/0 x3 +; mainword p 48/0 x3 +; inmain.ad p 15/0; mainword li 9/2 x4 +; side h3 2/0; side p 16/8
inmain.notice p 35/0; main p 20/0 +; main h2 3/0 x2 +; main p 100/0 x3 +; inmain.header h1 7/0 +; inmain.comment p 4/0 x3
header li 1/1 x5; header div 15/0; page h1 6/0 +; page p 40/0 x3 +; page h2 4/0 +; page p 75/2 x3 +; footer li 2/2 x6; footer p 8/0
"""


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, whether it closes, name in lower case, attributes) of each tag; comments and declarations have no name.

    Goes forward only: send an offset to go on from there. Work is in proportion to the page: past the last `>`
    nothing is a tag, and once quotes that never close have been followed to the end ``4`` times, a tag ends at its first `>`.
    """
    last, at, patience = page.rfind(">"), 0, 4
    while True:
        at = page.find("<", at)
        if at < 0:
            return
        if page.startswith(("<!", "<?"), at):
            mark = "-->" if page.startswith("<!--", at) else ">"
            end = page.find(mark, at + len(mark) + 1 if mark == "-->" else at)
            end = end + len(mark) if end >= 0 else len(page)
            at = (yield at, end, False, "", "") or end
            continue
        if at > last:
            at += 1
            continue
        closing = page.startswith("/", at + 1)
        name = _NAME.match(page, at + 1 + closing)
        if not name:
            at += 1
            continue
        whole = _QUOTED.match(page, name.end()) if patience else None
        if whole:
            end = whole.end()
        else:
            patience -= patience > 0
            end = page.find(">", name.end()) + 1
            if not end:
                at += 1
                continue
        at = (yield at, end, closing, name[0].lower(), page[name.end() : end - 1]) or end


class Blocks(list):
    """(text, words, linked words, aside_tag, aside_word, main_tag, main_word, heading, item)."""


#: Class names that tell of the page around, not of the element: "has-sidebar", "layout-with-header".
_ABOUT = re.compile(r"(?:^|[-_])(?:has|no|with|without|is|wide)[-_]")


def _flags(tag: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    if tag in ("html", "body"):
        return False, False, False, False
    found = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower().split() if "=" in attributes else []
    aside = any(ASIDE_WORDS.search(name) and not _ABOUT.search(name) for name in found)
    if tag in MAIN_TAGS:  # an article may be a reader's comment, but no other aside
        aside = any(name.startswith(("comment", "reply")) for name in found)
    return tag in ASIDE_TAGS, aside, tag in MAIN_TAGS, any(map(MAIN_WORDS.search, found))


def blocks(page: str) -> Blocks:
    """The flat text blocks of a page, in order."""
    out, stack = Blocks(), []  # stack: (tag, flags of it and all around it)
    none = (0, 0, 0, 0)
    parts: list[tuple[str, bool]] = []
    leaf, in_link, hidden, at = "", 0, 0, 0

    def flush() -> None:
        if not parts:
            return
        text = _SPACE.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
        if text:
            linked = sum(len(p.split()) for p, link in parts if link)
            words = text.count(" ") + 1
            flags = stack[-1][1] if stack else none
            out.append((text, words, min(words, linked), *flags, len(leaf) == 2 and leaf[0] == "h" and leaf[1].isdigit(), leaf in ("li", "dt", "dd", "td", "th", "option")))
        parts.clear()

    opened: dict[str, int] = {}  # how many of each tag are on the stack
    found, move = tags(page), None
    while True:
        try:
            begin, end, closing, tag, attributes = found.send(move)
        except StopIteration:
            begin = end = len(page)
            tag = None
        move = None
        if begin > at and not hidden:
            parts.append((page[at:begin], in_link > 0))
        if tag is None:
            break
        at = end
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                parts.append((" ", False))
            continue
        if not hidden:
            flush()
        leaf = tag if not closing else ""
        if tag in VOID:
            continue
        if closing:
            while opened.get(tag):
                one, _ = stack.pop()
                opened[one] -= 1
                hidden -= one in HIDDEN
                in_link = 0
                if one == tag:
                    break
        elif tag in RAW:
            raw_end = re.compile(f"</{tag}", re.I).search(page, at)
            at = move = raw_end.start() if raw_end else len(page)
            stack.append((tag, none))
            opened[tag] = opened.get(tag, 0) + 1
            hidden += 1
        elif tag not in ("p", "li", "dt", "dd", "tr", "td", "th") or "=" in attributes:
            if tag == "body":
                hidden, stack, opened = 0, [], {}
            around = stack[-1][1] if stack else none
            own = _flags(tag, attributes)
            if tag == "header" and around[2]:  # of the article itself
                own = (False, *own[1:])
            stack.append((tag, tuple(max(a, b) for a, b in zip(around, own, strict=True))))
            opened[tag] = opened.get(tag, 0) + 1
            hidden += tag in HIDDEN
    flush()
    return out


def described(rows: list[tuple]) -> np.ndarray:
    """(blocks, FEATURES) of the blocks of one page."""
    n = len(rows)
    words = np.array([r[1] for r in rows], float)
    links = np.array([r[2] for r in rows], float) / np.maximum(words, 1)
    none = np.zeros(1)
    place = np.array([r[3:9] for r in rows], float).reshape(n, 6)
    sentence = np.array([r[0][-1:] in tuple('.!?…"”»)') for r in rows], float)
    return np.column_stack([words, links, np.concatenate([none, words[:-1]]), np.concatenate([none, links[:-1]]), np.concatenate([words[1:], none]), np.concatenate([links[1:], none]), place, sentence])


_WHERE = {"page": (0, 0, 0, 0), "main": (0, 0, 1, 0), "mainword": (0, 0, 0, 1), **dict.fromkeys(("nav", "header", "footer", "form"), (1, 0, 0, 0)), **dict.fromkeys(("ad", "side", "comment", "notice"), (0, 1, 0, 0))}


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of ``PAGES``."""
    xs, ys = [], []
    for line in PAGES.strip().splitlines():
        rows, labels = [], []
        for entry in line.split(";"):
            where, tag, count, *rest = entry.split()
            words, links = map(int, count.split("/"))
            label, times = "+" in rest, next((int(r[1:]) for r in rest if r[0] == "x"), 1)
            inside, _, kind = where.rpartition(".")
            flags = _WHERE[kind]
            if inside:
                flags = tuple(max(a, b) for a, b in zip(flags, _WHERE["main"], strict=True))
            if where == "inmain.header" and label:
                flags = _WHERE["main"]
            text = "word." if words > 5 and tag not in ("li", "td", "h1", "h2", "h3") else "word"
            for _ in range(times):
                rows.append((text, words, links, *flags, tag[0] == "h" and tag[1:].isdigit(), tag in ("li", "td")))
                labels.append(label)
        xs.append(described(rows))
        ys += labels
    return np.concatenate(xs), np.array(ys)


class Tree:
    """CART with the Gini index; ties go to the first feature and the lowest cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 7, leaf: int = 2):
        self.nodes: list[tuple] = []  # (feature, cut, left, right) or (None, label)
        self._grow(x, y, depth, leaf)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, leaf: int) -> int:
        me = len(self.nodes)
        self.nodes.append((None, bool(y.mean() >= 0.5)))
        best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, None, None)
        for f in range(x.shape[1]) if depth and 0 < y.mean() < 1 else ():
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            left = np.flatnonzero(v[1:] > v[:-1]) + 1
            left = left[(left >= leaf) & (len(y) - left >= leaf)]
            if not len(left):
                continue
            a, b = ones[left - 1], ones[-1] - ones[left - 1]
            gini = 2 * a * (left - a) / left + 2 * b * (len(y) - left - b) / (len(y) - left)
            k = int(np.argmin(gini))
            if gini[k] < best[0]:
                best = (gini[k] - 1e-9, f, (v[left[k] - 1] + v[left[k]]) / 2)
        if best[1] is not None:
            low = x[:, best[1]] <= best[2]
            self.nodes[me] = (best[1], best[2], self._grow(x[low], y[low], depth - 1, leaf), self._grow(x[~low], y[~low], depth - 1, leaf))
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.nodes[node][0] is None:
                out[rows] = self.nodes[node][1]
                continue
            f, cut, left, right = self.nodes[node]
            low = x[rows, f] <= cut
            todo += [(left, rows[low]), (right, rows[~low])]
        return out


@functools.cache
def trained_tree() -> Tree:
    return Tree(*labelled_table())


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    keep = trained_tree().predict(described(found))
    return "\n".join(b[0] for b, k in zip(found, keep.tolist(), strict=True) if k)


def extracted(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
