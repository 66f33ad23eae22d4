"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is scanned once, from left to right, into flat blocks of text (what
stands between two block-level tags).  A block is described by its number of
words, its link density, what its element and the elements around it say
(main content, page furniture, or nothing), whether it is a heading, a list
item or ends a sentence, and by words, link density and place of the block
before and after it.  A decision tree, grown from the small labelled table
below, says for each block whether it belongs to the article.

The scan is linear in the page: tags, comments and raw text are found by
patterns without backtracking and by searches that give up for good once they
fail.  Pages are independent, so the plan is one map without a shuffle, and a
worker holds one page and its blocks.

Results for odd input: null html is an empty page; a page without main text
gives ''; rows that repeat a page_id are read alike; an unclosed comment,
script or tag runs to the end of the page; null ids and urls are returned as
they are; other columns are not read.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, ship

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp")
NO_TEXT = frozenset("head template object svg canvas audio video select option button datalist applet map".split())
FURNITURE = frozenset("nav aside footer dialog menu form".split())
SCOPES = frozenset("td th caption table button object template html".split())
#: What the start of an element closes: itself, up to the element that holds both.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tr": (frozenset(["tr"]), frozenset("table tbody thead tfoot".split())),
}
#: Words in class, id and role that speak for page furniture (as a whole, or as the head of a word), and for the article.
FURNITURE_WORDS = frozenset("ad ads adv adsense nav menu menus navbar toolbar tabs tab header footer foot masthead topbar sidebar sidebars side rail aside banner cookie cookies consent gdpr privacy notice notices alert alerts popup modal overlay toast login signin signup search searchbox related recommended recommendations trending popular social share sharing shares follow tags widget widgets pagination pager copyright legal disclaimer skip form complementary contentinfo navigation breadcrumb teaser teasers outbrain taboola disqus livefyre reply replies respond".split())
FURNITURE_HEADS = ("advert", "sponsor", "promo", "cookie", "newsletter", "subscri", "comment", "breadcrumb", "sidebar", "footer", "navig", "doubleclick", "dfp")
MAIN_WORDS = frozenset("article articlebody post entry story content main body text maincontent postbody entrycontent storybody".split())
#: With one of these a name tells how the page is laid out, not what the element holds.
LAYOUT_WORDS = frozenset("with has no without layout".split())
#: Around both the article and furniture, if a name speaks for both.
AROUND_WORDS = frozenset("wrap wrapper container grid row page".split())
#: Elements of these names are not the article even where they are marked as one.
NEVER = ("comment", "reply", "replies", "respond", "related", "recommended", "teaser", "teasers", "trending", "popular", "sponsor", "advert", "promo", "ad", "ads")

_ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+"""
_TAG = re.compile(rf"<(/?)([A-Za-z][^\s/>]*+)({_ATTRIBUTES})>", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: Scripts without spaces between words: two characters count as a word.
_DENSE = re.compile("[぀-ヿ㐀-䶿一-鿿฀-๿]")
_SENTENCE = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*$")

OPEN, MAIN, OTHER = 0, 1, -1


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    place: int
    heading: int
    item: int

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0

    @property
    def ends(self) -> int:
        return int(_SENTENCE.search(self.text[-8:]) is not None)


@lru_cache(maxsize=20_000)
def _said(attributes: str) -> tuple[int, bool, bool]:
    """What an element's attributes say: (place, furniture for good, hidden)."""
    place, for_good, hidden, named = OPEN, False, False, []
    for m in _ATTRIBUTE.finditer(attributes):
        before = attributes[m.start() - 1 : m.start()]
        if before and not before.isspace() and before not in "\"'/":
            continue  # the end of another name, as data-id
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            hidden = True
        elif name in ("class", "id", "role"):
            named += value.split()
        elif name == "itemprop" and value.lower() == "articlebody":
            place = MAIN
    for one in named:
        said = [w.lower() for w in _WORDS.findall(one)]
        if LAYOUT_WORDS.intersection(said):
            continue
        furniture = [w for w in said if w in FURNITURE_WORDS or w.startswith(FURNITURE_HEADS)]
        if MAIN_WORDS.intersection(said) and (furniture == ["header"] or (furniture and AROUND_WORDS.intersection(said))):
            continue  # the header of the article, or around both
        if furniture:
            place = OTHER
            for_good = for_good or any(w.startswith(("comment", "sponsor", "advert", "promo")) or w in NEVER for w in furniture)
        elif place == OPEN and MAIN_WORDS.intersection(said):
            place = MAIN
    return place, for_good, hidden


class _Element(NamedTuple):
    tag: str
    place: int
    for_good: bool
    silent: bool


def _entered(tag: str, attributes: str, up: _Element) -> _Element:
    place, for_good, hidden = _said(attributes) if len(attributes) > 3 and tag not in ("html", "body") else (OPEN, False, False)
    silent = up.silent or hidden or tag in NO_TEXT
    if up.place == OTHER and up.for_good:
        return _Element(tag, OTHER, True, silent)
    if tag in FURNITURE:
        return _Element(tag, OTHER, tag != "form", silent)
    if place == OTHER and (for_good or tag not in ("article", "main")):
        return _Element(tag, OTHER, for_good, silent)
    if tag in ("article", "main") or (place == MAIN and up.place != OTHER):
        return _Element(tag, MAIN, False, silent)
    if tag == "header" and up.place != MAIN:
        return _Element(tag, OTHER, False, silent)
    return _Element(tag, up.place, up.for_good, silent)


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order; empty ones are left out."""
    out: list[Block] = []
    stack = [_Element("", OPEN, False, False)]
    count: dict[str, int] = {}
    parts: list[str] = []  # of the block at hand
    linked: list[str] = []
    heading = item = 0
    place = OPEN
    size, at = len(page), 0

    def end_block():
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, n_words(text), min(n_words(text), n_words("".join(linked))), place, heading, item))
        parts.clear()
        linked.clear()

    def add(text: str):
        nonlocal place, heading, item
        top = stack[-1]
        if top.silent or not text:
            return
        if not parts or text.isspace() is False:
            if not any(not p.isspace() for p in parts):
                place, item = top.place, int(count.get("li", 0) > 0)
                heading = int(any(count.get(h, 0) for h in ("h1", "h2", "h3", "h4", "h5", "h6")))
        text = html.unescape(text)
        parts.append(text)
        if count.get("a", 0) > 0:
            linked.append(text)

    def pop_to(k: int):
        while len(stack) > k:
            count[stack.pop().tag] -= 1

    def close(tag: str):
        k = len(stack) - 1
        while stack[k].tag != tag:
            k -= 1
        pop_to(k)

    def close_sibling(tag: str):
        own, holder = CLOSES[tag]
        for k in range(len(stack) - 1, max(0, len(stack) - 50), -1):
            if stack[k].tag in own:
                return pop_to(k)
            if stack[k].tag in holder:
                return None
        return None

    def close_paragraph():
        for k in range(len(stack) - 1, max(0, len(stack) - 50), -1):
            if stack[k].tag == "p":
                return pop_to(k)
            if stack[k].tag in SCOPES:
                return None
        return None

    while at < size:
        less = page.find("<", at)
        if less < 0:
            add(page[at:])
            break
        if less > at:
            add(page[at:less])
        after = page[less + 1 : less + 2]
        if after in ("!", "?") or (after == "/" and not page[less + 2 : less + 3].isalpha()):
            if page.startswith("<!--", less):
                stop = less + 5 if page.startswith("<!-->", less) else page.find("-->", less + 4) + 3
                stop = stop if stop > 2 else 0
            else:
                stop = page.find(">", less) + 1
            if not stop:
                break
            at = stop
            continue
        if not (after == "/" or (after.isascii() and after.isalpha())):
            add("<")
            at = less + 1
            continue
        m = _TAG.match(page, less)
        if not m:
            break
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                end_block()
            if tag == "br":
                add(" ")
            elif count.get(tag, 0) > 0:
                close(tag)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            end_block()
            if count.get("p", 0) > 0:
                close_paragraph()
            if tag in CLOSES:
                close_sibling(tag)
        elif tag == "a" and count.get("a", 0) > 0:
            close("a")
        if tag in RAW:
            found = _END[tag].search(page, at)
            if not found:
                break
            at = page.find(">", found.end()) + 1
            if not at:
                break
            continue
        if tag in VOID:
            continue
        count[tag] = count.get(tag, 0) + 1
        stack.append(_entered(tag, m[3], stack[-1]))
    end_block()
    return out


def n_words(text: str) -> int:
    n = len(text.split())
    if not text.isascii():
        n += len(_DENSE.findall(text)) // 2
    return n


# ---------------------------------------------------------------- the tree

FEATURES = ("words", "density", "place", "heading", "item", "ends", "words_before", "density_before", "place_before", "words_after", "density_after", "place_after")

#: The labelled table: a line is a page, an entry a block.  + or - is the label (part of the article or not); m, o or f the place (main,
#: open, furniture); p, h or i the kind (paragraph, heading, item); then words, linked words, and a full stop if a sentence ends there.
LABELLED = """
-fi1/1 -fi1/1 -fi2/2 -fi1/1 -fp9/0. +mh7/0 +mp60/0. +mp4/0. +mp120/2. +mp1/0. +mp15/15 +mp33/0. -fp12/0. -fp3/3
-fi2/2 -fi1/1 -fp6/0 +mh3/0 +mp2/0 +mh2/0 +mi5/0 +mi9/1. +mi1/1 +mi3/0 +mp25/0 -fp14/4. -fi2/2 -fi3/3
-op2/2 -op1/1 -op3/3 +oh6/0 +op40/0. +op75/3. +op5/0. +op52/0. -op2/2 -op4/4 -op3/0
-oi1/1 -oi2/2 -oi1/1 -oi3/3 +oh8/0 +op30/0. +oi12/0. +oi15/2. +op28/0. -oh2/0 -oi6/6 -oi7/7 -oi5/5 -op5/0. -op3/3
-fp30/0. -fp2/2 +op90/0. +op8/0. +op64/5. -fp45/0. -fp20/0. -fh2/0 -fp25/0.
+mh4/0 +mp12/0. -fp22/0. +mp80/4. -fp3/0 +mp6/0 +mp50/0. -fh1/0 -fp18/0. -fp60/1. -fp2/2
-fp1/1 -fh3/0 -fp8/0. +mp10/0. -fp4/0 -fp7/7
+mp3/0. -fp6/0.
-fi3/3 +mp1/1 +mp16/8. +mh2/2 +mp200/6. -fp55/2. -fi4/4 -fi2/2
-op4/2 -op2/0 -op3/1 +op110/0. +op22/0. +oh4/0 +op35/1. +op17/0. -op6/3 -op8/8
+oh5/0 +op26/0. +op3/0. +op44/0.
+op18/0.
-oi2/2 -oi2/2 -op7/7 -oi1/1 -op5/5
-op3/0 -op2/1 -op4/4
"""


def described(found: list[Block]) -> list[tuple[float, ...]]:
    """The features of each block; before the first and after the last are empty open blocks."""
    edge = (0, 0.0, OPEN)
    around = [edge, *((b.words, b.density, b.place) for b in found), edge]
    return [(b.words, b.density, b.place, b.heading, b.item, b.ends, *around[k], *around[k + 2]) for k, b in enumerate(found)]


def labelled_table(text: str = LABELLED) -> tuple[list[tuple[float, ...]], list[int]]:
    rows, labels = [], []
    for line in text.split("\n"):
        page = []
        for entry in line.split():
            label, place, kind, words, linked, stop = re.fullmatch(r"([+-])([mof])([phi])(\d+)/(\d+)(\.?)", entry).groups()
            page.append(Block("x" + stop, int(words), int(linked), {"m": MAIN, "o": OPEN, "f": OTHER}[place], int(kind == "h"), int(kind == "i")))
            labels.append(int(label == "+"))
        rows += described(page)
    return rows, labels


def grow(rows: list[tuple[float, ...]], labels: list[int], depth: int = 10):
    """A tree by Gini impurity: a share of label 1, or (feature, cut, tree up to the cut, tree above it)."""
    share = sum(labels) / len(labels)
    if depth == 0 or share in (0, 1):
        return share
    best = None
    for f in range(len(rows[0])):
        order = sorted(range(len(rows)), key=lambda k: rows[k][f])  # noqa: B023
        ones = 0
        for i, k in enumerate(order[:-1], 1):
            ones += labels[k]
            low, high = rows[k][f], rows[order[i]][f]
            if low == high:
                continue
            rest, n = sum(labels) - ones, len(rows) - i
            impurity = ones * (i - ones) / i + rest * (n - rest) / n
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, (low + high) / 2)
    if best is None:
        return share
    _, f, cut = best
    sides = [[k for k in range(len(rows)) if (rows[k][f] > cut) == above] for above in (False, True)]
    return (f, cut, *(grow([rows[k] for k in s], [labels[k] for k in s], depth - 1) for s in sides))


def chance(tree, row: tuple[float, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree


def main_text(page: str, tree) -> tuple[str, int]:
    """(main text, number of blocks)."""
    found = blocks(page)
    kept = [b.text for b, row in zip(found, described(found), strict=True) if chance(tree, row) >= 0.5]
    return "\n\n".join(kept), len(found)


def _kernel(tree, kind):
    def run(batches):
        for b in batches:
            pages = b.column(2)
            lo = 0
            texts, counts, size = [], [], 0
            for k in range(b.num_rows):
                text, n = main_text(pages[k].as_py() or "", tree)
                texts.append(text)
                counts.append(n)
                size += len(text)
                if size > 4 << 20 or k == b.num_rows - 1:
                    part = b.slice(lo, k + 1 - lo)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int32())], kind)
                    texts, counts, size, lo = [], [], 0, k + 1

    return run


def extract(pages: DataFrame, *, labelled: str = LABELLED, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and n_blocks of every page."""
    ship(pages.sparkSession)
    tree = grow(*labelled_table(labelled))
    names = ["page_id", "url", "text", "n_chars", "n_blocks"]
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return base.mapInArrow(over_batches(_kernel(tree, names)), "page_id long, url string, text string, n_chars long, n_blocks int")
