"""Raw sources into entries: page lines, code repair, entry assembly, XML appendices, JSON trees.

Line parsers are plans: entries are groups of lines between boundaries, found
by running counts.  A page's own count is a window over the page; what pages
before it hold is a window over pages, so no task sorts the lines of a book.
"""

from __future__ import annotations

import json
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.text import CODE_GRAMMAR, collapse, completeness
from siftlake.shipping import ship_active

# What lines of the two lists look like.
RULE = r"^_+$"
FOOTER = r"^(?:-\s*\d{1,3}\s*-\s*\d{2}-\d{2}-\d{4}|\d{2}-\d{2}-\d{4}\s*-\s*\d{1,3}\s*-|WA-LIST\b.*)\s*$"
SECTION_HEADER = r"^(?:DUAL-USE LIST|MUNITIONS LIST|DEFINITIONS(?:\s|$)|Acronyms and Abbreviations|Statements of Understanding|Sensitive List|Very Sensitive List|TABLE OF CONTENTS|PUBLIC DOCUMENTS|TABLE\s*-\s*DEPOSITION TECHNIQUES)"
FOOTNOTE = r"^\*(\s|$)"
ANNEX = r"^ANNEX(\s|$)"
FOOTNOTE_MARKER = r"(?<=[.\w])\*\s*$"
ENTRY = r"^(\d)\s*\.\s+([A-E])\s*\.\s+(?:(\d+)\s*\.\s+)?(?:([a-z])\s*\.\s+)?(?:(\d+)\s*\.\s+)?(?:([a-z])\s*\.\s+)?(?:(\d+)\s*\.\s+)?(\S.*)$"
LIST_ENTRY = r"^(\d)([A-Z])(\d{3})([a-z]?)\.?\s+(.+)$"
LIST_HEADER = r"(?i)^(?:Appendix\s*3\s*[–—-]\s*SCOMET List|APPENDIX-3)\s*$"
LIST_HEADING = r"^\d[A-Z]\d\s+[A-Z(\"']"
LIST_ANNEX = r"(?i)^ANNEXURE\s*[–—-]"
LIST_COVER = r"(?i)^Annexure to Notification\b"
LIST_SKIP = ("Appendix 3", "SCOMET List", "Technical Note", "National equivalents", "Item", "Notification")
TERMINATOR = r"[.;:)\]”’\"']\s*$"
MANY_PAGES, SHORTEST = 3, 10


def clean_line(line: Column) -> Column:
    """Struct (line, marked): a trimmed line without its footnote marker; null for headers, footers, rules and footnotes."""
    t = F.trim(line)
    gone = (t == "") | t.rlike(RULE) | t.rlike(FOOTER) | t.rlike(SECTION_HEADER) | t.rlike(FOOTNOTE)
    bare = F.regexp_replace(t, FOOTNOTE_MARKER, "")
    return F.struct(F.when(~gone, F.nullif(F.trim(bare), F.lit(""))).alias("line"), (~gone & (bare != t)).alias("marked"))


def repair_code(line: Column) -> Column:
    """Struct (code, text, repaired) of a line that begins an entry; a null code: it begins none.

    A code that the grammar does not allow is tried without its last part, if
    that is one character of four or more parts; the part goes back to the text.
    """
    parts = F.filter(F.array(*[F.regexp_extract(line, ENTRY, k) for k in range(1, 8)]), lambda p: p != "")
    text = F.trim(F.regexp_extract(line, ENTRY, 8))
    whole, n = F.array_join(parts, "."), F.size(parts)
    head, tail = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), "."), F.get(parts, n - 1)
    ok, grammar = line.rlike(ENTRY), CODE_GRAMMAR["wassenaar_2025"]
    sound, mend = ok & whole.rlike(grammar), ok & (n >= 4) & (F.length(tail) == 1) & head.rlike(grammar)
    return F.struct(
        F.when(sound, whole).when(mend, head).alias("code"),
        F.when(sound, text).when(mend, F.trim(F.concat_ws(" ", tail, text))).otherwise(line).alias("text"),
        F.coalesce(~sound & mend, F.lit(False)).alias("repaired"),
    )


def page_lines(pages: DataFrame) -> DataFrame:
    """(book, page, header, line_no, raw) of (book, page, text); header: the page's first line that is not a rule."""
    raw = pages.select("book", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r")).alias("line_no", "raw"))
    t = F.trim("raw")
    header = raw.filter((t != "") & ~t.rlike(RULE)).groupBy("book", "page").agg(F.min_by(t, F.col("line_no")).alias("header"))
    return raw.join(header, ["book", "page"], "left").withColumn("header", F.coalesce("header", F.lit("")))


def _number(lines: DataFrame, event: str) -> DataFrame:
    """Adds ``group``: how many events of the book stand up to a line."""
    inside = Window.partitionBy("book", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("book").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = lines.groupBy("book", "page").agg(F.sum(F.col(event).cast("long")).alias("events"))
    pages = pages.select("book", "page", F.coalesce(F.sum("events").over(before), F.lit(0)).alias("base"))
    return lines.withColumn("own", F.sum(F.col(event).cast("long")).over(inside)).join(pages, ["book", "page"]).withColumn("group", F.col("base") + F.col("own")).drop("base", "own")


def _entries(lines: DataFrame) -> DataFrame:
    """Groups of lines (book, page, line_no, group, code of the first line, text, flag arrays) to entries."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "text"))), lambda x: x["text"]), " ")
    pages = F.array_sort(F.collect_set("page"))
    out = lines.groupBy("book", "group").agg(F.max("code").alias("code"), collapse(whole).alias("text"), pages.alias("pages"), F.flatten(F.collect_set("flags")).alias("flags"))
    more = F.when(F.size("pages") > 1, F.array(F.lit("page_continuation"))).otherwise(F.array().cast("array<string>"))
    return out.filter("code is not null").withColumn("flags", F.array_union("flags", more))


def finish(entries: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """One entry a code: the longest text, the first of equal ones; flags of all its occurrences, completeness, how many were dropped."""
    e = entries.filter((F.length("text") >= shortest) | (completeness("code", "text") == "stub"))
    best = F.max_by(F.struct("text", "pages"), F.struct(F.length("text"), -F.col("group")))
    out = e.groupBy("book", "code").agg(best.alias("b"), F.array_distinct(F.flatten(F.collect_set("flags"))).alias("f"), (F.count("*") - 1).alias("duplicate_occurrences"))
    out = out.select("book", "code", "b.text", "b.pages", "f", "duplicate_occurrences")
    more = F.array_compact(F.array(F.when(F.col("duplicate_occurrences") > 0, "duplicate_occurrences"), F.when(~F.col("text").rlike(TERMINATOR), "unterminated_text"), F.when(F.size("pages") > MANY_PAGES, "spans_many_pages")))
    return out.select("book", "code", "text", "pages", F.array_sort(F.array_union("f", more)).alias("parse_flags"), completeness("code", "text").alias("text_completeness"), "duplicate_occurrences")


def parse_dual_use(pages: DataFrame) -> DataFrame:
    """Entries of a list whose codes are printed apart (``3. A. 2. d.``), continued over pages.

    Pages whose header is not DUAL-USE LIST end the entry before them; an ANNEX
    line ends one too; a footnote block runs to the end of its page.
    """
    lines = page_lines(pages).withColumn("t", F.trim("raw"))
    note = lines.filter(F.col("t").rlike(FOOTNOTE)).groupBy("book", "page").agg(F.min("line_no").alias("note"))
    inside = F.col("header").startswith("DUAL-USE LIST")
    lines = lines.join(note, ["book", "page"], "left").filter((inside & F.coalesce(F.col("line_no") < F.col("note"), F.lit(True))) | (~inside & (F.col("line_no") == 0)))
    lines = lines.withColumn("stop", ~inside | F.col("t").rlike(ANNEX)).withColumn("c", clean_line(F.col("t"))).filter(F.col("stop") | F.col("c.line").isNotNull())
    lines = lines.withColumn("r", repair_code(F.col("c.line"))).withColumn("begins", ~F.col("stop") & F.col("r.code").isNotNull()).withColumn("event", F.col("stop") | F.col("begins"))
    lines = _number(lines, "event")
    flags = F.array_compact(F.array(F.when(F.col("begins") & F.col("r.repaired"), "code_repaired"), F.when(F.col("c.marked"), "footnote_marker_stripped")))
    kept = lines.filter("not stop").select("book", "group", "page", "line_no", F.when(F.col("begins"), F.col("r.code")).alias("code"), F.when(F.col("begins"), F.col("r.text")).otherwise(F.col("c.line")).alias("text"), flags.alias("flags"))
    return finish(_entries(kept))


def parse_list(pages: DataFrame) -> DataFrame:
    """Entries of a list with closed codes (``8A301``): pages count from the list's header to an annexure; rows that repeat the code go on."""
    lines = page_lines(pages)
    by_page = lines.groupBy("book", "page").agg(F.first("header").alias("header"))
    opens = F.when(F.col("header").rlike(LIST_COVER), None).when(F.col("header").rlike(LIST_ANNEX), False).when(F.col("header").rlike(LIST_HEADER), True)
    latch = F.last(opens, ignorenulls=True).over(Window.partitionBy("book").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    by_page = by_page.select("book", "page", (F.coalesce(latch, F.lit(False)) & ~F.col("header").rlike(LIST_COVER) & ~F.col("header").rlike(LIST_ANNEX)).alias("inside"))
    skip = F.lit(False)
    for s in LIST_SKIP:
        skip = skip | F.col("t").startswith(s)
    lines = lines.join(by_page, ["book", "page"]).withColumn("t", F.trim("raw")).filter((F.col("inside") & (F.col("t") != "") & ~F.col("t").rlike(LIST_HEADER) & ~skip) | (~F.col("inside") & (F.col("line_no") == 0)))
    entry = F.col("inside") & F.col("t").rlike(LIST_ENTRY)
    lines = lines.withColumn("stop", ~F.col("inside") | (F.col("t").rlike(LIST_HEADING) & ~entry)).withColumn("code", F.when(entry, F.concat(*[F.regexp_extract("t", LIST_ENTRY, k) for k in range(1, 5)])))
    marks = lines.filter("stop or code is not null")  # an entry that repeats the one before it goes on
    marks = marks.withColumn("before", F.lag(F.when(~F.col("stop"), F.col("code"))).over(Window.partitionBy("book").orderBy("page", "line_no")))
    marks = marks.select("book", "page", "line_no", F.coalesce(~F.col("stop") & (F.col("before") == F.col("code")), F.lit(False)).alias("again"))
    lines = lines.join(marks, ["book", "page", "line_no"], "left").withColumn("event", F.col("again").isNotNull() & ~F.coalesce("again", F.lit(False)))
    lines = _number(lines, "event")
    flags = F.array_compact(F.array(F.when(F.col("again"), "table_row_merged")))
    text = F.when(F.col("code").isNotNull(), F.trim(F.regexp_extract("t", LIST_ENTRY, 5))).otherwise(F.col("t"))
    return finish(_entries(lines.filter("not stop").select("book", "group", "page", "line_no", "code", text.alias("text"), flags.alias("flags"))))


# ---------------------------------------------------------------- XML appendices

# Names of sections and fields, shapes of headings.
ITEMS_SECTION = "List of Items Controlled"
SECTIONS = {"list of items controlled": ITEMS_SECTION, "license requirements": "License Requirements", "list based license exceptions": "List Based License Exceptions", "special conditions for st": "Special Conditions for STA", "reporting requirements": "Reporting Requirements"}
ITEM_FIELDS = ("Items", "Related Controls", "Related Definitions")
XML_CODE = re.compile(r"([0-9][A-EY][0-9]{3}[A-Za-z]?)\b")
FIELD = re.compile(r"([A-Z][A-Za-z /()\"'’.-]{2,60}?):?\s*$")
CATEGORY = re.compile(r"Category\s+([0-9])\s*[—\-–]\s*(.*)$")
GROUP = re.compile(r"([A-E])\.\s+(.*)$")
DIVIDER = re.compile(r"(?:Part\s+[0-9]+\s*[—–-]|(?:I{1,3}|IV|VI{0,3}|IX|XI{0,3})\.\s|Annex\b)")
XML_ENTRY = "array<struct<code:string,category:string,category_title:string,product_group:string,product_group_title:string,heading:string,items:string,items_source:string,related_controls:string,related_definitions:string,reason_for_control:string,sections:map<string,string>>>"


def _squash(*parts: str | None) -> str:
    return " ".join(" ".join(p for p in parts if p).split())


def _words(node) -> str:
    return _squash("".join(node.itertext()))


def section_name(label: str) -> str:
    """One spelling for each known section; others as they stand."""
    plain = label.strip().rstrip(":").strip()
    low = plain.lower()
    if low == "license exceptions":
        low = "list based license exceptions"
    return next((name for start, name in SECTIONS.items() if low.startswith(start)), plain)


def rendered(node) -> str:
    """A node as plain text: tables as ``cell | cell ;; cell``, everything else its words in order."""
    if node.tag == "DIV" or node.find(".//TABLE") is not None:
        rows = [[_words(c) for c in tr if c.tag in ("TD", "TH")] for tr in node.iter("TR")]
        if table := " ;; ".join(" | ".join(filter(None, r)) for r in rows if any(r)):
            return table
    if node.tag == "NOTE":
        return _squash(node.text, *(x for c in node for x in (_words(c), c.tail)))
    return _words(node)


def event(node) -> tuple:
    """What a child of the appendix is: skip, mark (a heading), entry, section, field or body."""
    if node.tag in ("HEAD", "XREF", "CITA", "EDNOTE", "img"):
        return ("skip",)
    if node.tag in ("HD1", "HD2", "HD3"):
        return "mark", _words(node)
    children, lead = list(node), _squash(node.text)
    first = children[0] if children else None
    if node.tag in ("FP", "FP-1", "FP-2") and first is not None and not lead:
        if first.tag == "B" and (m := XML_CODE.match(_words(first))):
            return "entry", m[1], _squash(_words(node)[len(m[1]) :])
        if len(children) == 1 and first.tag in ("E", "I") and not _squash(first.tail):
            name = section_name(_words(first))
            if name and (first.tag == "E" or name in SECTIONS.values()):
                return "section", name
    if first is not None and first.tag == "I" and not lead:
        label = _words(first)
        m = FIELD.match(label)
        if m and (label.endswith(":") or m[1].strip() in ITEM_FIELDS):
            return "field", m[1].strip(), _squash(first.tail, *(x for c in children[1:] for x in ("".join(c.itertext()), c.tail)))
    return "body", rendered(node)


class _Entry:
    def __init__(self, code: str, heading: str, where: dict):
        self.code, self.heading, self.where = code, heading, where
        self.sections: dict[str, str] = {}
        self.fields: dict[tuple, str] = {}
        self.listed = ""  # what the items section holds besides the related fields

    def add(self, section: str | None, field: str | None, text: str, open_items: bool) -> None:
        if section is None:
            self.heading = _squash(self.heading, text)
            return
        self.sections[section] = _squash(self.sections.get(section), text)
        if section == ITEMS_SECTION:
            self.listed = _squash(self.listed, text)
        if open_items:
            self.fields[ITEMS_SECTION, "Items"] = _squash(self.fields.get((ITEMS_SECTION, "Items")), text)

    def row(self) -> dict:
        own = lambda s, f: self.fields.get((s, f), "")
        items = own(ITEMS_SECTION, "Items")
        source = "items_marker" if items else "loic_body_fallback" if self.listed else "none"
        return {"code": f"ECCN-{self.code}", **self.where, "heading": self.heading, "items": items or self.listed, "items_source": source, "related_controls": own(ITEMS_SECTION, "Related Controls"), "related_definitions": own(ITEMS_SECTION, "Related Definitions"), "reason_for_control": own("License Requirements", "Reason for Control"), "sections": dict(self.sections)}


def parse_appendix(xml: str | None) -> list[dict]:
    """Entries of an appendix in document order; a text that is no XML has none."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    out: list[dict] = []
    entry: _Entry | None = None
    section = field = None
    place = {"category_title": "", "group": "", "group_title": ""}

    def close():
        nonlocal entry, section, field
        if entry is not None:
            out.append(entry.row())
        entry, section, field = None, None, None

    for node in root:
        kind, *what = event(node)
        if kind == "mark":
            label = what[0]
            if m := CATEGORY.match(label):
                close()
                place = {"category_title": m[2].strip(), "group": "", "group_title": ""}
            elif m := GROUP.match(label):
                close()
                place |= {"group": m[1], "group_title": m[2].strip()}
            elif DIVIDER.match(label):
                close()
            elif entry is not None and section_name(label) in SECTIONS.values():
                section, field = section_name(label), None
                entry.sections.setdefault(section, "")
            elif entry is not None and section is not None:
                entry.sections[section] = _squash(entry.sections[section], label)
                if section == ITEMS_SECTION:
                    entry.listed = _squash(entry.listed, label)
                if field is not None:
                    entry.fields[section, field] = _squash(entry.fields.get((section, field)), label)
            else:
                close()
        elif kind == "entry":
            close()
            code, heading = what
            entry = _Entry(code, heading, {"category": code[0], "category_title": place["category_title"], "product_group": place["group"] or code[1], "product_group_title": place["group_title"]})
        elif entry is None or kind == "skip":
            continue
        elif kind == "section":
            section, field = what[0], None
            entry.sections.setdefault(section, "")
        elif kind == "field":
            field, rest = what
            if field in ITEM_FIELDS:
                section = ITEMS_SECTION
            key = (section or "", field)
            entry.fields[key] = _squash(entry.fields.get(key), rest)
            if section:
                entry.sections[section] = _squash(entry.sections.get(section), f"{field}: {rest}")
            if section == ITEMS_SECTION and field not in ITEM_FIELDS[1:]:
                entry.listed = _squash(entry.listed, rest)
        elif what[0]:
            entry.add(section, field, what[0], section == ITEMS_SECTION and field == "Items")
    close()
    return out


def appendix_entries(rows: DataFrame, xml: str, *keys: str, text_field: str = "full") -> DataFrame:
    """keys and one row for each entry of an XML column; text: the heading alone, or with the items."""
    if text_field not in ("full", "heading"):
        raise ValueError("text_field must be full or heading")

    ship_active()

    @F.pandas_udf(XML_ENTRY)
    def parse(x: pd.Series) -> pd.Series:
        return x.map(parse_appendix)

    e = rows.select(*keys, F.explode(parse(F.col(xml))).alias("e")).select(*keys, "e.*")
    full = F.trim(F.concat_ws(" ", F.nullif(F.col("heading"), F.lit("")), F.nullif(F.col("items"), F.lit(""))))
    return e.withColumn("heading_only", F.col("items") == "").withColumn("text", full if text_field == "full" else F.col("heading"))


def has_node(c, key: str, value: str) -> Column:
    """Whether anywhere in a JSON text an object has the value (as text) at the key; false for what is no JSON."""

    def walk(x) -> bool:
        if isinstance(x, dict):
            return (key in x and str(x[key]) == value) or any(map(walk, x.values()))
        return isinstance(x, list) and any(map(walk, x))

    ship_active()

    @F.pandas_udf("boolean")
    def find(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                return walk(json.loads(t or ""))
            except ValueError:
                return False

        return s.map(one)

    return find(c)
