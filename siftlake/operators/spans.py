"""Sensitive-span detection: greedy claiming in a fixed order.

Numbers with their units are claimed first, then the terms of each category in
the order given, longest first.  A character is claimed once; a match that
overlaps a claimed one is given up whole.  The order matters character by
character, so a text is annotated in one Arrow batch function; everything after
that is a plan.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.text import tokens
from siftlake.shipping import ship_active

# The category of numbers, and units of measured quantities.
NUMBERS = "quantitative_spec"
UNITS = ("%", "mm", "cm", "km", "nm", "kg", "mg", "GHz", "MHz", "kHz", "Hz", "kW", "MW", "°C", "bar", "MPa")
SPANS = "array<struct<category:string,term:string,surface:string,start:int>>"


def term_pattern(term: str) -> re.Pattern:
    """Whole words in any case for ASCII terms, substrings for others; any white space between a term's words."""
    body = r"\s+".join(re.escape(w) for w in term.split())
    return re.compile(rf"\b{body}\b", re.IGNORECASE) if term.isascii() else re.compile(body)


def number_pattern(units: tuple[str, ...]) -> re.Pattern:
    longest_first = sorted(units, key=len, reverse=True)
    unit = "(?:{})?".format("|".join(map(re.escape, longest_first))) if units else ""
    return re.compile(rf"\d+(?:[.,]\d+)?\s*{unit}", re.IGNORECASE)


class Claims:
    """The claimed intervals of a text, kept in order."""

    def __init__(self):
        self.ends: list[tuple[int, int]] = []  # (end, start) of disjoint intervals

    def take(self, start: int, end: int) -> bool:
        k = bisect_left(self.ends, (start + 1, -1))  # the first that ends after start
        if start >= end or (k < len(self.ends) and self.ends[k][1] < end):
            return start >= end
        insort(self.ends, (end, start))
        return True


def claim(text: str, lexicon: dict[str, list[str]], units: tuple[str, ...] = UNITS) -> list[dict]:
    """Spans of a text in the order of their starts."""
    claims, out = Claims(), []
    rules = [(NUMBERS, "<numeric>", number_pattern(units))]
    rules += [(c, t, term_pattern(t)) for c, terms in lexicon.items() for t in sorted(terms, key=len, reverse=True)]
    for category, term, pattern in rules:
        for m in pattern.finditer(text):
            surface = m.group().rstrip() if category == NUMBERS else m.group()
            if surface and claims.take(m.start(), m.start() + len(surface)):
                out.append({"category": category, "term": term, "surface": surface, "start": m.start()})
    return sorted(out, key=lambda s: s["start"])


def annotate(text: Column, lexicon: dict[str, list[str]], units: tuple[str, ...] = UNITS) -> Column:
    """array<struct<category, term, surface, start>> of a text's spans; null text has none."""

    ship_active()

    @F.pandas_udf(SPANS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: claim(t or "", lexicon, units))

    return run(text)


def measure(rows: DataFrame, key: str, text: str, lexicon: dict[str, list[str]], counted: list[str] | None = None) -> DataFrame:
    """(key, fields, tokens, spans, by_category, n_tokens, chars) of every text.

    A span counts its tokens, one at least; fields, tokens and spans are those
    of the counted categories (all, if none are named).
    """
    width = lambda s: F.greatest(F.lit(1), F.size(tokens(s["surface"])))
    own = (lambda s: s["category"].isin(*counted)) if counted is not None else (lambda s: F.lit(True))
    spans = rows.select(key, F.col(text).alias("t"), annotate(F.col(text), lexicon).alias("s"))
    names = F.array_sort(F.array_distinct(F.transform("s", lambda s: s["category"])))
    total = lambda kept: F.aggregate(kept, F.lit(0), lambda n, s: n + width(s))
    per = F.transform(names, lambda c: F.concat_ws("=", c, total(F.filter("s", lambda s: s["category"] == c)).cast("string")))
    kept = F.filter("s", own)
    return spans.select(key, F.array_join(F.array_sort(F.array_distinct(F.transform(kept, lambda s: s["category"]))), ",").alias("fields"), total(kept).cast("long").alias("tokens"), F.size(kept).cast("long").alias("spans"), F.array_join(per, ",").alias("by_category"), F.size(tokens("t")).cast("long").alias("n_tokens"), F.length(F.coalesce("t", F.lit(""))).cast("long").alias("chars"))


def field_frequency(rows: DataFrame, level: str, spans: Column) -> DataFrame:
    """(level, category, n): texts of a level in which a category occurs."""
    one = rows.select(level, F.explode(F.array_distinct(F.transform(spans, lambda s: s["category"]))).alias("category"))
    return one.groupBy(level, "category").agg(F.count("*").alias("n"))


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Multiset difference of (key, category, surface) rows: what a rewriting took away."""
    return before.exceptAll(after)
