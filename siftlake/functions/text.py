"""Text scalars as Column expressions: tokens, sentences, modes, exposure, code grammar, flags.

Everything stays inside whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token alphabet, control-code grammar, heading words, keywords, modes.
WORD = "[A-Za-z0-9가-힣]+"
CONTROL_CODE = r"\b(?:ECCN-)?[0-9][A-EY][0-9]{3}[A-Za-z]?(?:\.[A-Za-z0-9]+)*\b|\b[0-9]\.[A-E](?:\.[0-9]+)?(?:\.[a-z])?(?:\.[0-9]+)?(?:\.[a-z])?(?:\.[0-9]+)?\b"
DROP_TEXT = r"(?i)^\s*(?:\[?reserved\]?|not used since|software$|technology$|materials(?:\s*-\s*none)?$|systems, equipment and components$)\s*$"
FRAGMENT_START = r"(?i)^\s*(?:or|and|&)\b"
CODE_GRAMMAR = {
    "wassenaar_2025": r"^[0-9]\.[A-E](?:\.[0-9]+)?(?:\.[a-z])?(?:\.[0-9]+)?(?:\.[a-z])?(?:\.[0-9]+)?$",
    "india_scomet_2024": r"^[0-9][A-Z][0-9]{3}[a-z]?$",
    "ecfr_part774": r"^ECCN-[0-9][A-EY][0-9]{3}[A-Za-z]?(?:\.[A-Za-z0-9]+)*$",
}
STUB_TEXT = r"(?i)^\s*(?:not used since\b.*|\[?\(?\s*reserved\s*\)?\]?\.?|deleted\.?)\s*$"
STUB_MARKER = r"(?i)\(\s*see\s+(?:the\s+)?list\s+of\s+items\s+cont(?:r)?ol"
CATEGORY_CODE = r"^[0-9]\.[A-E]$"
CORE_CODE = r"^ECCN-(\d)([A-EY])0(\d{2})$"
SHORT_TEXT = 150
ACTIONABLE = ("full_text", "minimal_text")
KEYWORDS = ("semiconductor", "integrated circuit", "microprocessor", "wafer", "display", "battery", "secondary cell", "electric vehicle", "shipbuilding", "robot", "hydrogen", "aerospace", "biotechnology", "nuclear")
MODES = ("full_text", "minimal_text", "minimal_no_code", "route_only")
MARK = "␞"


def text_of(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(c) -> Column:
    """Lower-cased runs of Latin letters, digits and Hangul syllables; null gives none.

    Only A-Z are lowered, before the runs are taken, which changes no boundary.
    """
    lowered = F.translate(text_of(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def collapse(c) -> Column:
    """Runs of (Unicode) white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), r"(?U)\s+", " "))


def first_sentence(c, most: int = 260) -> Column:
    """First sentence, or first two if it is shorter than 80 characters, cut at ``most``.

    No character after the first ``most`` + 82 of the collapsed text can change
    it; those are in the text's head, unless that is mostly white space.
    """
    need = most + 82
    head = collapse(F.substring(text_of(c), 1, 4 * need))
    head = F.substring(F.when(F.length(head) >= need, head).otherwise(collapse(c)), 1, need)
    parts = F.split(F.regexp_replace(head, r"([.;])\s+", "$1" + MARK), MARK, 3)
    two = (F.length(parts[0]) < 80) & (F.size(parts) > 1)
    return F.trim(F.substring(F.when(two, F.concat_ws(" ", parts[0], F.get(parts, F.lit(1)))).otherwise(parts[0]), 1, most))


def route_text(system: str, route: str, flags: str) -> Column:
    """``system | route | flags=a, b`` or ``flags=none``."""
    joined = F.array_join(F.coalesce(F.col(flags), F.array().cast("array<string>")), ", ")
    return F.concat(F.coalesce(F.col(system), F.lit("None")), F.lit(" | "), F.coalesce(F.col(route), F.lit("None")), F.lit(" | flags="), F.when(joined == "", "none").otherwise(joined))


def index_text(mode: Column, code: str = "code", text: str = "text", route: Column | None = None) -> Column:
    """The text that a mode indexes or returns; an unknown mode is an error."""
    short = first_sentence(text)
    out = F.when(mode == "full_text", F.concat(text_of(code), F.lit(" "), text_of(text))).when(mode == "minimal_text", F.concat(text_of(code), F.lit(" "), short)).when(mode == "minimal_no_code", short)
    if route is not None:
        out = out.when(mode == "route_only", route)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown mode: "), mode)).cast("string"))


returned_text = index_text


def exposure_chars(mode: Column, **columns) -> Column:
    """Code points returned."""
    return F.length(index_text(mode, **columns))


def legacy_exposure_chars(mode: Column, text: str = "text", route: Column | None = None) -> Column:
    """The superseded definition, kept for audits: codes are not counted."""
    out = F.when(mode == "full_text", F.length(text_of(text))).when(mode.isin("minimal_text", "minimal_no_code"), F.length(first_sentence(text)))
    return (out.when(mode == "route_only", F.length(route)) if route is not None else out).otherwise(0)


def clean_text(c) -> Column:
    return F.regexp_replace(collapse(c), r"\s+([,.;:])", "$1")


def valid_code(source: str, code: str) -> Column:
    """Whether the code follows its source's grammar; unknown sources have none."""
    out = F.lit(False)
    for name, grammar in CODE_GRAMMAR.items():
        out = F.when(F.col(source) == name, text_of(code).rlike(grammar)).otherwise(out)
    return out


def quality_flags(c) -> Column:
    t = text_of(c)
    keyword = F.lit(False)
    for k in KEYWORDS:
        keyword = keyword | F.contains(F.lower(t), F.lit(k))
    return F.array_compact(F.array(
        F.when(F.length(t) < 40, "short_text"), F.when(t.rlike(FRAGMENT_START), "possible_fragment"),
        F.when(t.rlike("(?i)" + CONTROL_CODE), "contains_cross_reference"), F.when(keyword, "possible_national_core_technology_review"),
    ))


def drop_reason(source: str, code: str, c: str, version: int = 1) -> Column:
    """Why an entry is dropped (first reason that holds); null: it is kept.  Version 2 keeps headings and fragments."""
    t = clean_text(c)
    out = F.when((F.trim(text_of(code)) == "") | (t == ""), "empty_code_or_text").when(~valid_code(source, code), "invalid_code_format")
    if version == 1:
        out = out.when(t.rlike(DROP_TEXT), "non_control_or_reserved_heading").when(t.rlike(FRAGMENT_START) & (F.length(t) < 80), "short_fragment")
    return out


def completeness(code, c) -> Column:
    """stub, heading_only or full."""
    t = F.trim(text_of(c))
    return F.when((t == "") | t.rlike(STUB_TEXT), "stub").when(text_of(code).rlike(CATEGORY_CODE), "heading_only").otherwise("full")


def is_stub_marker(c) -> Column:
    return text_of(c).rlike(STUB_MARKER)


def is_stub_content(c, items: Column | None = None, heading_only: Column | None = None) -> Column:
    """Whether the technical content is missing: no items, and only a heading, the marker or a short text."""
    t = F.trim(text_of(c))
    out = t.rlike(STUB_MARKER) | (F.length(t) < SHORT_TEXT)
    if heading_only is not None:
        out = F.coalesce(heading_only, F.lit(False)) | out
    return out if items is None else (F.trim(text_of(items)) == "") & out


def leak_hits(query: str, codes: Column) -> Column:
    """Labels of what a text gives away: ``label:<code>`` for each code it names in any spelling, and the first thing shaped like a code."""
    q = F.lower(text_of(query))
    bare = lambda c: F.replace(c, F.lit("ECCN-"), F.lit(""))
    spellings = lambda c: F.array(c, bare(c), F.replace(bare(c), F.lit("."), F.lit(" ")), F.replace(c, F.lit("-"), F.lit(" ")))
    named = F.filter(codes, lambda c: F.exists(spellings(c), lambda v: (v != "") & F.contains(q, F.lower(v))))
    shaped = F.regexp_extract(text_of(query), "(?i)" + CONTROL_CODE, 0)
    return F.concat(F.transform(named, lambda c: F.concat(F.lit("label:"), c)), F.when(shaped != "", F.array(F.concat(F.lit("control_code_re:"), shaped))).otherwise(F.array().cast("array<string>")))


def pattern_hits(c, patterns: list[str]) -> Column:
    """Those of the patterns that match, in their order."""
    return F.array_compact(F.array(*[F.when(text_of(c).rlike(p), F.lit(p)) for p in patterns]))


def query_text(query: str, translated: str, use_translation: bool) -> Column:
    """The translated query, where one is asked for and present."""
    return F.coalesce(F.nullif(F.trim(text_of(translated)), F.lit("")), F.col(query)) if use_translation else F.col(query)


def alpha_name(alpha: Column) -> Column:
    """BM25, dense or hybrid_<alpha>."""
    return F.when(alpha == 1.0, "BM25").when(alpha == 0.0, "dense").otherwise(F.concat(F.lit("hybrid_"), alpha.cast("string")))


def failure_type(labels_exist: Column, lang: Column, zero_score: Column) -> Column:
    """Why a query missed (first that holds)."""
    out = F.when(~labels_exist, "candidate_label_missing_in_corpus").when((lang == "ko") & zero_score, "korean_query_no_match")
    return out.when(zero_score, "zero_score_no_lexical_overlap").otherwise("candidate_label_not_in_top10")


def is_actionable(mode: Column) -> Column:
    """Whether what a mode returns names the item."""
    return mode.isin(*ACTIONABLE)


def lexical_overlap(a: Column, b: Column) -> Column:
    """Struct of the Jaccard similarity of two token arrays, the shared tokens, and whether there are none."""
    shared = F.array_sort(F.array_intersect(a, b))
    return F.struct(F.round(jaccard(a, b), 4).alias("jaccard"), shared.alias("shared"), (F.size(shared) == 0).alias("void"))


def rounded(scores: Column, places: int = 4) -> Column:
    """Every score of an array rounded (halves away from zero, as SQL does)."""
    return F.transform(scores, lambda x: F.round(x.cast("double"), places))


def dig(json: str, *path: str) -> Column:
    """The value at a path of a JSON text; null where any step is missing."""
    return F.get_json_object(json, "$." + ".".join(path))


def strip_control_codes(c) -> Column:
    t = F.regexp_replace(text_of(c), "(?i)" + CONTROL_CODE, " ")
    return F.btrim(collapse(F.regexp_replace(t, r"(?i)\b(?:ECCN|SCOMET|Wassenaar)\b", " ")), F.lit(" ;,.-"))


def compact_description(c, most: int = 360) -> Column:
    """Description without codes, cut at the last . ; or , past 160 characters if it is too long."""
    t = collapse(F.regexp_replace(strip_control_codes(c), r"(?i)\([^)]*(?:see|controlled by|specified in)[^)]*\)", " "))
    cut = F.substring(t, 1, most)

    def last(x):  # 0-based place of the last x, -1 if there is none
        at = F.locate(x, F.reverse(cut))
        return F.when(at > 0, F.length(cut) - at).otherwise(-1)

    end = F.greatest(last("."), last(";"), last(","))
    trimmed = F.when(end > 160, F.concat(F.btrim(F.substring(cut, F.lit(1), end), F.lit(" ;,.")), F.lit("."))).otherwise(F.concat(F.btrim(cut, F.lit(" ;,.")), F.lit("...")))
    return F.when(F.length(t) <= most, t).otherwise(trimmed)


def code_leak(query: str, code: str) -> Column:
    """Whether a query names the code, a variant of it, or anything shaped like a code."""
    q, c = F.lower(text_of(query)), text_of(code)
    variants = F.array(c, F.replace(c, F.lit("ECCN-"), F.lit("")), F.replace(c, F.lit("."), F.lit(" ")), F.replace(c, F.lit("-"), F.lit(" ")))
    return F.exists(variants, lambda v: (v != "") & F.contains(q, F.lower(v))) | text_of(query).rlike("(?i)" + CONTROL_CODE)


def normalize_code(c) -> Column:
    u = F.upper(F.trim(text_of(c)))
    return F.regexp_replace(F.replace(F.replace(u, F.lit("ECCN-"), F.lit("")), F.lit("ECCN"), F.lit("")), "[^A-Z0-9]", "")


def singular(tok: Column) -> Column:
    ies = (F.length(tok) > 4) & tok.endswith("ies")
    s = (F.length(tok) > 3) & tok.endswith("s") & ~tok.rlike("(?:ss|us|is|os)$")
    return F.when(ies, F.concat(F.expr("''"), F.regexp_replace(tok, "ies$", "y"))).when(s, F.regexp_replace(tok, "s$", "")).otherwise(tok)


def item_terms(query, lang: str, generic: list[str], shortest: int = 4) -> Column:
    """Sorted distinct normalised words that may name an item; outside English only Latin ones."""
    g = F.array(*map(F.lit, generic)) if generic else F.array().cast("array<string>")
    named = lambda n: lambda t: (F.length(t) >= n) & ~t.rlike("^[0-9]+$") & ~F.array_contains(g, t)
    english = F.filter(tokens(query), named(shortest))
    latin = F.filter(tokens(query), lambda t: named(2)(t) & t.rlike("^[a-z0-9]+$"))
    return F.array_sort(F.array_distinct(F.transform(F.when(F.col(lang) == "en", english).otherwise(latin), singular)))


def has_hangul(c) -> Column:
    return text_of(c).rlike("[가-힣]")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones give 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def significant(x: Column, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits - 1}e", x).cast("double")
