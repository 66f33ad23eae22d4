"""Fill-in-middle transformation: texts cut at two units and put together as prefix, suffix, middle or suffix, prefix, middle.

A text is read twice and nothing of it is kept but the two places: the first
pass counts the units, the second advances one lazy match iterator to the
lower and then to the higher rank.  There is no list of units, so besides the
text and its output a worker needs the same few bytes for any number of units.

The ranks are drawn from the document's id alone, so a row gives the same
output wherever and however often its task runs; there is no shuffle.

Results for odd input: a null text is an empty one; an empty text, and one
that holds a mark itself, is ``plain`` (the text as it is, no lengths); a null
id draws as the empty string; rows that repeat an id draw alike; an empty
table gives an empty one; other columns of the input are not read.
"""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import over_batches, ship

#: A line with its end, or what is left without one.
LINES = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
#: Characters of output after which a batch is handed on.
EMIT = 4 << 20

_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def cut_points(unit: re.Pattern, text: str, draw: tuple[int, int]) -> tuple[int, int, int]:
    """(number of units, end of the prefix, end of the middle), the ends as places in the text."""
    n = sum(1 for _ in unit.finditer(text))
    low, high = sorted(d % (n + 1) for d in draw)
    matches, at, reached = unit.finditer(text), [], 0
    end = 0
    for rank in (low, high):
        if rank > reached:
            end = next(islice(matches, rank - reached - 1, None)).end()
            reached = rank
        at.append(end)
    return n, at[0], at[1]


def assemble(text: str, low: int, high: int, form: str, marks: tuple[str, str, str]) -> str:
    p, s, m = marks
    if form == "plain":
        return text
    if form == "psm":
        return f"{p}{text[:low]}{s}{text[high:]}{m}{text[low:high]}"
    return f"{s}{text[high:]}{p}{text[:low]}{m}{text[low:high]}"


def _kernel(pattern: str, marks):
    unit = re.compile(pattern)

    def run(batches):
        out, size = [], 0

        def flush():
            nonlocal out, size
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
            out, size = [], 0
            return batch

        for b in batches:
            ids, h1, h2, forms = (b.column(k).to_pylist() for k in range(4))
            for k, form in enumerate(forms):
                text = b.column(4)[k].as_py() or ""
                n, low, high = cut_points(unit, text, (h1[k], h2[k]))
                if not text or any(m in text for m in marks):
                    form = "plain"
                plain = form == "plain"
                out.append((ids[k], n, form, None if plain else low, None if plain else high - low, assemble(text, low, high, form, marks)))
                size += len(text)
                if size > EMIT:
                    yield flush()
        yield flush()

    return run


def fill_in_middle(
    docs: DataFrame, *, unit: str = LINES, percent: int = 100, spm_percent: int = 50, seed: str = "7", marks: tuple[str, str, str] = MARKS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row.

    unit: a pattern whose matches, left to right, cover the text.  percent of
    the documents are transformed, spm_percent of those with the suffix first.
    """
    ship(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    form = F.when(h[2] % 100 >= percent, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    drawn = base.withColumn("digest", digest).select("id", h[0].alias("h1"), h[1].alias("h2"), form.alias("form"), "text")
    return drawn.mapInArrow(over_batches(_kernel(unit, marks)), _SCHEMA)


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text again, from an output and its form alone."""
    parts = F.split(F.col(output), "|".join(rf"\Q{m}\E" for m in marks), -1)
    piece = [F.element_at(parts, k + 1) for k in range(4)]
    return F.when(F.col(form) == "psm", F.concat(piece[1], piece[3], piece[2])).when(F.col(form) == "spm", F.concat(piece[2], piece[3], piece[1])).otherwise(F.col(output))
