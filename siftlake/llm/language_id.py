"""Language identification by hierarchical discrimination.

A first set of linear machines (one against the rest) predicts the language
family; within a family, one-versus-one linear support vector machines separate
the related languages by votes (ties: sum of margins, then name).  Features are
hashed byte 2- and 3-grams of the whole text, lower-cased, with everything but
letters folded into single spaces, as shares of the text's n-grams.

The machines are fitted on the driver from at most ``per_language`` rows of
each value of ``lang``, fewer where there are so many values that this would
pass ``most_rows`` in all (one row each at least), taken in the order of a hash
of the id.  All rows are scored, map-only, with the weights shipped in the
tasks (``BINS`` numbers for each language, and for each pair in a family).

Defined results: null text, or text without a letter, is ``und`` with score 0,
as is everything when there is no training row; repeated rows are scored one
by one; a null doc_id is held out of training and scored (held_out null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, crc_fold, least_per_group, over_batches, ship, slices, text_bytes
from .linear import Rows, sigmoid, slope, svm

BINS = 1 << 14
#: Families of common language codes; other codes are families of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "mk", "pl", "cs", "sk", "sl", "hr", "bs"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "pa", "gu"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def family(code: str) -> str:
    return _FAMILY.get(code.lower().split("-")[0].split("_")[0], f"only {code}")


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case: ASCII and the capital letters of Latin-1."""
    data = LOWER[data]
    high = np.zeros(len(data), bool)
    high[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data[high] += 0x20
    return data


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins of all rows back to back, their offsets)."""
    data = folded(data)
    data = np.where(LETTER[data], data, 32).astype(np.uint8)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    upto = np.concatenate(([0], np.cumsum(keep)))
    offsets, data = upto[offsets], data[keep].astype(np.uint32)
    n = np.diff(offsets)
    out, counts = [], []
    for k in (2, 3):
        code = np.zeros(max(0, len(data) - k + 1), np.uint32)
        for j in range(k):
            code = (code << np.uint32(8)) | data[j : j + len(code)]
        with np.errstate(over="ignore"):
            code = ((code + np.uint32(k << 24)) * np.uint32(2654435769)) >> np.uint32(32 - 14)
        inside = np.ones(len(code), bool)
        for j in range(1, k):  # grams that would cross into the next row
            cross = offsets[1:-1] - j
            inside[cross[(cross >= 0) & (cross < len(code))]] = False
        out.append(code[inside])
        counts.append(np.concatenate(([0], np.cumsum(inside)))[np.minimum(offsets, len(code))])
    if len(n) == 1:
        return np.concatenate(out), np.array([0, len(out[0]) + len(out[1])])
    order = np.concatenate([np.repeat(np.arange(len(n)), np.diff(c)) for c in counts])
    both = np.concatenate(out)[np.argsort(order, kind="stable")]
    return both, counts[0] + counts[1]


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


class Model:
    """fit() on bounded rows; predict() on whole slices of text."""

    def __init__(self, labels: list[str], rows: list[tuple[np.ndarray, np.ndarray]], ridge: float = 1e-4):
        names = sorted(set(labels))
        y, x = np.array([names.index(k) for k in labels]), Rows.of(rows, BINS)
        share = np.bincount(x.column, x.value, BINS) / max(1, len(x))
        self.scale = 1 / np.sqrt(share + 1e-4)
        x = Rows(x.first, x.column, x.value * self.scale[x.column], BINS)
        self.names = names
        self.families: dict[str, list[int]] = {}
        for k, name in enumerate(names):
            self.families.setdefault(family(name), []).append(k)
        groups = list(self.families.values())
        of = np.array([next(i for i, g in enumerate(groups) if k in g) for k in range(len(names))])
        self.tasks: list[tuple[str, int, int]] = []  # ("family", f, 0) or ("pair", a, b)
        weights, self.slopes = [], []
        jobs = [("family", f, 0) for f in range(len(groups))] if len(groups) > 2 else [("family", 0, 0)] * (len(groups) == 2)
        jobs += [("pair", a, b) for g in groups for i, a in enumerate(g) for b in g[i + 1 :]]
        for kind, a, b in jobs:
            part = np.arange(len(y)) if kind == "family" else np.flatnonzero((y == a) | (y == b))
            sign = np.where((of[y[part]] == a) if kind == "family" else (y[part] == a), 1.0, -1.0)
            own = x.take(part)
            w = svm(own, sign, ridge)
            self.tasks.append((kind, a, b))
            self.slopes.append(slope(own.dot(w[:-1]) + w[-1], sign))
            weights.append(w)
        self.bias = np.array([w[-1] for w in weights])
        self.weights = np.array([w[:-1] * self.scale for w in weights]).reshape(len(weights), BINS).astype(np.float32)
        del self.scale

    def predict(self, bins: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        rows = len(offsets) - 1
        n = np.maximum(1, np.diff(offsets))
        margin = {}
        for (kind, a, b), w, bias, s in zip(self.tasks, self.weights, self.bias, self.slopes, strict=True):
            upto = np.concatenate(([0.0], np.cumsum(w[bins], dtype=np.float64)))
            margin[kind, a, b] = s * ((upto[offsets[1:]] - upto[offsets[:-1]]) / n + bias)
        groups = list(self.families.values())
        if len(groups) == 1:
            chance = np.ones((1, rows))
        elif len(groups) == 2:
            p = sigmoid(margin["family", 0, 0])
            chance = np.stack([p, 1 - p])
        else:
            chance = np.stack([sigmoid(margin["family", f, 0]) for f in range(len(groups))])
            chance = chance / np.maximum(1e-12, chance.sum(0))
        chosen = chance.argmax(0)
        best, score = np.zeros(rows, np.int64), np.zeros(rows)
        for f, g in enumerate(groups):
            votes, sums, sure = (np.zeros((len(g), rows)) for _ in range(3))
            for i, a in enumerate(g):
                for j in range(i + 1, len(g)):
                    m = margin["pair", a, g[j]]
                    votes[i] += m >= 0
                    votes[j] += m < 0
                    sums[i] += m
                    sums[j] -= m
                    sure[i] += sigmoid(m)
                    sure[j] += sigmoid(-m)
            key = votes + sigmoid(sums) * 0.5
            top = key.argmax(0)
            own = sure[top, np.arange(rows)] / (len(g) - 1) if len(g) > 1 else np.ones(rows)
            here = chosen == f
            best[here] = np.array(g)[top[here]]
            score[here] = (chance[f] * own)[here]
        return [self.names[k] for k in best], score


def _feature_kernel(batches):
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        labels = b.column(0)
        for lo, hi in slices(offsets):
            bins, at = grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            out = []
            for k in range(hi - lo):
                column, count = np.unique(bins[at[k] : at[k + 1]], return_counts=True)
                out.append((column.astype(np.int16), (count / max(1, count.sum())).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([labels.slice(lo, hi - lo), pa.array([c.tobytes() for c, _ in out], pa.binary()), pa.array([v.tobytes() for _, v in out], pa.binary())], ["lang", "columns", "counts"])


def fit(docs: DataFrame, train, *, text="text", doc_id="doc_id", lang="lang", per_language: int = 500, most_rows: int = 50_000) -> Model | None:
    """A model from the rows for which ``train`` holds; None if there is none."""
    ship(docs.sparkSession)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(train("doc_id")).filter("lang is not null and text is not null and doc_id is not null")
    per_language = min(per_language, max(1, most_rows // max(1, base.select("lang").distinct().count())))
    picked = least_per_group(base.select("doc_id", "lang"), "lang", "doc_id", per_language).distinct()
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")  # of rows that repeat an id, so that rows are as bounded as ids
    rows = base.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(one).select("lang", "one.text").mapInArrow(over_batches(_feature_kernel), "lang string, columns binary, counts binary").collect()
    if not rows:
        return None
    rows = sorted((r.lang, bytes(r.columns), bytes(r.counts)) for r in rows)
    return Model([r[0] for r in rows], [(np.frombuffer(c, np.int16).astype(np.int64), np.frombuffer(v, np.float32).astype(float)) for _, c, v in rows])


def _score_kernel(model, extra):
    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(b.num_columns - 1))
            lang, score = [], []
            for lo, hi in slices(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                plain = np.concatenate(([0], np.cumsum(LETTER[LOWER[part]] & (part < 128))))
                some = plain[at[1:]] > plain[at[:-1]]
                for k in np.flatnonzero(~some & (np.diff(at) > 0)):
                    some[k] = has_letter(part[at[k] : at[k + 1]].tobytes())
                names, p = model.predict(*grams(part, at)) if model else (["und"] * (hi - lo), np.zeros(hi - lo))
                lang += [x if ok else "und" for x, ok in zip(names, some, strict=True)]
                score.append(np.where(some, p, 0.0))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))], [*extra, "__lang", "__score"])

    return run


def predict(docs: DataFrame, model: Model | None, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` with __lang and __score for every row."""
    ship(docs.sparkSession)
    base = docs.select(*carry, F.col(text).alias("__text"))
    schema = ", ".join([f"`{c}` {dict(base.dtypes)[c]}" for c in carry] + ["__lang string", "__score double"])
    return base.mapInArrow(over_batches(_score_kernel(model, list(carry))), schema)


def identify(docs: DataFrame, *, folds: int = 4, held: int = 2, text="text", doc_id="doc_id", lang="lang", per_language: int = 500) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from rows outside the held-out fold."""
    model = fit(docs, lambda c: crc_fold(c, folds) != held, text=text, doc_id=doc_id, lang=lang, per_language=per_language)
    out = predict(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return out.select("doc_id", (crc_fold("doc_id", folds) == held).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
