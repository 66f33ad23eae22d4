"""Toxicity by weak supervision.

Voters are lexicons and patterns.  The lexicons hold words (and word heads)
that mark toxic rows among the labelled rows, dealt into several lists so that
each list is a voter that can be right or wrong on its own; pattern voters look
at how many marked words there are, how dense they are, at shouting, symbols
and repetition.  A voter says toxic, clean or nothing.

A generative label model explains the votes by a hidden class: expectation
maximisation gives each voter's accuracy, correlations that the hidden class
leaves over are estimated from the residuals, and correlated voters share
their weight.  Its posterior labels train a linear (logistic) classifier,
which alone gives the score.

Fitting takes place on the driver from at most ``per_class`` labelled rows of
each class (in the order of a hash of the id).  Where that cuts a class, its
rows weigh as many as they stand for in the label model, the prior and the
classifier, so that the prior is the toxic share of all labelled rows at every
size.  All rows are scored map-only.
Labels, language, source and id are never inputs of a score.

Defined results: null or empty text is scored by its features (all 0);
repeated rows are scored one by one; labels that repeat an id count as toxic if
any of them is; null labels and ids are not learned from; without any labelled
row of both classes every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, crc_fold, least_per_group, mix, over_batches, prefix_hash, ship, slices, span_hash, text_bytes
from .language_id import LETTER, folded
from .linear import Rows, logistic, sigmoid

#: Bytes of a word's head; lists that the words are dealt into; most words and heads.
HEAD, LISTS, MOST_WORDS, MOST_HEADS = 6, 6, 300, 40
#: A marking word is this many times likelier in toxic rows, and this unlikely by chance (G statistic).
RATIO, SURE = 6.0, 18.0


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """(folded bytes, start, end, row) of runs of letters."""
    data = folded(data)
    solid = LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return data, start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """(fingerprints of words, of their heads, row)."""
    data, start, end, row = word_spans(data, offsets)
    p = prefix_hash(data)
    head = span_hash(p, start, np.minimum(start + HEAD, end))
    return span_hash(p, start, end), np.where(end - start > HEAD, mix(head + U64(1)), U64(0)), row


def shape(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row: words, share of capitals, of symbols, of repeated neighbours (columns)."""
    n = len(offsets) - 1

    def count(flags):
        upto = np.concatenate(([0], np.cumsum(flags)))
        return upto[offsets[1:]] - upto[offsets[:-1]]

    size = np.maximum(1, np.diff(offsets))
    letters = np.maximum(1, count(LETTER[folded(data)]))
    capitals = count((data >= 65) & (data <= 90)) / letters
    symbols = count(np.isin(data, np.frombuffer(b"#$%&*!|<>{}=", np.uint8))) / size
    words, _, row = word_hashes(data, offsets)
    total = np.bincount(row, minlength=n)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    repeated = np.bincount(row[same], minlength=n) / np.maximum(1, total)
    return np.stack([total, capitals, symbols, repeated], 1).astype(float)


def _count_kernel(batches):
    """(class, fingerprint, kind) once per row of text."""
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        label = np.array(b.column(0).to_pylist(), np.int64)
        for lo, hi in slices(offsets):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            w, h, row = word_hashes(part, at)
            for k, x in ((0, w), (1, h)):
                pairs = np.unique(np.stack([x, row.astype(U64)], 1)[x != 0], axis=0)
                y = label[lo:hi][pairs[:, 1].astype(np.int64)]
                key, back = np.unique(pairs[:, 0], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), k, np.int32)), pa.array(key.view(np.int64)), pa.array(np.bincount(back, y == 1, len(key)).astype(np.int64)), pa.array(np.bincount(back, y == 0, len(key)).astype(np.int64))],
                    ["kind", "key", "toxic", "clean"],
                )


def _marking(counts: DataFrame, toxic: int, clean: int):
    """The words and heads that mark toxic rows, best first."""
    def part(k, e):
        return F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / e)).otherwise(0.0)

    n = toxic + clean
    seen = F.col("toxic") + F.col("clean")
    g = 2 * (part("toxic", seen * (toxic / n)) + part("clean", seen * (clean / n)))
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    found = counts.filter("toxic >= 3").withColumns({"g": g, "ratio": ratio}).filter((F.col("ratio") >= RATIO) & (F.col("g") >= SURE))
    words = found.filter("kind = 0").orderBy(F.desc("g"), "key").limit(MOST_WORDS).select("key").collect()
    heads = found.filter("kind = 1").orderBy(F.desc("g"), "key").limit(MOST_HEADS).select("key").collect()
    return [np.array([r.key for r in x], np.int64).view(U64) for x in (words, heads)]


class Voters:
    """Votes (1 toxic, -1 clean, 0 nothing) and features of rows, from the marking words and heads."""

    def __init__(self, words: np.ndarray, heads: np.ndarray):
        self.words, self.heads = np.sort(words), np.sort(heads)
        rank = {int(w): k for k, w in enumerate(words)}
        self.list_of = np.array([rank[int(w)] % LISTS for w in self.words], np.int64)
        self.width = len(words) + len(heads) + 7

    def hits(self, data, offsets):
        w, h, row = word_hashes(data, offsets)
        out = []
        for x, known in ((w, self.words), (h, self.heads)):
            if not len(known) or not len(x):
                out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            ok = known[at] == x
            out.append((row[ok], at[ok]))
        return out

    def see(self, data, offsets) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        n = len(offsets) - 1
        form = shape(data, offsets)
        (wr, wk), (hr, hk) = self.hits(data, offsets)
        lists = np.zeros((n, LISTS))
        np.add.at(lists, (wr, self.list_of[wk]), 1)
        total, heads = lists.sum(1), np.bincount(hr, minlength=n)
        kinds = np.bincount(np.unique(np.stack([wr, wk], 1), axis=0)[:, 0], minlength=n) if len(wr) else np.zeros(n)
        dense = total / np.maximum(1, form[:, 0])
        votes = np.concatenate([
            np.where(lists > 0, 1, 0),
            np.stack([
                np.where(total >= 2, 1, np.where(total == 0, -1, 0)),
                np.where(kinds >= 2, 1, np.where(kinds == 0, -1, 0)),
                np.where(heads >= 2, 1, np.where(heads == 0, -1, 0)),
                np.where(dense >= 0.004, 1, np.where(dense < 0.0005, -1, 0)),
                np.where((form[:, 1] > 0.5) & (total > 0), 1, 0),
                np.where((form[:, 3] > 0.3) & (total == 0), -1, 0),
                np.where((form[:, 2] > 0.1) & (total == 0), -1, 0),
            ], 1)], 1).astype(np.int8)
        base = len(self.words) + len(self.heads)
        extra = np.stack([np.log1p(total), np.minimum(kinds, 4), np.log1p(heads), 100 * dense, form[:, 1], form[:, 2], form[:, 3]], 1)
        extra[:, 3] = np.minimum(extra[:, 3], 5)
        rows = []
        key = np.concatenate([wk, len(self.words) + hk])
        row = np.concatenate([wr, hr])
        order = np.argsort(row, kind="stable")
        key, first = key[order], np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))
        for r in range(n):
            k, c = np.unique(key[first[r] : first[r + 1]], return_counts=True) if first[r] < first[r + 1] else (key[:0], key[:0])
            rows.append((np.concatenate([k, base + np.arange(7)]), np.concatenate([np.log1p(c), extra[r]])))
        return votes, rows


class LabelModel:
    """Hidden class and voters: expectation maximisation, then a discount for correlated voters."""

    def __init__(self, votes: np.ndarray, prior: float, rounds: int = 60, weight: np.ndarray | None = None):
        kinds, back = np.unique(votes, axis=0, return_inverse=True)
        counts = np.bincount(back.ravel(), weight, len(kinds))
        m = votes.shape[1]
        score = (kinds > 0).sum(1) - 0.5 * (kinds < 0).sum(1)
        q = sigmoid(2.0 * score)
        self.weight = np.ones(m)
        self.table = np.full((2, m, 3), 1 / 3)
        for step in range(rounds):
            for c, r in ((1, q * counts), (0, (1 - q) * counts)):
                for v in (-1, 0, 1):
                    self.table[c, :, v + 1] = (r @ (kinds == v) + 0.5) / (r.sum() + 1.5)
            if step == rounds // 2:
                self.weight = self.shares(kinds, counts, q)
            q = self.posterior(kinds, prior)
        self.prior = prior
        self.accuracy = np.array([(prior * self.table[1, j, 2] + (1 - prior) * self.table[0, j, 0]) / max(1e-9, prior * (1 - self.table[1, j, 1]) + (1 - prior) * (1 - self.table[0, j, 1])) for j in range(m)])

    def shares(self, kinds, counts, q) -> np.ndarray:
        """1 / (1 + sum of squared correlations with the other voters that the class doesn't explain)."""
        mean = {c: self.table[c] @ np.array([-1.0, 0.0, 1.0]) for c in (0, 1)}
        cov, n = np.zeros((kinds.shape[1],) * 2), counts.sum()
        for c, r in ((1, q * counts), (0, (1 - q) * counts)):
            d = kinds - mean[c]
            cov += (d * r[:, None]).T @ d / n
        s = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        self.correlation = cov / np.outer(s, s)
        np.fill_diagonal(self.correlation, 0)
        return 1 / (1 + (self.correlation**2).sum(1))

    def posterior(self, votes: np.ndarray, prior: float | None = None) -> np.ndarray:
        prior = self.prior if prior is None else prior
        log = np.log(self.table[1] / self.table[0])
        z = np.log(prior / (1 - prior)) + sum(self.weight[j] * log[j, votes[:, j].astype(int) + 1] for j in range(votes.shape[1]))
        return sigmoid(z)


def _see_kernel(voters):
    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for lo, hi in slices(offsets):
                votes, rows = voters.see(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([v.tobytes() for v in votes], pa.binary()), pa.array([c.tolist() for c, _ in rows], pa.list_(pa.int64())), pa.array([v.tolist() for _, v in rows], pa.list_(pa.float64()))], ["toxic", "votes", "columns", "counts"])

    return run


class Model:
    def __init__(self, voters: Voters, label_model: LabelModel, weights: np.ndarray):
        self.voters, self.label_model, self.weights = voters, label_model, weights

    def score(self, data, offsets) -> np.ndarray:
        _, rows = self.voters.see(data, offsets)
        return sigmoid(Rows.of(rows, self.voters.width).dot(self.weights[:-1]) + self.weights[-1])


def fit(docs: DataFrame, labels: DataFrame, train, *, text="text", doc_id="doc_id", toxic="toxic", per_class: int = 4000) -> Model | None:
    """A model from labelled rows for which ``train`` (of the id) holds; None without rows of both classes."""
    ship(docs.sparkSession)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(train("doc_id"))
    marks = marks.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    totals = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return None
    picked = least_per_group(marks, "toxic", "doc_id", per_class).select("doc_id", "toxic")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")  # of rows that repeat an id, so that rows are as bounded as ids
    rows = base.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(one).select("toxic", "one.text")
    counts = rows.mapInArrow(over_batches(_count_kernel), "kind int, key long, toxic long, clean long").groupBy("kind", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    voters = Voters(*_marking(counts, min(per_class, totals[1]), min(per_class, totals[0])))
    seen = rows.mapInArrow(over_batches(_see_kernel(voters)), "toxic int, votes binary, columns array<long>, counts array<double>").collect()
    fitted = {c: sum(r.toxic == c for r in seen) for c in (0, 1)}
    if not min(fitted.values()):  # labelled ids need not be among the documents
        return None
    seen = sorted((bytes(r.votes), tuple(r.columns), tuple(r.counts), r.toxic) for r in seen)
    votes = np.stack([np.frombuffer(r[0], np.int8) for r in seen])
    toxic_row = np.array([r[3] for r in seen], bool)
    weight = np.where(toxic_row, *(totals[c] / fitted[c] for c in (1, 0)))
    prior = float(np.clip(np.average(toxic_row, weights=weight), 1e-6, 1 - 1e-6))
    weight /= weight.mean()
    model = LabelModel(votes, prior, weight=weight)
    x = Rows.of([(np.array(r[1], np.int64), np.array(r[2])) for r in seen], voters.width)
    return Model(voters, model, logistic(x, model.posterior(votes), 1e-3, weight))


def _score_kernel(model, names):
    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(b.num_columns - 1))
            out = [np.zeros(0)]
            for lo, hi in slices(offsets):
                out.append(model.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) if model else np.zeros(hi - lo))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(out))], [*names, "__score"])

    return run


def predict(docs: DataFrame, model: Model | None, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` with __score (0 to 1) for every row."""
    ship(docs.sparkSession)
    base = docs.select(*carry, F.col(text).alias("__text"))
    schema = ", ".join([f"`{c}` {dict(base.dtypes)[c]}" for c in carry] + ["__score double"])
    return base.mapInArrow(over_batches(_score_kernel(model, list(carry))), schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held: int = 0, text="text", doc_id="doc_id", per_class: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns labels from rows outside the held-out fold."""
    model = fit(docs, labels, lambda c: crc_fold(c, folds) != held, text=text, doc_id=doc_id, per_class=per_class)
    out = predict(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return out.select("doc_id", (crc_fold("doc_id", folds) == held).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
