"""Dense vectors that are trained on the corpus: weighted terms, projected on the leading right singular vectors of the term matrix.

A text is a row of ``WIDTH`` buckets of hashed tokens, weighed (1 + ln c) * idf
and of unit length.  The leading ``rank`` directions come from power iteration
on blocks: a round sends the basis (width x (rank + ``MORE``), a fixed number of
megabytes) to the workers, each part of the rows adds up its share of
A'(A Q), the shares are summed strip by strip, and the driver, which never holds
more than that matrix, makes the result orthogonal again.  The rows are read
from a table that is written once, so a round depends on no earlier one.

A text that is null or has no token takes no part in the fit, and has no
vector.  An empty corpus, or one of less rank, gives a basis of fewer columns.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.text import text_of
from siftlake.functions.words import token_lists
from siftlake.shipping import ship
from siftlake.sources.store import kept

#: Buckets of tokens; directions beyond the wanted ones that a round carries along; rounds; buckets of a strip.
WIDTH, MORE, ROUNDS, STRIP = 1 << 14, 8, 8, 64
#: Parts of the rows in a round, each of which sends one matrix; entries of rows, and rows, multiplied at a time; texts cut at a time.
PARTS, ENTRIES, ROWS, TEXTS = 1024, 1 << 16, 256, 1024


def term_rows(texts: Column, rows: DataFrame, key: Column, width: int) -> DataFrame:
    """(key, at, c): the buckets of each text and how often they occur, as 32-bit integers in bytes; texts without a token have none."""

    def run(batches):
        for b in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            lists = token_lists(b.column(1))
            words = pa.compute.dictionary_encode(lists.flatten())
            code = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % width for w in words.dictionary.to_pylist()], np.int64)
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            cell, count = np.unique(row * width + code[words.indices.to_numpy()], return_counts=True)
            row, at = np.divmod(cell, width)
            size = np.bincount(row, minlength=b.num_rows)
            some = size > 0
            offsets = pa.py_buffer(np.concatenate(([0], 4 * np.cumsum(size[some]))).astype(np.int32))
            packed = [pa.Array.from_buffers(pa.binary(), int(some.sum()), [None, offsets, pa.py_buffer(x.astype(np.int32))]) for x in (at, count)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(some)), *packed], ["key", "at", "c"])

    ship(rows.sparkSession)
    return rows.select(key.cast("long").alias("key"), text_of(texts).alias("text")).mapInArrow(run, "key long, at binary, c binary")


def _unpacked(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0 on, numbers) of a column of packed integers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    return offsets - offsets[0], np.frombuffer(column.buffers()[2], np.int32)[offsets[0] : offsets[-1]]


def _weights(batch: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, buckets, weights) of the rows of a batch (key, at, c), each of unit length."""
    if not batch.num_rows:
        return np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0)
    (offsets, at), (_, c) = _unpacked(batch.column(1)), _unpacked(batch.column(2))
    w = (1 + np.log(c)) * idf[at]
    if len(w):
        w = w / np.repeat(np.sqrt(np.add.reduceat(w * w, offsets[:-1])), np.diff(offsets))
    return offsets, at, w


def _slices(offsets: np.ndarray):
    """Ranges of at most ``ROWS`` rows of about ``ENTRIES`` entries, one row at least."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = min(lo + ROWS, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + ENTRIES, side="right")) - 1))
        yield lo, hi
        lo = hi


def _matrix(offsets: np.ndarray, at: np.ndarray, w: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Some rows as a matrix over the buckets that they have, and these; a row has a bucket once."""
    there = np.zeros(width, bool)
    there[at] = True
    buckets = np.flatnonzero(there)
    place = np.cumsum(there) - 1
    rows = np.zeros((len(offsets) - 1, len(buckets)))
    rows[np.repeat(np.arange(len(rows)), np.diff(offsets)), place[at]] = w
    return rows, buckets


@dataclass
class LatentModel:
    """idf of each bucket and the basis (width x rank), columns by falling singular value; values: the singular values."""

    idf: np.ndarray
    basis: np.ndarray
    values: np.ndarray

    def encode(self, rows: DataFrame, key: str, text: Column | str, name: str = "v", terms: DataFrame | None = None) -> DataFrame:
        """(key, v array<double>): unit vectors; texts without a token, or whose tokens the basis does not know, have none.

        terms: what ``term_rows`` gives for the rows, if it is at hand.
        """
        sent = rows.sparkSession.sparkContext.broadcast((self.idf, self.basis))

        def run(batches):
            idf, basis = sent.value
            for b in batches:
                offsets, at, w = _weights(b, idf)
                for lo, hi in _slices(offsets):
                    cut = slice(offsets[lo], offsets[hi])
                    x, buckets = _matrix(offsets[lo : hi + 1], at[cut], w[cut], len(idf))
                    v = x @ basis[buckets]
                    norm = np.sqrt((v * v).sum(1))
                    some = norm > 1e-12
                    v = v[some] / norm[some][:, None]
                    data = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).filter(pa.array(some)), data], [key, name])

        found = term_rows(F.col(text) if isinstance(text, str) else text, rows, F.col(key), len(self.idf)) if terms is None else terms
        return found.mapInArrow(run, f"{key} long, {name} array<double>")


def _share_kernel(sent, width: int):
    """(strip, data): the share of A'(A Q) of a part of the rows."""

    def run(batches):
        idf, basis = sent.value
        total = None
        for b in batches:
            offsets, at, w = _weights(b, idf)
            for lo, hi in _slices(offsets):
                if total is None:
                    total = np.zeros(basis.shape)
                cut = slice(offsets[lo], offsets[hi])
                x, buckets = _matrix(offsets[lo : hi + 1], at[cut], w[cut], width)
                total[buckets] += x.T @ (x @ basis[buckets])
        if total is not None:
            for k in range(0, width, STRIP):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k : k + STRIP].tobytes()], pa.binary())], ["strip", "data"])

    return run


def _held(batches):
    """(at, n): how many rows of a batch have a bucket."""
    for b in batches:
        at, n = np.unique(_unpacked(b.column(0))[1] if b.num_rows else np.zeros(0, np.int32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["at", "n"])


def _sum_strips(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer()) for x in table.column(1))
    return pa.table({"strip": table.column(0)[:1], "data": pa.array([total.tobytes()], pa.binary())})


def train(rows: DataFrame, text: Column | str, rank: int = 64, width: int = WIDTH, rounds: int = ROUNDS, seed: int = 7, terms: DataFrame | None = None) -> LatentModel:
    """The model of a corpus; runs one pass that writes the rows' buckets, if no ``terms`` are given, one that counts them and one for each round."""
    spark = rows.sparkSession
    if terms is None:
        found = term_rows(F.col(text) if isinstance(text, str) else text, rows, F.lit(None), width)
        terms = kept(spark, "terms", uuid.uuid4().hex, lambda: found)
    df = np.zeros(width)
    for r in terms.select("at").mapInArrow(_held, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most ``width`` rows
        df[r["at"]] = r["n"]
    n = terms.count()
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0.0)
    rank = min(rank, int((df > 0).sum()), n)
    if not rank:
        return LatentModel(idf, np.zeros((width, 0)), np.zeros(0))
    carried = min(rank + MORE, int((df > 0).sum()))
    start = np.random.default_rng(seed).normal(size=(width, carried)) * (df > 0)[:, None]
    basis, parts = np.linalg.qr(start)[0], terms.coalesce(PARTS)
    for last in [False] * rounds + [True]:
        sent = spark.sparkContext.broadcast((idf, basis))
        shares = parts.mapInArrow(_share_kernel(sent, width), "strip int, data binary")
        product = np.zeros(basis.shape)
        for r in shares.groupBy("strip").applyInArrow(_sum_strips, "strip int, data binary").collect():  # width / STRIP rows
            product[r.strip : r.strip + STRIP] = np.frombuffer(r.data).reshape(-1, carried)
        sent.destroy()
        if not last:
            basis = np.linalg.qr(product)[0]
    values, turn = np.linalg.eigh(basis.T @ product)
    order = np.argsort(-values)[:rank]
    order = order[values[order] > 1e-9 * max(values.max(), 1e-300)]
    basis = basis @ turn[:, order]
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(len(order))])
    return LatentModel(idf, basis, np.sqrt(values[order]))
