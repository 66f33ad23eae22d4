"""Exact top-k inner-product search by three-phase uniform threshold.

Queries and vectors are dealt into blocks of bounded size; each pair of blocks
is one task's work, so neither side is ever in one place.  A vector's
dimensions are cut into m slices, whose partial products are the local score
lists.

1. Gather: every query meets one block in ``GATHER``.  The k best of each
   slice's list there are looked up whole, and the k best of these reported.
   The k-th best of all reports is a safe cutoff: at least k vectors reach it,
   wherever the lists that were asked lie.
2. Collect: the cutoff goes back with the queries, which now meet every block.  A
   vector whose score reaches the cutoff has a slice that reaches cutoff / m (the
   uniform threshold); only the entries over it in some list are taken.
3. Resolve: the slices of the entries taken are added up; those at or above the
   cutoff, k per block and query at most, meet in the final ranking.

Scores are integers: component x counts as floor(scale * x).

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows without an id; vectors of another length
than the query's are no candidates; rows that repeat an id are candidates each,
but a query is asked once (its least vector) and never finds rows of its own
id; ties go to the smaller id; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, over_cogroup, over_group

#: Vectors and queries in a block; rows of a block that a product takes at once.
BLOCK, QUERY_BLOCK, STRIP = 8192, 2048, 256
SLICES = 4
#: One block of so many is asked for the cutoff.
GATHER = 8


def usable(vector: str):
    """True for vectors without null, nan or infinite components."""
    c = F.col(vector)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(c) > 0) & ~bad, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64).reshape(-1, width)


def _pack_kernel(scale, with_cut):
    """Blocks of a group: one row per vector length."""

    def run(table: pa.Table) -> pa.Table:
        length = np.array(table.column("width").to_pylist(), np.int64)
        out = []
        for width in np.unique(length).tolist():
            part = table.filter(pa.array(length == width))
            ids = np.array(part.column("vec_id").to_pylist(), np.int64)
            rows = np.floor(scale * matrix(part.column("vector"), width))
            cut = np.array([-(1 << 62) if x is None else x for x in part.column("cut").to_pylist()], np.int64) if with_cut else np.zeros(0, np.int64)
            out.append((table.column("block")[0].as_py(), width, ids.tobytes(), rows.tobytes(), cut.tobytes()))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "width", "ids", "rows", "cut"])

    return run


def _pairs(left: pa.Table, right: pa.Table):
    """(query ids, query rows, cutoffs, ids, rows) of the blocks with equal vector length, exact in the type given."""
    for q in right.to_pylist():
        for c in left.to_pylist():
            if c["width"] != q["width"]:
                continue
            ids, qids = np.frombuffer(c["ids"], np.int64), np.frombuffer(q["ids"], np.int64)
            x, y = np.frombuffer(c["rows"]).reshape(len(ids), -1), np.frombuffer(q["rows"]).reshape(len(qids), -1)
            most = np.sqrt((x * x).sum(1).max(initial=0) * (y * y).sum(1).max(initial=0))
            kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64
            yield qids, y.astype(kind), np.frombuffer(q["cut"], np.int64), ids, x.astype(kind)


def _slices(width: int) -> list[slice]:
    cut = [width * k // min(SLICES, width) for k in range(min(SLICES, width) + 1)]
    return [slice(a, b) for a, b in zip(cut, cut[1:], strict=False)]


def _gather_kernel(k):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        qs, tops = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for qids, y, _, ids, x in _pairs(left, right):
            for at in range(0, len(qids), STRIP):
                part, own = y[at : at + STRIP], qids[at : at + STRIP]
                lists = [part[:, s] @ x[:, s].T for s in _slices(x.shape[1])]
                same = own[:, None] == ids[None, :]
                for scores in lists:
                    scores[same] = np.iinfo(np.int64).min // 8 if scores.dtype.kind == "i" else -np.inf
                n = min(k, len(ids))
                seen = np.concatenate([np.argpartition(-scores, n - 1, 1)[:, :n] for scores in lists], 1)
                for r in range(len(part)):
                    some = np.unique(seen[r])
                    some = some[~same[r, some]]
                    best = np.sort(sum(scores[r, some] for scores in lists))[::-1][:k]
                    qs.append(np.full(len(best), own[r]))
                    tops.append(best.astype(np.int64))
        return pa.table([pa.array(np.concatenate(qs)), pa.array(np.concatenate(tops))], ["query_id", "score"])

    return run


def over_threshold(lists: list[np.ndarray], cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the entries that reach cutoff / m in some list and the cutoff in all."""
    uniform = -((-cutoff) // len(lists))  # rounded up
    taken = np.zeros(lists[0].shape, bool)
    for scores in lists:
        taken |= scores >= uniform[:, None].astype(np.float64)
    row, column = np.nonzero(taken)
    score = sum(scores[row, column] for scores in lists).astype(np.int64)
    ok = score >= cutoff[row]
    return row[ok], column[ok], score[ok]


def _resolve_kernel(k):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        for qids, y, cut, ids, x in _pairs(left, right):
            parts = _slices(x.shape[1])
            for at in range(0, len(qids), STRIP):
                row, column, score = over_threshold([y[at : at + STRIP, s] @ x[:, s].T for s in parts], cut[at : at + STRIP])
                ok = ids[column] != qids[at + row]
                row, column, score = row[ok], column[ok], score[ok]
                order = np.lexsort((ids[column], -score, row))
                row, column, score = row[order], column[order], score[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append(np.stack([qids[at + row[best]], ids[column[best]], score[best]], 1))
        found = np.concatenate(out)
        return pa.table([pa.array(found[:, j]) for j in range(3)], ["query_id", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, is_query, *, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row for which ``is_query`` (of the id column) holds."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "exact-topk")
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    base = base.filter(F.col("vec_id").isNotNull() & usable("vector")).withColumn("width", F.size("vector"))
    asked = base.filter(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("width", F.size("vector"))
    n = base.count()
    blocks, query_blocks = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(asked.count() / QUERY_BLOCK))
    packed = "block int, width int, ids binary, rows binary, cut binary"
    deal = lambda d, m, salt: d.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int"))
    corpus = scratch.keep(deal(base, blocks, 1).groupBy("block").applyInArrow(over_group(_pack_kernel(scale, False)), packed))
    corpus = corpus.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def meet(queries, kernel, schema, with_cut, every):
        own = corpus.filter(F.col("block") % every == 0)
        q = deal(queries, query_blocks, 2).groupBy("block").applyInArrow(over_group(_pack_kernel(scale, with_cut)), packed)
        q = q.withColumnRenamed("block", "q").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1), F.lit(every))))
        return own.groupBy("q", "block").cogroup(q.groupBy("q", "block")).applyInArrow(over_cogroup(kernel), schema)

    lists = meet(asked, _gather_kernel(k), "query_id long, score long", False, GATHER)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    cutoff = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).filter(F.col("rank") == k)
    cutoff = scratch.keep(cutoff.select(F.col("query_id").alias("vec_id"), F.col("score").alias("cut")))
    found = meet(asked.join(cutoff, "vec_id", "left"), _resolve_kernel(k), "query_id long, vec_id long, score long", True, 1)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
