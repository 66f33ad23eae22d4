"""Stated query sets against all vectors, block by block: exact dense search with balls, blends, ranks and quantiles.

A block is a bounded set of vectors, a part a bounded set of queries; they meet
under an equi-join key (block, part), as matrices, so no row stands for a pair.
``VectorBlocks`` groups vectors that lie together, keeps a ball (centre and
radius) around each block, and a search reads only the blocks whose ball can
hold a score as good as the k-th best found in the nearest ones.  ``Grid``
meets every block: a first pass gives the extremes of each query's scores and
its best lexical ones, a second blends and keeps k rows, a third counts what
lies ahead of a given score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.operators.lexical_index import RANGE, Asked, Bm25Index, Postings, best_of_block, chunks, empty, listed, tokens_asked
from siftlake.shipping import ship
from siftlake.sources.store import kept, written

#: Vectors of a block, cells that blocks are cut from, queries of a part, heads that meet a part of the queries at once.
BLOCK, CELLS, QUERIES, HEADS = 1024, 64, 512, 4096
#: Queries of a part of a grid, and its cells from which on a cell holds up to four ranges.
GRID_QUERIES, GRID_CELLS = 1 << 14, 64
#: Blocks that give a query's first threshold; what a bound may lack by rounding.
FIRST, SLACK = 2, 1e-6


def usable(rows: DataFrame, key: str, vector: str, *more: str, kind: str = "double") -> DataFrame:
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"), *more)
    return own.filter("id is not null and v is not null and not exists(v, x -> x is null)")


def matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, data = len(lists), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(data) // n if n else 0
    if n and (len(data) != width * n or np.any(np.diff(lists.offsets.to_numpy()) != width)):
        raise ValueError("vectors must have one length")
    return data.reshape(n, width)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best scores of each row, -inf apart; ties go to the smaller id."""
    n = min(k, scores.shape[1])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
    row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first]


def parts_of(queries: DataFrame, key: str, size: int = QUERIES) -> tuple[DataFrame, int]:
    """The queries dealt into parts of about ``size``."""
    parts = max(1, -(-queries.count() // size))
    return queries.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), parts


# ---------------------------------------------------------------- balls


@dataclass
class VectorBlocks:
    """blocks (block, n, ids, data) and heads (block, n, centre, radius: one for each number of leading components)."""

    blocks: DataFrame
    heads: DataFrame
    dims: tuple[int, ...]


def _cell_kernel(pivots: np.ndarray):
    half = (pivots * pivots).sum(1) / 2

    def run(batches):
        for b in batches:
            x = matrix(b.column(1))
            cell = (x @ pivots.T - half).argmax(1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    return run


def _pack_kernel(dims):
    def run(batches):
        key, ids, rows = None, [], []

        def packed():
            x, own = np.concatenate(rows), np.concatenate(ids)
            centre = x.mean(0)
            radius = [float(np.sqrt(((x[:, : d or None] - centre[: d or None]) ** 2).sum(1).max())) for d in dims]
            return pa.RecordBatch.from_arrays([pa.array([len(own)]), pa.array([own.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([centre.tolist()]), pa.array([radius])], ["n", "ids", "data", "centre", "radius"])

        for b in batches:
            x, own = matrix(b.column(1)), b.column(0).to_numpy()
            place = b.column(2).to_numpy().astype(np.int64) << 32 | b.column(3).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(place) != 0, [True]))) if len(place) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if place[lo] != key and rows:
                    yield packed()
                    ids, rows = [], []
                key = place[lo]
                while lo < hi:
                    step = min(hi, lo + BLOCK - sum(map(len, ids)))
                    ids.append(own[lo:step])
                    rows.append(x[lo:step])
                    lo = step
                    if sum(map(len, ids)) == BLOCK:
                        yield packed()
                        ids, rows = [], []
        if rows:
            yield packed()

    return run


def vector_blocks(vectors: DataFrame, name: str, state: str, dims: tuple[int, ...] = (0,)) -> VectorBlocks:
    """Blocks of (corpus_idx, v), kept; cells follow the nearest of 64 vectors drawn by hash, and are cut by id where they are large."""
    spark = vectors.sparkSession
    ship(spark)
    clean = usable(vectors, "corpus_idx", "v")

    def build():
        pivots = clean.orderBy(F.xxhash64("id"), "id").limit(CELLS).collect()
        if not pivots:
            return spark.createDataFrame([], "n long, ids binary, data binary, centre array<double>, radius array<double>, block long")
        placed = clean.mapInArrow(_cell_kernel(np.array([r.v for r in pivots])), "id long, v array<double>, cell int")
        sizes = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}  # 64 rows at most
        cuts = F.array(*[F.lit(max(1, -(-sizes.get(c, 0) // BLOCK))) for c in range(CELLS)])
        dealt = placed.withColumn("sub", F.pmod(F.xxhash64("id"), F.element_at(cuts, F.col("cell") + 1)).cast("int"))
        dealt = dealt.repartition("cell", "sub").sortWithinPartitions("cell", "sub", "id").select("id", "v", "cell", "sub")
        return dealt.mapInArrow(_pack_kernel(dims), "n long, ids binary, data binary, centre array<double>, radius array<double>").withColumn("block", F.monotonically_increasing_id())

    table = kept(spark, f"{name}-vectors-{dims}", state, build)
    return VectorBlocks(table.select("block", "n", "ids", "data"), table.select("block", "n", "centre", "radius"), dims)


def _bound_kernel(views: dict[str, int], dims: tuple[int, ...], most: int | None):
    """Heads and queries of a cell of the grid: pairs (view, query_id, block) whose bound reaches the query's threshold, or the ``most`` best."""

    def run(rows):
        is_head = pa.compute.is_null(rows.column("query_id"))
        heads, asked = rows.filter(is_head), rows.filter(pa.compute.invert(is_head))
        out = [[] for _ in range(5)]
        if heads.num_rows and asked.num_rows:
            c, q = matrix(heads.column("v")), matrix(asked.column("v"))
            if c.shape[1] != q.shape[1]:
                raise ValueError("vectors must have one length")
            radius, cut = matrix(heads.column("more")), matrix(asked.column("more"))
            block, n, qid = (t.column(x).to_numpy() for t, x in ((heads, "block"), (heads, "n"), (asked, "query_id")))
            for k, (name, d) in enumerate(views.items()):
                y = q[:, : d or None]
                bound = y @ c[:, : d or None].T + np.sqrt((y * y).sum(1))[:, None] * radius[:, dims.index(d)][None, :] + SLACK
                row, column = best(bound, block, most) if most else np.nonzero(bound >= cut[:, k][:, None])
                for x, own in zip(out, (np.full(len(row), name), qid[row], block[column], bound[row, column], n[column]), strict=True):
                    x.append(own)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, kinds, strict=True)], ["view", "query_id", "block", "bound", "n"])

    return run


def _score_kernel(views: dict[str, int], k: int, others_only: bool, at: int):
    def run(rows):
        is_block = pa.compute.is_null(rows.column("query_id"))
        packs, asked = rows.filter(is_block), rows.filter(pa.compute.invert(is_block))
        out = [[] for _ in range(4)]
        if packs.num_rows and asked.num_rows:
            ids = np.frombuffer(packs.column("ids")[0].as_py(), np.int64)
            x = np.frombuffer(packs.column("data")[0].as_py()).reshape(len(ids), -1)
            qid, q = asked.column("query_id").to_numpy(), matrix(asked.column("v"))
            wanted = asked.column("views").to_pylist()
            for name, d in views.items():
                own = np.array([name in w for w in wanted])
                scores = np.round(q[own][:, : d or None] @ x[:, : d or None].T, at)
                if others_only:
                    scores[qid[own][:, None] == ids[None, :]] = -np.inf
                row, column = best(scores, ids, k)
                for o, part in zip(out, (np.full(len(row), name), qid[own][row], ids[column], scores[row, column]), strict=True):
                    o.append(part)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, kinds, strict=True)], ["view", "query_id", "corpus_idx", "score"])

    return run


class DenseSearch:
    """The k best inner products of (query_id, q) in the blocks, by view (a number of leading components, 0 for all)."""

    def __init__(self, found: VectorBlocks, queries: DataFrame, k: int, views: dict[str, int], others_only: bool = False, at: int = 9):
        self.found, self.k, self.views, self.others_only, self.at = found, k, views, others_only, at
        asked = usable(queries, "query_id", "q").select(F.col("id").alias("query_id"), "v").dropDuplicates(["query_id"])
        self.asked, self.parts = parts_of(asked, "query_id")
        self.head_parts = max(1, -(-found.heads.count() // HEADS))

    def _grid(self, queries: DataFrame, most: int | None) -> DataFrame:
        """queries: with ``more``, the thresholds by view."""
        row = lambda d, **named: d.select(*[named.get(c, F.lit(None).cast(t)).alias(c) for c, t in (("hp", "int"), ("part", "int"), ("query_id", "long"), ("block", "long"), ("n", "long"), ("v", "array<double>"), ("more", "array<double>"))])
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        heads = self.found.heads.withColumn("hp", F.pmod(F.xxhash64("block"), F.lit(self.head_parts)).cast("int")).withColumn("part", every(self.parts))
        left = row(heads, hp=F.col("hp"), part=F.col("part"), block=F.col("block"), n=F.col("n"), v=F.col("centre"), more=F.col("radius"))
        q = queries.withColumn("hp", every(self.head_parts))
        right = row(q, hp=F.col("hp"), part=F.col("part"), query_id=F.col("query_id"), v=F.col("v"), more=F.col("more"))
        return left.union(right).groupBy("hp", "part").applyInArrow(_bound_kernel(self.views, self.found.dims, most), "view string, query_id long, block long, bound double, n long")

    def _scored(self, pairs: DataFrame) -> DataFrame:
        wanted = pairs.groupBy("query_id", "block").agg(F.collect_set("view").alias("views")).join(self.asked, "query_id")
        used = wanted.select("block", "part").distinct()
        none = lambda t: F.lit(None).cast(t)
        left = self.found.blocks.join(used, "block").select("block", "part", "ids", "data", none("long").alias("query_id"), empty("double").alias("v"), empty("string").alias("views"))
        right = wanted.select("block", "part", none("binary").alias("ids"), none("binary").alias("data"), "query_id", "v", "views")
        return left.union(right).groupBy("block", "part").applyInArrow(_score_kernel(self.views, self.k, self.others_only, self.at), "view string, query_id long, corpus_idx long, score double")

    def _ranked(self, scores: DataFrame) -> DataFrame:
        w = Window.partitionBy("view", "query_id").orderBy(F.desc("score"), "corpus_idx")
        return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= self.k)

    def surviving(self) -> DataFrame:
        """(view, query_id, block, bound, n): the pairs that have to be multiplied."""
        most = FIRST + -(-self.k // BLOCK)
        open_ = self.asked.withColumn("more", F.array(*[F.lit(float("-inf"))] * len(self.views)))
        w = Window.partitionBy("view", "query_id").orderBy(F.desc("bound"), "block")
        nearest = self._grid(open_, most).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= most)
        least = self._ranked(self._scored(nearest)).filter(F.col("rank") == self.k)
        cuts = least.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("view", "score"))).alias("cut"))
        cut = F.array(*[F.coalesce(F.element_at("cut", F.lit(name)), F.lit(float("-inf"))) for name in self.views])
        return self._grid(self.asked.join(cuts, "query_id", "left").withColumn("more", cut), None)

    def topk(self) -> DataFrame:
        """(view, query_id, corpus_idx, score, rank)."""
        return self._ranked(self._scored(self.surviving()))


# ---------------------------------------------------------------- every block


class Cell:
    """The documents of one cell of a ``Grid`` and the queries that it meets; matrices are made for some queries at a time."""

    def __init__(self, rows: pa.Table, avgdl: float, units: dict[str, tuple[int, int | None]]):
        self.units = units
        kind = rows.column("kind").to_numpy(zero_copy_only=False)
        docs, self.asked, blocks = (rows.filter(pa.array(kind == k)) for k in (0, 1, 2))
        self.ids, self.label = docs.column("id").to_numpy(), docs.column("label").to_numpy(zero_copy_only=False)
        self.x = self.vectors(docs)
        self.postings = Postings(listed(blocks), avgdl, self.ids) if blocks.num_rows and len(self.ids) else None

    def vectors(self, rows: pa.Table) -> np.ndarray:
        """The vectors of rows; the part of each of ``units`` is brought to length one."""
        x = matrix(rows.column("v"))
        for lo, hi in self.units.values():
            size = np.sqrt((x[:, lo:hi] * x[:, lo:hi]).sum(1))[:, None]
            x[:, lo:hi] /= np.where(size > 0, size, 1.0)
        return x

    def parts(self):
        return (self.asked.slice(lo, hi - lo) for lo, hi in chunks(self.asked.num_rows, len(self.ids)))


class Scores:
    """Matrices of a ``Cell`` and some of its queries: dense by view and lexical, both rounded, of qids against ids."""

    def __init__(self, cell: Cell, asked: pa.Table, at: int, views: dict[str, tuple[int, int | None]]):
        self.ids, self.label = cell.ids, cell.label
        self.qids, self.qlabel = asked.column("id").to_numpy(), asked.column("label").to_numpy(zero_copy_only=False)
        self.more = asked.column("more").to_pylist()
        self.some = bool(len(self.ids) and len(self.qids))
        self.views: dict[str, np.ndarray] = {}
        if self.some:
            x, y = cell.x, cell.vectors(asked)
            self.views = {name: np.round(y[:, lo:hi] @ x[:, lo:hi].T, at) for name, (lo, hi) in views.items()}
        self.dense = next(iter(self.views.values()), np.zeros((0, 0)))
        self.lexical = np.zeros((len(self.qids), len(self.ids)))
        if self.some and cell.postings is not None:
            tok, row, w = tokens_asked(asked)
            self.lexical = np.round(cell.postings.scores(cell.postings.known(tok), row, w, len(self.qids)), at)

    def gold(self) -> np.ndarray:
        """Whether a document has the query's label and is not the query itself."""
        return (self.qlabel[:, None] == self.label[None, :]) & (self.qids[:, None] != self.ids[None, :])


class Grid:
    """All vectors (corpus_idx, v, label) against a stated query set (query_id, q, label), and their tokens (query_id, tok, m) if there is an index.

    Ranges of ids are dealt into as many cells as there are ranges, or a fourth
    of it where there are many, so cells have numbers from 0 on and a query goes
    to each of them without a join.  A query is one row with its tokens.
    Rows of one id are expected once.  views: parts of the vectors, (first
    component, end), that are compared each for itself.  counts: vectors are
    whole numbers, written and sent as such; each view's part of them is brought
    to length one where it is compared.
    """

    def __init__(self, vectors: DataFrame, queries: DataFrame, index: Bm25Index | None = None, asked: DataFrame | None = None, at: int = 9, views: dict[str, tuple[int, int | None]] | None = None, counts: bool = False):
        ship(vectors.sparkSession)
        self.views = views or {"all": (0, None)}
        self.units, self.kind = (self.views, "int") if counts else ({}, "double")
        label = lambda d: F.col("label").cast("double") if "label" in d.columns else F.lit(None).cast("double")
        docs = usable(vectors.withColumn("label", label(vectors)), "corpus_idx", "v", "label", kind=self.kind).withColumn("range", F.floor(F.col("id") / RANGE))
        self.docs = written(docs)  # every pass reads them: vectors made of texts are made once
        self.ranges = written(self.docs.select("range").distinct())
        ranges = self.ranges.count()
        self.cells = max(1, min(ranges, max(GRID_CELLS, ranges // 4)))
        q = usable(queries.withColumn("label", label(queries)), "query_id", "q", "label", kind=self.kind)
        self.index, self.at = index, at
        if index is not None:
            found = Asked.of(index, asked)
            self.blocks = found.blocks
            q = written(q.join(found.queries.withColumnRenamed("query_id", "id"), "id", "left"))
        self.queries, self.parts = parts_of(q, "id", GRID_QUERIES)

    def rows(self, more: DataFrame | None = None) -> DataFrame:
        """What is sent to the cells: documents, queries and blocks; no array is null (see ``empty``)."""
        columns = (("cell", "int"), ("part", "int"), ("kind", "int"), ("id", "long"), ("label", "double"), ("v", f"array<{self.kind}>"), ("toks", "array<string>"), ("ws", "array<double>"), ("tok", "string"), ("data", "binary"), ("more", "array<double>"))
        value = lambda d, c, t: F.coalesce(F.col(c).cast(t) if c in d.columns else F.lit(None).cast(t), empty(t[6:-1])) if t.startswith("array") else (F.col(c) if c in d.columns else F.lit(None)).cast(t)
        row = lambda d, kind: d.select(*[(F.lit(kind) if c == "kind" else value(d, c, t)).alias(c) for c, t in columns])
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        own = F.pmod(F.xxhash64("range"), F.lit(self.cells))
        q = self.queries if more is None else self.queries.join(more, "id")
        rows = row(self.docs.withColumn("cell", own).withColumn("part", numbers(self.parts)), 0).union(row(q.withColumn("cell", numbers(self.cells)), 1))
        if self.index is not None:
            blocks = self.blocks.join(self.ranges, "range", "left_semi").withColumn("cell", own).withColumn("part", numbers(self.parts))
            rows = rows.union(row(blocks, 2))
        return rows

    def over(self, kernel, schema: str, more: DataFrame | None = None) -> DataFrame:
        """kernel(Scores) -> columns, for every cell; more: (id, more array<double>) that goes with a query."""
        rows, at, views, units = self.rows(more), self.at, self.views, self.units
        avgdl = 1.0 if self.index is None else self.index.avgdl
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
        types = [kinds[x.split()[1]] for x in schema.split(", ")]

        def run(table):
            cell = Cell(table, avgdl, units)
            found = [pa.table([pa.array([], t) for t in types], names)]
            for asked in cell.parts():
                out = kernel(Scores(cell, asked, at, views))
                found.append(pa.table([pa.array(np.asarray(c) if len(c) else [], t) for c, t in zip(out, types, strict=True)], names))
            return pa.concat_tables(found)

        return rows.groupBy("cell", "part").applyInArrow(run, schema)

    # -- blends

    def first_pass(self, k: int = 0) -> DataFrame:
        """What a pass finds in each cell: the bounds of a query's scores there and, in rows of their own, its k best lexical scores; with these, written, as both are read."""
        names = self._ends()

        def kernel(s: Scores):
            if not s.some:
                return [[]] * (7 + len(names))
            known = s.lexical > 0
            ends = [end for x in s.views.values() for end in (x.min(1), x.max(1))]
            bounds = s.qids, np.where(known, s.lexical, np.inf).min(1), s.lexical.max(1), known.sum(1), np.full(len(s.qids), len(s.ids)), *ends
            row, column = best_of_block(s.lexical, s.ids, k) if k else (np.zeros(0, np.int64),) * 2
            rest = [np.zeros(len(row), c.dtype) for c in bounds[1:]]
            rest[3] -= 1  # no number of documents
            none = np.zeros(len(s.qids), np.int64)
            return [np.concatenate(c) for c in zip((*bounds, none, none.astype(float)), (s.qids[row], *rest, s.ids[column], s.lexical[row, column]), strict=True)]

        found = self.over(kernel, "id long, blo double, bhi double, have long, n long, " + ", ".join(f"{c} double" for c in names) + ", corpus_idx long, score double")
        return written(found) if k else found

    def _ends(self) -> list[str]:
        return [f"{end}{k}" for k in range(len(self.views)) for end in ("lo", "hi")]

    def lexical_topk(self, k: int, first: DataFrame) -> DataFrame:
        """(query_id, corpus_idx, score, rank): the k best positive lexical scores; first: a ``first_pass`` that kept as many."""
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_idx")
        top = first.filter("n < 0").select(F.col("id").alias("query_id"), "corpus_idx", "score").distinct()
        return top.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def extremes(self, first: DataFrame | None = None) -> DataFrame:
        """(id, more): the bounds (low, high) of a query's lexical scores and of its dense ones, view by view, over all documents."""
        names = self._ends()
        e = (self.first_pass() if first is None else first).filter("n >= 0").groupBy("id")
        e = e.agg(F.min("blo").alias("blo"), F.max("bhi").alias("bhi"), F.sum("have").alias("have"), F.sum("n").alias("n"), *[(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in names])
        low = F.when(F.col("have") < F.col("n"), F.least(F.col("blo"), F.lit(0.0))).otherwise(F.col("blo"))
        return written(e.select("id", F.array(low, "bhi", *names).alias("more")))  # read by more than one pass

    def _blended(self, alphas: list[float]):
        ends = 2 + 2 * len(self.views)

        def blends(s: Scores):
            m = np.array([x[:ends] for x in s.more]).reshape(len(s.qids), ends)

            def unit(x, lo, hi):
                width = hi - lo
                flat = ~(width >= 1e-12)
                return np.where(flat[:, None], 0.0, (x - lo[:, None]) / np.where(flat, 1.0, width)[:, None])

            lexical = np.where(s.lexical > 0, unit(s.lexical, m[:, 0], m[:, 1]), 0.0)
            for k, (name, x) in enumerate(s.views.items()):
                dense = unit(x, m[:, 2 + 2 * k], m[:, 3 + 2 * k])
                for a in alphas:
                    yield name, a, np.round(a * lexical + (1 - a) * dense, 9)

        return blends

    def _best(self, alphas, k: int, more: DataFrame, gold: bool) -> DataFrame:
        """(view, alpha, query_id, corpus_idx, score): the k best blends of each cell, or of its gold."""
        blends = self._blended(alphas)

        def kernel(s: Scores):
            out = [[] for _ in range(5)]
            if s.some:
                for name, a, score in blends(s):
                    row, column = best(np.where(s.gold(), score, -np.inf) if gold else score, s.ids, k)
                    for o, x in zip(out, (np.full(len(row), name), np.full(len(row), a), s.qids[row], s.ids[column], score[row, column]), strict=True):
                        o.append(x)
            return [np.concatenate(o) if o else [] for o in out]

        return self.over(kernel, "view string, alpha double, query_id long, corpus_idx long, score double", more)

    def blended_topk(self, alphas: list[float], k: int, first: DataFrame | None = None) -> DataFrame:
        """(view, alpha, query_id, corpus_idx, score, rank): the k best blends of alpha lexical and 1 - alpha dense, each within its query's range.

        first: the ``first_pass``, if it has been made.
        """
        w = Window.partitionBy("view", "alpha", "query_id").orderBy(F.desc("score"), "corpus_idx")
        return self._best(alphas, k, self.extremes(first), False).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def gold_ranks(self, alphas: list[float]) -> DataFrame:
        """(view, alpha, query_id, hit_rank): the rank of the first document of the query's label; without one there is no row."""
        blends, more = self._blended(alphas), self.extremes()
        ends = 2 + 2 * len(self.views)
        cases = [(name, a) for name in self.views for a in alphas]
        top = self._best(alphas, 1, more, True).groupBy("view", "alpha", F.col("query_id").alias("id")).agg(F.min(F.struct((-F.col("score")).alias("s"), "corpus_idx")).alias("g"))
        of = lambda name, a, value: F.max(F.when((F.col("view") == name) & (F.col("alpha") == a), value))
        none = F.lit(float("nan"))
        marks = top.groupBy("id").agg(F.array(*[F.coalesce(x, none) for c in cases for x in (of(*c, -F.col("g.s")), of(*c, F.col("g.corpus_idx").cast("double")))]).alias("g"))
        asked = more.join(marks, "id").select("id", F.concat("more", "g").alias("more"))

        def ahead(s: Scores):
            out = [[] for _ in range(4)]
            if s.some:
                m = np.array(s.more)[:, ends:]
                for k, (name, a, score) in enumerate(blends(s)):
                    at, idx = m[:, 2 * k][:, None], m[:, 2 * k + 1][:, None]
                    n = ((score > at) | ((score == at) & (s.ids[None, :] < idx))).sum(1)
                    there = ~np.isnan(m[:, 2 * k])
                    for o, x in zip(out, (np.full(there.sum(), name), np.full(there.sum(), a), s.qids[there], n[there]), strict=True):
                        o.append(x)
            return [np.concatenate(o) if o else [] for o in out]

        counted = self.over(ahead, "view string, alpha double, query_id long, n long", asked)
        return counted.groupBy("view", "alpha", "query_id").agg((F.sum("n") + 1).alias("hit_rank"))

    # -- places of dense scores

    def gold_place(self) -> DataFrame:
        """(query_id, best, below, n, total, squares): the best dense score of the query's label, and of the other documents how many lie below, their number, sum and sum of squares."""

        def first(s: Scores):
            score = np.where(s.gold(), s.dense, -np.inf).max(1) if s.some else np.zeros(0)
            return s.qids[score > -np.inf] if s.some else [], score[score > -np.inf]

        top = self.over(first, "id long, score double").groupBy("id").agg(F.array(F.max("score")).alias("more"))

        def place(s: Scores):
            if not s.some:
                return [[]] * 6
            other = ~s.gold() & (s.qids[:, None] != s.ids[None, :]) & ~np.isnan(s.label.astype(float))[None, :]
            own = np.array([x[0] for x in s.more])
            x = np.where(other, s.dense, 0.0)
            return s.qids, own, (other & (s.dense < own[:, None])).sum(1), other.sum(1), x.sum(1), (x * x).sum(1)

        parts = self.over(place, "query_id long, best double, below long, n long, total double, squares double", top)
        return parts.groupBy("query_id", "best").agg(*[F.sum(c).alias(c) for c in ("below", "n", "total", "squares")])

    def quantiles(self, shares: list[float]) -> list[float | None]:
        """Exact quantiles (linear between two values) of all dense scores, by rounds of counts: each narrows the places of the wanted values 65,536 times."""
        unit, bits = 10.0 ** -self.at, 16

        def total(s: Scores):
            return ([s.dense.size], [s.dense.min()], [s.dense.max()]) if s.some else [[]] * 3

        span = self.over(total, "n long, lo double, hi double").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
        if not span.n:
            return [None] * len(shares)
        places = [(int(p), min(int(p) + 1, span.n - 1), p - int(p)) for p in (q * (span.n - 1) for q in shares)]
        low = int(round(span.lo / unit))
        width = int(round(span.hi / unit)) - low + 1
        state = {p: (low, 0) for a, b, _ in places for p in (a, b)}  # place -> (start of its bucket, values before it)
        while width > 1:
            step = max(1, -(-width // (1 << bits)))
            starts = sorted({s for s, _ in state.values()})

            def counts(s: Scores, starts=starts, step=step, width=width):
                key = np.rint(s.dense.ravel() / unit).astype(np.int64)
                out = [[], [], []]
                for at in starts:
                    own, n = np.unique((key[(key >= at) & (key < at + width)] - at) // step, return_counts=True)
                    for o, x in zip(out, (np.full(len(own), at), own, n), strict=True):
                        o.append(x)
                return [np.concatenate(o) if o else [] for o in out]

            seen = self.over(counts, "start long, bucket long, n long").groupBy("start", "bucket").agg(F.sum("n").alias("n"))
            before = F.coalesce(F.sum("n").over(Window.partitionBy("start").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            seen = seen.withColumn("before", before)
            wanted = None
            for place, (start, passed) in state.items():
                own = seen.filter((F.col("start") == start) & (F.col("before") <= place - passed) & (F.col("before") + F.col("n") > place - passed)).select(F.lit(place).alias("place"), "start", "bucket", "before")
                wanted = own if wanted is None else wanted.union(own)
            state = {r.place: (r.start + r.bucket * step, state[r.place][1] + r.before) for r in wanted.collect()}
            width = step
        value = {p: s * unit for p, (s, _) in state.items()}
        return [value[a] + (value[b] - value[a]) * part for a, b, part in places]
