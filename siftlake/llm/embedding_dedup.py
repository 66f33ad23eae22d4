"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are rotated into principal directions, leading ones first.  Those with
equal labels are dealt into tiles of bounded size by their first coordinate
(cells of width sqrt(2 - 2 t): linked unit vectors lie in the same or the next
cell) and a hash.  A tile travels as one packed row and meets every tile that
may hold a link of its own.  For two tiles the products of the leading
dimensions are accumulated first, the rest is bounded by the product of the
suffix norms, and a pair is dropped as soon as its cosine cannot reach the
threshold.  What is left is verified in double precision on the original vectors.

The rotation comes from a bounded sample (``SAMPLE`` vectors in the order of a
hash of their ids); it decides how soon pairs drop out, never which pairs link.
Equal vectors of a label are one class throughout.  A tile pair returns, per
class, the number of vectors it links to and one row that ties it to its local
component, so links are never listed pair by pair.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label, link with nothing; vectors of different
length do not link; rows that repeat an id count as vectors each; a row
without an id links with nothing, has no component and is kept; extra columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, over_batches, over_group
from .exact_topk import usable

SAMPLE, TILE, STRIP = 4096, 2048, 256
#: Dimensions after which the bound is checked.
STEPS = (8, 16, 32)


def principal(sample: np.ndarray) -> np.ndarray:
    """Rotation whose first columns carry the most of the sample's second moments."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, ::-1].copy()


def linked_pairs(x, y, a, b, least):
    """(i, j) with cosine of x[i], y[j] at least ``least``; a, b: the same, rotated, of norm 1."""
    width = a.shape[1]
    steps = [s for s in STEPS if s < width] + [width]
    rest_a = [np.sqrt(np.maximum(0, (a[:, s:] ** 2).sum(1))) for s in steps]
    rest_b = [np.sqrt(np.maximum(0, (b[:, s:] ** 2).sum(1))) for s in steps]
    score = a[:, : steps[0]] @ b[:, : steps[0]].T
    i, j = np.nonzero(score + np.outer(rest_a[0], rest_b[0]) >= least - 1e-9)
    score = score[i, j]
    for k in range(1, len(steps)):
        if not len(i):
            break
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            score[part] += np.einsum("ij,ij->i", a[i[part], steps[k - 1] : steps[k]], b[j[part], steps[k - 1] : steps[k]])
        ok = score + rest_a[k][i] * rest_b[k][j] >= least - 1e-9
        i, j, score = i[ok], j[ok], score[ok]
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        u, v = x[i[at : at + (1 << 16)]], y[j[at : at + (1 << 16)]]
        keep[at : at + (1 << 16)] = (u * v).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1))) >= least
    return i[keep], j[keep]


TILED = "m int, after int, before int, nodes binary, sizes binary, data binary"


def _pack_kernel(table: pa.Table) -> pa.Table:
    """The vectors of a tile as one row."""
    first = table.slice(0, 1)
    data = np.asarray(table.column("vector").combine_chunks().flatten(), np.float64)
    packed = [table.column("node").to_numpy().astype(np.int64), table.column("size").to_numpy().astype(np.int64), data]
    keys = ["label", "width", "c", "h", "m", "after", "before"]
    return pa.table([*(first.column(k) for k in keys), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], [*keys, "nodes", "sizes", "data"])


def _tile_links(left: dict, right: dict, rotations: dict, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, how many vectors it links to, the least node of its local component) of two tiles, or of one with itself."""
    xi, yi = (np.frombuffer(t["nodes"], np.int64) for t in (left, right))
    xs, ys = (np.frombuffer(t["sizes"], np.int64) for t in (left, right))
    x, y = np.frombuffer(left["data"]).reshape(len(xi), -1), np.frombuffer(right["data"]).reshape(len(yi), -1)
    turn = rotations.get(x.shape[1])
    a, b = (v / np.sqrt((v * v).sum(1))[:, None] for v in (x, y))
    a, b = (a @ turn, b @ turn) if turn is not None else (a, b)
    nodes = np.unique(np.concatenate([xi, yi]))
    px, py = np.searchsorted(nodes, xi), np.searchsorted(nodes, yi)
    low, n = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
    for at in range(0, len(x), STRIP):
        i, j = linked_pairs(x[at : at + STRIP], y, a[at : at + STRIP], b, least)
        i = i + at
        if left["same"]:
            ok = xi[i] < yi[j]
            i, j = i[ok], j[ok]
        p, q = px[i], py[j]
        np.add.at(n, p, ys[j])
        np.add.at(n, q, xs[i])
        while len(p):
            m = np.minimum(low[p], low[q])
            before = low.copy()
            for ends in (p, q, low[p], low[q]):
                np.minimum.at(low, ends, m)
            low = low[low]
            if (low == before).all():
                break
    some = n > 0
    return nodes[some], n[some], nodes[low[some]]


def _pair_kernel(rotations, least):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                right = {"nodes": r["nodes_"], "sizes": r["sizes_"], "data": r["data_"]}
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _tile_links(r, right, rotations, least)], ["node", "n", "low"])

    return run


def _lead_kernel(rotations):
    """First coordinate of the rotated unit vector."""

    def run(frames):
        for f in frames:
            lead = []
            for v in f["vector"]:
                v = np.asarray(v, float)
                turn = rotations.get(len(v))
                lead.append(float((v @ turn[:, 0] if turn is not None else v[0]) / math.sqrt((v * v).sum())))
            yield f.assign(lead=lead)

    return run


def embedding_dedup(vectors: DataFrame, *, least: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; vectors with equal labels link at cosine >= ``least``."""
    if not 0 < least < 1:
        raise ValueError("least must be between 0 and 1")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    some = F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("ok", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("vector") & F.coalesce(some, F.lit(False)))
    rows = rows.withColumns({"k1": F.when(F.col("ok"), F.xxhash64("label", "vector")), "k2": F.when(F.col("ok"), F.hash("vector", "label"))})
    classes = scratch.keep(rows.filter("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("vector").alias("vector")))
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vector").collect()
    by_width: dict[int, list] = {}
    for r in sample:
        by_width.setdefault(len(r.vector), []).append(r.vector)
    rotations = {}
    for width, vs in by_width.items():
        m = np.array(vs)
        rotations[width] = principal(m / np.sqrt((m * m).sum(1))[:, None])
    kinds = dict(classes.dtypes)
    placed = classes.select("node", "size", "label", "vector").mapInPandas(_lead_kernel(rotations), f"node long, size long, label {kinds['label']}, vector array<double>, lead double")
    cell = math.sqrt(2 - 2 * least) + 1e-6
    placed = scratch.keep(placed.select("node", "size", "label", "vector", F.size("vector").alias("width"), F.floor(F.col("lead") / cell).cast("int").alias("c")))
    tiles = placed.groupBy("label", "width", "c").agg(F.ceil(F.count("*") / TILE).cast("int").alias("m"))
    tiles = tiles.select("label", "width", "c", "m").join(tiles.select("label", "width", (F.col("c") - 1).alias("c"), F.col("m").alias("after")), ["label", "width", "c"], "left").join(tiles.select("label", "width", (F.col("c") + 1).alias("c"), F.col("m").alias("before")), ["label", "width", "c"], "left")
    full = placed.join(tiles, ["label", "width", "c"]).withColumn("h", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    full = full.select("label", "width", "c", "h", "m", F.coalesce("after", F.lit(0)).alias("after"), F.coalesce("before", F.lit(0)).alias("before"), "node", "size", "vector")
    packed = scratch.keep(full.groupBy("label", "width", "c", "h").applyInArrow(over_group(_pack_kernel), f"label {kinds['label']}, width int, c int, h int, {TILED}"))
    held = ["nodes", "sizes", "data"]  # a left tile (c, h) meets those after it: (c, g) from h on, and all of cell c + 1
    own = packed.select("label", "width", F.col("c").alias("d"), F.explode(F.sequence(F.col("h"), F.col("m") - 1)).alias("g"), "h", *held)
    own = own.select("label", "width", "d", "g", (F.col("h") == F.col("g")).alias("same"), *held)
    next_ = packed.filter("after > 0").select("label", "width", (F.col("c") + 1).alias("d"), F.explode(F.sequence(F.lit(0), F.col("after") - 1)).alias("g"), F.lit(False).alias("same"), *held)
    right = packed.select("label", "width", F.col("c").alias("d"), F.col("h").alias("g"), *[F.col(c).alias(f"{c}_") for c in held])
    pairs = own.union(next_).join(right.hint("merge"), ["label", "width", "d", "g"]).select("same", *held, *[f"{c}_" for c in held])
    met = scratch.keep(pairs.mapInArrow(over_batches(_pair_kernel(rotations, least)), "node long, n long, low long"))
    comp = components(scratch, met.select(F.col("node").alias("a"), F.col("low").alias("b")))
    links = met.groupBy("node").agg(F.sum("n").alias("n"))
    of = classes.select("k1", "k2", "node", "size").join(links, "node", "left").join(comp, "node", "left")
    of = scratch.keep(of.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    out = rows.select("vec_id", "k1", "k2").join(of, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
