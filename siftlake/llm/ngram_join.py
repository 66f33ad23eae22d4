"""N-gram Jaccard join by vertical partitioning.

Every document is the set of its distinct word n-grams.  The global n-gram
order (the order of their 64-bit fingerprints) is cut into vertical fragments.

1. Partial overlaps.  Blocks of documents send each fragment their n-grams in
   it, packed, each n-gram once.  A fragment counts how many documents hold each;
   a block sums up over the fragments how many n-grams of a document another
   document holds too.  That sum bounds the overlap with any partner from above,
   so a document whose sum is below the threshold of its own size links with
   nothing.  (Fragments see fingerprints cut to a few bits more than tell the
   corpus' n-grams apart: a sum can only come out too high.)  A block's texts
   travel with its requests, compressed, so that they are read once and meet
   their sums again.
2. Candidates, among what is left.  With |x and y| >= t * max(|x|, |y|), two
   linked sets share one of the |x| - ceil(t * |x|) + 1 n-grams of each that come
   first in any global order; the order is from rare to common, so most of these
   are held by one document only and need not be looked up.  Documents that share
   one are paired with its smallest member only (the hub), so that a group of
   copies gives as many rows as it has members.
3. Pairs.  The overlaps of a pair are counted range by range of the order and
   summed; what the two do not share (the difference) is kept.
4. Two documents of one n-gram both have its hub.  If both link to the hub they
   are connected; all other pairs of a hub's group are settled from the
   differences alone: |x - y| = |dx| + |dy| - 2 * |dx and dy|, with the shared
   differences counted through an inverted list inside the group.  (A member too
   far from the hub to link with any that does link to it, by the triangle
   inequality, meets the other such members only.)  Large groups are cut into
   tiles of a bounded number of members; only links are returned, as a spanning
   forest of each pair of tiles.

Equal sets are one node throughout.  The result is exact up to collisions of
64-bit fingerprints; no posting list, candidate or partner is capped.

Defined results: null text counts as empty; an empty set has n_shingles 0 and
its own id as component; rows that repeat a doc_id are one document (each row
returns, in one component); a null doc_id takes no part, as a hub neither, and
returns null as its component, unless an equal text has an id; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SLICE_BYTES, U64, Scratch, components, i64, long_cuts, mix, over_batches, over_group, pack_sorted, prefix_hash, release_shuffles, scattered, slices, span_hash, squeeze, text_bytes, unpack_sorted, words

#: Members of a hub's group that one tile compares with as many others.
TILE = 2048
#: Bytes and rows of text in a block of requests; bytes of text whose n-grams a vertical fragment of the order holds.
BLOCK_BYTES, BLOCK_ROWS, FRAGMENT_BYTES = 6 << 20, 60_000, 12 << 20
REQUEST = "fragment int, block long, keys binary, counts binary, ids array<long>, lengths binary, texts binary"
REPLY = "fragment int, block long, n int, ranks binary, ids array<long>, lengths binary, texts binary"
ROWS = "doc_id long, n_shingles long, node long, grams binary, first binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, offsets): per row the sorted distinct word n-grams of its lower-cased text."""
    if len(offsets) == 2 and len(data) > 2 * SLICE_BYTES and len(cut := long_cuts(data, 0, len(data))) > 2:
        return _long_set(data, cut, n)
    return _sets(data, offsets, n)


def _whole_set(data: np.ndarray, n: int) -> np.ndarray:
    return _sets(data, np.array([0, len(data)]), n)[0]


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets() in one go."""
    data = LOWER[data]
    start, end, row = words(data, offsets)
    h = span_hash(prefix_hash(data), start, end)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(count)))
    made = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    out = np.concatenate(([0], np.cumsum(made)))
    with np.errstate(over="ignore"):
        g = np.zeros(max(0, len(h) - n + 1), U64)
        for k in range(n):
            g = mix(g * U64(0xD1342543DE82EF95) + h[k : k + len(g)] + U64(k + 1))
        at = np.arange(out[-1]) - np.repeat(out[:-1], made) + np.repeat(first[:-1], made)
        full = np.repeat(count >= n, made)
        s = np.zeros(out[-1], U64)
        s[full] = g[at[full]]
        for r in np.flatnonzero((count > 0) & (count < n)):  # fewer words than n: the sequence as one
            x = U64(0)
            for w in h[first[r] : first[r + 1]]:
                x = mix(np.array([x * U64(0x94D049BB133111EB) + w + U64(count[r] * 1000)], U64))[0]
            s[out[r]] = x
    for r in np.flatnonzero(made > 1):
        s[out[r] : out[r + 1]].sort()
    fresh = np.ones(len(s), bool)
    fresh[1:] = s[1:] != s[:-1]
    fresh[out[:-1][made > 0]] = True
    kept = np.add.reduceat(fresh, out[:-1][made > 0]) if len(s) else np.zeros(0, int)
    size = np.zeros(rows, np.int64)
    size[made > 0] = kept
    return s[fresh], np.concatenate(([0], np.cumsum(size)))


def _long_set(data: np.ndarray, cut: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets() of one long text, part by part: a part begins with the n - 1 words before it."""
    found, tail = [], np.zeros(0, np.uint8)
    for i, j in zip(cut, cut[1:], strict=False):
        part = np.concatenate((tail, data[i:j]))
        start, _, _ = words(part, np.array([0, len(part)]))
        if len(start) >= n:  # fewer than n words so far wait for the next part
            found.append(_whole_set(part, n))
            tail = part[start[len(start) - n + 1] :] if n > 1 else part[:0]
        else:
            tail = part
    s = np.unique(np.concatenate(found)) if found else _whole_set(tail, n)
    return s, np.array([0, len(s)])


def _segments(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum (modulo 2**64) of each row's values; 0 for empty rows."""
    out = np.zeros(len(offsets) - 1, U64)
    full = np.diff(offsets) > 0
    if len(values):
        with np.errstate(over="ignore"):
            out[full] = np.add.reduceat(values, offsets[:-1][full])
    return out


def set_hash(s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(_segments(mix(s), offsets) + np.diff(offsets).astype(U64) * U64(0xA0761D6478BD642F))


# ---------------------------------------------------------------- partial overlaps


def _table(columns: list, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


class Block:
    """The sets of a block's documents and the distinct keys, cut to ``bits``, of those that ask.

    One document of equal sets asks; rows without an id and empty sets do not.
    """

    def __init__(self, ids: list, s: np.ndarray, offsets: np.ndarray, bits: int):
        self.s, self.offsets = s, offsets
        self.size, self.node = np.diff(offsets), set_hash(s, offsets)
        named = np.array([x is not None for x in ids], bool) & (self.size > 0)
        self.asks = np.zeros(len(ids), bool)
        self.asks[np.flatnonzero(named)[np.unique(self.node[named], return_index=True)[1]]] = True
        self.some = np.repeat(self.asks, self.size)
        self.short = s[self.some] >> U64(64 - bits)
        self.keys, self.counts = np.unique(self.short, return_counts=True)


def _request(block: int, held: list, fragments: int, bits: int) -> pa.Table:
    """A block's n-grams for each fragment; one of its rows has the block's documents as well."""
    ids = [x for part in held for x in part[0]]
    s, text, length = (np.concatenate([part[k] for part in held]) for k in (1, 3, 4))
    own = Block(ids, s, np.concatenate(([0], np.cumsum(np.concatenate([np.diff(part[2]) for part in held])))), bits)
    key, count = own.keys, np.minimum(own.counts, 255).astype(np.uint8)
    cut = np.concatenate(([0], np.searchsorted(key, np.array([-(-(f << bits) // fragments) for f in range(1, fragments)], U64)), [len(key)]))
    out, names_in = [], scattered(block, fragments)
    for f, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        names = (ids, length.astype("<i4").tobytes(), squeeze(text.tobytes())) if f == names_in else (None,) * 3
        if i < j or names[0] is not None:
            out.append((f, block, pack_sorted(key[i:j]), squeeze(count[i:j].tobytes(), 1), *names))
    return _table(list(zip(*out, strict=True)), REQUEST)


def _request_kernel(n, fragments, bits):
    def run(batches):
        from pyspark import TaskContext

        block, held, size, rows = TaskContext.get().partitionId() << 32, [], 0, 0
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            ids = b.column(0).to_pylist()
            for lo, hi in slices(offsets):
                for at in range(lo, hi, BLOCK_ROWS):
                    to = min(hi, at + BLOCK_ROWS)
                    if held and rows + to - at > BLOCK_ROWS or size >= BLOCK_BYTES:
                        yield from _request(block, held, fragments, bits).to_batches()
                        block, held, size, rows = block + 1, [], 0, 0
                    text, own = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
                    held.append((ids[at:to], *shingle_sets(text, own, n), text, np.diff(own)))
                    size, rows = size + int(offsets[to] - offsets[at]), rows + to - at
        if held:
            yield from _request(block, held, fragments, bits).to_batches()

    return run


def _fragment_kernel(table: pa.Table) -> pa.Table:
    """How common each block's n-grams in a fragment are: 0 for one document, then by quarters of powers of two."""
    table = table.combine_chunks()
    keys = [unpack_sorted(x.as_buffer()) for x in table.column("keys")]
    every = np.concatenate(keys)
    counts = np.concatenate([np.frombuffer(pa.decompress(x.as_buffer(), len(k), "zstd", asbytes=True) if len(k) else b"", np.uint8) for x, k in zip(table.column("counts"), keys, strict=True)])
    order = np.argsort(every, kind="stable")
    run = every[order]
    new = np.concatenate(([True], run[1:] != run[:-1])) if len(run) else np.zeros(0, bool)
    total = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new)) if len(run) else np.zeros(0, np.int64)
    rank = np.minimum(4 * np.log2(np.maximum(total, 1)), 255).astype(np.uint8)
    ranks = np.empty(len(every), np.uint8)
    ranks[order] = rank[np.cumsum(new) - 1]
    at = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).tolist()
    packed = [squeeze(ranks[i:j].tobytes(), 1) for i, j in zip(at, at[1:], strict=False)]
    return pa.table([table.column("fragment"), table.column("block"), pa.array([len(k) for k in keys], pa.int32()), pa.array(packed, pa.binary()), *(table.column(c) for c in ("ids", "lengths", "texts"))], [x.split()[0] for x in REPLY.split(", ")])


def _sum_kernel(n, percent, bits):
    def run(table: pa.Table) -> pa.Table:
        """The partial counts of a block's documents summed; the sets of those that can have a partner, and their first n-grams."""
        table = table.combine_chunks().sort_by("fragment")
        named = table.filter(table.column("lengths").is_valid()).slice(0, 1).to_pylist()[0]
        length = np.frombuffer(named["lengths"], "<i4").astype(np.int64)
        at = np.concatenate(([0], np.cumsum(length)))
        data = np.frombuffer(pa.decompress(named["texts"], int(at[-1]), "zstd", asbytes=True), np.uint8) if at[-1] else np.zeros(0, np.uint8)
        parts = [shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], n) for lo, hi in slices(at)]
        offsets = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(o) for _, o in parts]))))
        own = Block(named["ids"], np.concatenate([s for s, _ in parts]), offsets, bits)
        ranks = np.frombuffer(b"".join(pa.decompress(x.as_buffer(), size, "zstd", asbytes=True) for x, size in zip(table.column("ranks"), table.column("n").to_pylist(), strict=True) if size), np.uint8)
        rank = np.zeros(len(own.s), np.uint8)
        rank[own.some] = ranks[np.searchsorted(own.keys, own.short)] if len(own.short) else 0
        shared = np.diff(np.concatenate(([0], np.cumsum(rank > 0)))[offsets])
        alive = own.asks & (100 * shared >= percent * own.size)
        grams, first = ([None] * len(length) for _ in range(2))
        for k in np.flatnonzero(alive).tolist():
            s, r = own.s[offsets[k] : offsets[k + 1]], rank[offsets[k] : offsets[k + 1]]
            grams[k] = s.tobytes()
            prefix = len(s) + (-percent * len(s)) // 100 + 1
            s, r = s[r > 0], r[r > 0]
            first[k] = s[np.lexsort((s, r))[: max(0, prefix - (int(own.size[k]) - len(s)))]].tobytes()
        return _table([named["ids"], own.size, pa.array(i64(own.node), mask=own.size == 0), grams, first], ROWS)

    return run


def _first_kernel(batches):
    """(sig, node): one row for each n-gram to look up."""
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        sig = np.frombuffer(data.tobytes(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.repeat(b.column(0).to_numpy(), np.diff(offsets) // 8))], ["sig", "node"])


# ---------------------------------------------------------------- pairs


def overlap(a: np.ndarray, b: np.ndarray, parts: int = 16) -> int:
    """Shared n-grams of two sorted sets: partial overlaps in equal ranges of the order, summed."""
    cut = np.array([k * (1 << 64) // parts for k in range(1, parts)], U64)
    ca, cb = (np.concatenate(([0], np.searchsorted(x, cut), [len(x)])).tolist() for x in (a, b))
    return sum(_partial(a[ca[k] : ca[k + 1]], b[cb[k] : cb[k + 1]]) for k in range(parts) if ca[k] < ca[k + 1] and cb[k] < cb[k + 1])


def _partial(x: np.ndarray, y: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.count_nonzero(y[at] == x))


def _difference_kernel(percent):
    """Pairs (node, hub) with their sets -> sizes, whether they link, and the n-grams that only one of them has."""

    def run(batches):
        for b in batches:
            size, ok, diff, far = [], [], [], []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                g, h = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                shared = overlap(g, h, max(2, min(len(g), len(h)) // 1024))
                size.append(len(g))
                ok.append(100 * shared >= percent * (len(g) + len(h) - shared))
                diff.append(np.setxor1d(g, h, assume_unique=True).tobytes())
                far.append(len(g) + len(h) - 2 * shared)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(ok, pa.bool_()), pa.array(far, pa.int64()), pa.array(diff, pa.binary())], ["node", "hub", "size", "linked", "far", "diff"])

    return run


def group_links(x, y, percent):
    """Links (i, the js) between two lists of (size, linked to the hub, difference), not both linked to it."""
    if not x or not y:
        return
    dy = [d for _, _, d in y]
    grams, where = np.unique(np.concatenate(dy), return_inverse=True)
    owner = np.repeat(np.arange(len(y)), [len(d) for d in dy])
    order = np.argsort(where, kind="stable")
    owner, first = owner[order], np.concatenate(([0], np.cumsum(np.bincount(where, minlength=len(grams)))))
    sy, by, ky = (np.array(v) for v in ([v[0] for v in y], [len(d) for d in dy], [v[1] for v in y]))
    for i, (sx, kx, dx) in enumerate(x):
        if len(dx) and len(grams):
            at = np.minimum(np.searchsorted(grams, dx), len(grams) - 1)
            at = at[grams[at] == dx]
        else:
            at = np.zeros(0, np.int64)
        n = first[at + 1] - first[at]
        seen = owner[np.arange(n.sum()) + np.repeat(first[at] - np.cumsum(n) + n, n)] if len(at) else owner[:0]
        both = np.bincount(seen, minlength=len(y))
        shared = (sx + sy - (len(dx) + by - 2 * both)) // 2
        ok = 100 * shared >= percent * (sx + sy - shared)
        if kx:
            ok &= ~ky
        yield i, np.flatnonzero(ok).tolist()


def _group_kernel(percent):
    """Two tiles of a hub's group -> a spanning forest of their links."""
    import pandas as pd

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = lambda f: [(int(s), bool(k), np.frombuffer(d, U64)) for s, k, d in zip(f["size"], f["linked"], f["diff"], strict=True)]
        a, b = left["node"].tolist(), right["node_"].tolist()
        right = right.rename(columns=lambda c: c.rstrip("_"))
        root: dict[int, int] = {}

        def top(c):
            while (up := root.get(c, c)) != c:
                c = up
            return c

        out = []
        for i, js in group_links(rows(left), rows(right), percent):
            for j in js:
                u, v = top(a[i]), top(b[j])
                if u != v:
                    out.append((a[i], b[j]))
                    root[max(u, v)] = min(u, v)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def ngram_join(docs: DataFrame, *, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Documents link when 100 * intersection >= percent * union of their word
    n-gram sets.  See the module's text for the method and the edge cases.
    """
    if not 50 < percent < 100:
        raise ValueError("percent must be above 50 and below 100")
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments, bits = max(1, -(-size // FRAGMENT_BYTES)), min(60, size.bit_length() + 7)
    asked = docs.mapInArrow(over_batches(_request_kernel(n, fragments, bits)), REQUEST)
    counted = asked.groupBy("fragment").applyInArrow(over_group(_fragment_kernel), REPLY)
    told = scratch.keep(counted.groupBy("block").applyInArrow(over_group(_sum_kernel(n, percent, bits)), ROWS))
    asked = counted = None  # their shuffles are read
    release_shuffles(spark)
    rows = told.select("doc_id", "n_shingles", "node")
    grams = scratch.keep(told.filter("grams is not null").select("node", "grams").dropDuplicates(["node"]))
    sigs = told.filter("first is not null").select("node", "first").mapInArrow(over_batches(_first_kernel), "sig long, node long")
    live = scratch.keep(sigs.groupBy("sig").agg(F.min("node").alias("hub"), F.max("node").alias("most")).filter("hub <> most").select("sig", "hub"))
    pairs = scratch.keep(sigs.join(live.hint("merge"), "sig").filter("node <> hub").select("node", "hub").distinct())
    scratch.drop(live)
    a, b = grams.select("node", F.col("grams").alias("own")), grams.select(F.col("node").alias("hub"), F.col("grams").alias("hubs"))
    met = a.join(pairs.hint("merge"), "node").join(b.hint("merge"), "hub").select("node", "hub", "own", "hubs")
    met = scratch.keep(met.mapInArrow(over_batches(_difference_kernel(percent)), "node long, hub long, size long, linked boolean, far long, diff binary"))
    edges = met.filter("linked").select(F.col("node").alias("a"), F.col("hub").alias("b")).union(_settle(scratch, met, percent))
    comp = components(scratch, edges)
    least = rows.filter("node is not null").join(comp, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("doc_id").alias("component_id"))
    node_to = rows.select("node").filter("node is not null").distinct().join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    node_to = node_to.join(least, "component").select("node", "component_id")
    found = rows.join(node_to, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return _same_ids(scratch, found)


def _same_ids(scratch: Scratch, found: DataFrame) -> DataFrame:
    """Rows that repeat a doc_id with other texts are one document: their components are joined."""
    repeated = scratch.keep(found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).filter("a <> b").select("a", "b"))
    if repeated.isEmpty():
        return found
    extra = found.filter("doc_id is not null").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    comp = components(scratch, extra.filter("a <> b")).select(F.col("node").alias("component_id"), "component")
    return found.join(comp, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))


def _settle(scratch: Scratch, met: DataFrame, percent: int) -> DataFrame:
    """Links between members of one hub's group of which one at least does not link to the hub.

    Linked sets of sizes a and b differ in at most r * (a + b) n-grams, with
    r = (100 - t) / (100 + t).  An unlinked member y can link with a linked x only
    if far(y) - r * |y| <= far(x) + r * |x|, where far is the distance to the hub.
    """
    r = F.lit((100 - percent) / (100 + percent))
    reach, near = F.col("far") + r * F.col("size"), F.col("far") - r * F.col("size")
    groups = met.groupBy("hub").agg(F.count_if("linked").alias("n_linked"), F.count_if(~F.col("linked")).alias("n_open"), F.max(F.when(F.col("linked"), reach)).alias("reach"), F.min(F.when(~F.col("linked"), near)).alias("near"))
    groups = groups.withColumn("meet", F.coalesce(F.col("near") <= F.col("reach") + 1e-6, F.lit(False))).filter("n_open > 1 or n_open = 1 and meet")
    n = F.col("n_open") + F.when(F.col("meet"), F.col("n_linked")).otherwise(0)
    groups = groups.select("hub", "meet", F.ceil(n / TILE).cast("int").alias("tiles"))
    met = met.join(groups.hint("merge"), "hub").filter("meet or not linked").drop("meet")
    open_ = met.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    columns = ["hub", "i", "j", "node", "size", "linked", "diff"]
    left = open_.select("hub", F.col("tile").alias("i"), other.alias("j"), *columns[3:]).filter("i <= j")
    right = open_.select("hub", other.alias("i"), F.col("tile").alias("j"), *columns[3:]).filter("i <= j").toDF(*[f"{c}_" for c in columns])
    found = left.groupBy("hub", "i", "j").cogroup(right.groupBy("hub_", "i_", "j_")).applyInPandas(_group_kernel(percent), "a long, b long")
    return scratch.keep(found.filter("a <> b"))
