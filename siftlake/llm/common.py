"""Shared helpers: scratch tables, byte-level hashing kernels, connected components.

The kernels work on Arrow string buffers with numpy, a bounded slice of bytes
at a time, so a worker's memory does not follow the partition size.  A single
document is one slice at least; memory is about 100 bytes per byte of the
longest document.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake import shipping

U64 = np.uint64
#: Bytes of text that a kernel works on at once (whole documents).
SLICE_BYTES = 1 << 19
BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
_POW = np.ones(1, U64)
_INV = np.ones(1, U64)

#: ASCII white space: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ---------------------------------------------------------------- scratch


_LIVE: list[tuple[SparkSession, str, bool]] = []
_STAGE = [False]


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("siftlake.scratch", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='siftlake-')}"
        spark.conf.set("siftlake.scratch", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the folder is only scratch
        return


#: Rows and bytes of an Arrow batch at most: ten thousand documents at once would be more than a slice by far.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the workers and keep the batches they get small."""
    shipping.ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """Tables of one operator call in the shared folder.

    ``keep`` writes a DataFrame and reads it back, which cuts its lineage: an
    executor that is lost later costs nothing of it.  ``drop`` removes a table
    no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.path = f"{scratch_root(spark)}/siftlake-{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        self.n = 0
        _LIVE.append((spark, self.path, _STAGE[0]))

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        release_shuffles(self.spark)
        return out

    def drop(self, df: DataFrame) -> None:
        if path := self.paths.pop(id(df), None):
            _delete(self.spark, path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def stage_scratch(spark: SparkSession):
    """For stages whose results are written before the next one begins: removes the tables of the stages before."""
    for at in [x for x in _LIVE if x[0] is spark and x[2]]:
        _LIVE.remove(at)
        _delete(*at[:2])
    release_shuffles(spark)
    _STAGE[0] = True
    try:
        yield
    finally:
        _STAGE[0] = False


@atexit.register
def _at_exit() -> None:
    for spark, path, _ in _LIVE:
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            _delete(spark, path)


def crc_fold(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def least_per_group(rows: DataFrame, group: str, key: str, most: int, parts: int = 64) -> DataFrame:
    """At most ``most`` rows of each group, those with the least hash of ``key``: first of each part of a group, then of these."""
    order = [F.xxhash64(key), F.col(key)]
    w = Window.partitionBy(group, "__part").orderBy(*order)
    first = rows.withColumn("__part", F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(parts))).withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= most)
    second = first.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__k") <= most)
    return second.drop("__part", "__k")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- workers


def _trim() -> None:
    """Give the memory that a kernel has freed back to the system: workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def over_batches(run):
    """For mapInArrow: run, tidied up after."""

    def kernel(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return kernel


def over_group(run):
    """For applyInArrow on groups."""

    def kernel(table):
        try:
            return run(table)
        finally:
            _trim()

    return kernel


def over_cogroup(run):
    """For applyInArrow on cogroups."""

    def kernel(left, right):
        try:
            return run(left, right)
        finally:
            _trim()

    return kernel


# ---------------------------------------------------------------- bytes


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.binary()):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    kind = np.int64 if wide else np.int32
    n, first = len(column), column.offset
    buffers = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[first : first + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges of at most ``most`` bytes (one row at least)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1), lo + 50_000)
        yield lo, hi
        lo = hi


def long_cuts(data: np.ndarray, start: int, end: int, most: int = SLICE_BYTES) -> list[int]:
    """Places that cut a long text after white space into parts of at most ``most`` bytes, or one word."""
    out = [start]
    while end - out[-1] > most:
        at = out[-1] + most // 2
        space = np.flatnonzero(SPACE[data[at : out[-1] + most]])
        at += int(space[-1]) + 1 if len(space) else most - most // 2
        while not len(space) and at < end:  # a word longer than that
            space = np.flatnonzero(SPACE[data[at : at + most]])
            at += int(space[0]) + 1 if len(space) else most
        if at >= end:
            break
        out.append(at)
    return [*out, end]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n + 1:
        m = max(n + 1, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for start, name in ((BASE, "_POW"), (_BASE_INV, "_INV")):
                steps = np.full(m, start, U64)
                steps[0] = 1
                globals()[name] = np.multiply.accumulate(steps)
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of the bytes' codes times BASE**position, modulo 2**64."""
    power, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * power[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the byte spans [start, end): a function of their bytes alone."""
    _, inverse = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word (a run of bytes that are not ASCII space)."""
    solid = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted unsigned numbers as steps of few bytes; the few steps that are longer are listed apart."""
    if not len(x):
        return b""
    steps = np.diff(x).astype("<u8")
    cost = [len(steps) * w + 12 * int(np.count_nonzero(steps >> U64(8 * w))) if w < 8 else len(steps) * 8 for w in range(1, 9)]
    width = 1 + int(np.argmin(cost))
    long = np.flatnonzero(steps >> U64(8 * width)) if width < 8 else np.zeros(0, np.int64)
    low = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
    return bytes([width]) + len(long).to_bytes(4, "little") + x[:1].astype("<u8").tobytes() + long.astype("<u4").tobytes() + steps[long].tobytes() + low


def unpack_sorted(raw) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, U64)
    raw = np.frombuffer(raw, np.uint8)
    width, some = int(raw[0]), int(raw[1:5].view("<u4")[0])
    at = 13 + 12 * some
    steps = np.zeros(((len(raw) - at) // width + 1, 8), np.uint8)
    steps[1:, :width] = raw[at:].reshape(-1, width)
    steps = steps.view(U64).ravel()
    steps[0] = raw[5:13].copy().view(U64)[0]
    steps[raw[13 : 13 + 4 * some].copy().view("<u4").astype(np.int64) + 1] = raw[13 + 4 * some : at].copy().view(U64)
    return np.cumsum(steps, dtype=U64)


def squeeze(data: bytes, level: int = 3) -> bytes:
    """zstd; nothing for nothing."""
    return pa.Codec("zstd", compression_level=level).compress(data, asbytes=True) if len(data) else b""


def scattered(number: int, n: int) -> int:
    """One of 0..n-1, evenly for numbers of any pattern."""
    return int(mix(np.array([number], U64))[0]) % n


def i64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# ---------------------------------------------------------------- components


def _contract(batches):
    """Per partition: the edges' local components as stars (any spanning tree would do)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def flush():
        rows = [(x, root(x)) for x in list(parent)]
        rows = [r for r in rows if r[0] != r[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:  # bounded memory; what is left open is joined in later rounds
            yield flush()
    yield flush()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component = smallest node reachable) of every node with an edge.

    edges: two long columns.  Alternates large-star and small-star steps
    (Kiveris et al., 2014), after contracting each partition's edges, until no
    edge changes; every round is written to the shared folder.
    """
    u, v = edges.columns[:2]
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v")
    e = scratch.keep(e.mapInArrow(_contract, "u long, v long").distinct())
    mark = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.keep(small)
        scratch.drop(e)
        e = new
        now = tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
