"""Resampling from sufficient statistics.

Paired 0/1 outcomes differ by -1, 0 or 1, so all that a resample of n pairs
tells is one draw from the distribution of wins less losses under (n, wins,
losses, ties).  Each of the ``iters`` resamples takes it at a uniform number
from the md5 of (seed, resample), by the inverse of that distribution: a group
costs one row, whatever n is, and any SQL engine gives the same.  Differences
of other values are resampled place by place, with places from an integer
hash, in a vectorised kernel that shares the resamples out among tasks.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.shipping import ship

ITERS, SEED = 20_000, "20260626"
#: Standard deviations of a count beyond which its chance is nothing in double precision.
FAR = 12
#: Tasks that share the resamples of a group of values; multipliers of the hash.
SLICES, STRIDE, M1, M2 = 16, 1_000_003, 2_246_822_507, 3_266_489_909
#: Numbers of the hash, and how many draws are made at a time.
RING, CHUNK = 1 << 32, 1 << 14


@lru_cache(maxsize=8)
def uniforms(seed: str, iters: int) -> np.ndarray:
    """(first 48 bits of md5(seed:it) + 0.5) / 2**48."""
    return (np.array([int.from_bytes(hashlib.md5(f"{seed}:{k}".encode()).digest()[:6], "big") for k in range(iters)], np.float64) + 0.5) / 2.0**48


def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1, dtype=np.float64)))))


def _span(n: int, p: float) -> np.ndarray:
    mean, sd = n * p, (n * p * (1 - p)) ** 0.5
    return np.arange(max(0, int(mean - FAR * sd) - 5), min(n, int(mean + FAR * sd) + 5) + 1) if p else np.zeros(1, np.int64)


def difference_distribution(n: int, wins: int, losses: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of wins less losses in a resample of n pairs, and the chance of at most each."""
    lf, ties = _log_factorials(n), n - wins - losses
    part = lambda k, c: np.where(k > 0, k * np.log(c / n), 0.0) if c else np.where(k > 0, -np.inf, 0.0)
    i, j = _span(n, wins / n), _span(n, losses / n)
    low = int(i[0] - j[-1])
    p = np.zeros(int(i[-1] - j[0]) - low + 1)
    for w in i.tolist():
        rest = n - w - j
        own = j[rest >= 0]
        rest = rest[rest >= 0]
        p[w - own - low] += np.exp(lf[n] - lf[w] - lf[own] - lf[rest] + part(np.array(w), wins) + part(own, losses) + part(rest, ties))
    return np.arange(low, low + len(p)), np.cumsum(p)


def draw(values: np.ndarray, upto: np.ndarray, u: np.ndarray) -> np.ndarray:
    return values[np.minimum(np.searchsorted(upto, u), len(values) - 1)]


def percentile_interval(counts: DataFrame, *keys: str, iters: int = ITERS, conf: float = 0.95, seed: str = SEED) -> DataFrame:
    """Adds lo and hi, the percentile interval of the mean difference, to rows with n, wins and losses; n = 0 gives null."""
    ship(counts.sparkSession)
    names = [f.name for f in counts.schema.fields]

    def run(batches):
        u = uniforms(seed, iters)
        for b in batches:
            n, w, l = (b.column(names.index(c)).to_pylist() for c in ("n", "wins", "losses"))
            ends = []
            for k in range(b.num_rows):
                if not n[k]:
                    ends.append((None, None))
                    continue
                d = draw(*difference_distribution(n[k], w[k], l[k]), u) / n[k]
                ends.append(tuple(float(x) for x in np.quantile(d, [(1 - conf) / 2, 1 - (1 - conf) / 2])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([e[0] for e in ends], pa.float64()), pa.array([e[1] for e in ends], pa.float64())], [*names, "lo", "hi"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema.fields)
    return counts.mapInArrow(run, f"{schema}, lo double, hi double")


def sign_flips(counts: DataFrame, draws: int, seed: str = "123") -> DataFrame:
    """observed, draws and p of the two-sided sign-flip test of the mean, for rows with n, wins and losses.

    A flip of all signs leaves as many of the discordant pairs positive as a
    fair coin gives heads.
    """
    ship(counts.sparkSession)

    def run(batches):
        u = uniforms(seed, draws)
        for b in batches:
            out = []
            for n, w, l in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                m, seen = w + l, abs(w - l) / n if n else 0.0
                lf = _log_factorials(m)
                heads = np.arange(m + 1)
                k = draw(heads, np.cumsum(np.exp(lf[m] - lf - lf[::-1] - m * np.log(2.0))), u)
                over = int((np.abs(2 * k - m) / max(1, n) >= seen - 1e-12).sum())
                out.append((seen, draws, (over + 1) / (draws + 1)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.float64()))], ["observed", "draws", "p"])

    return counts.select(*[F.col(c).cast("long") for c in ("n", "wins", "losses")]).mapInArrow(run, "observed double, draws long, p double")


def places(it: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Place of each of n draws in resample it, 0 to n - 1: rows are resamples."""
    low = np.uint64(0xFFFFFFFF)
    h = (it.astype(np.uint64)[:, None] * np.uint64(STRIDE) + np.arange(n, dtype=np.uint64)[None, :] + np.uint64(seed)) & low
    h = (h ^ (h >> np.uint64(16))) * np.uint64(M1) & low
    h = (h ^ (h >> np.uint64(13))) * np.uint64(M2) & low
    return ((h ^ (h >> np.uint64(16))) % np.uint64(n)).astype(np.int64)


def stretches(n: int, iters: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hash of a draw depends on it * STRIDE + draw alone, so a resample is a stretch of n numbers on a ring of 2**32.

    (bounds, first, last, used): pieces of the ring begin at the bounds; a
    resample has the pieces from first to before last, counted on where it goes
    over the ring's end; used: whether any has the piece.  Resamples are sorted
    by their start.  Where stretches overlap, a piece is summed for all of them.
    """
    start = np.sort((np.arange(iters, dtype=np.int64) * STRIDE + seed) % RING)
    bounds = np.unique(np.concatenate(([0], start, (start + n) % RING)))
    first, last = np.searchsorted(bounds, start), np.searchsorted(bounds, (start + n) % RING) + (start + n) // RING * len(bounds)
    turns = int(last.max()) // len(bounds) + 1
    open_ = np.bincount(first, minlength=turns * len(bounds)) - np.bincount(last, minlength=turns * len(bounds))
    return bounds, first, last, np.cumsum(open_).reshape(turns, len(bounds)).any(0)


def piece_sum(d: np.ndarray, lo: int, hi: int) -> float:
    """The sum of the values that the numbers lo to hi - 1 of the ring draw, some thousands at a time."""
    n, total = np.uint32(len(d)), 0.0
    for at in range(lo, hi, CHUNK):
        h = np.arange(min(CHUNK, hi - at), dtype=np.uint32) + np.uint32(at)
        h ^= h >> np.uint32(16)
        h *= np.uint32(M1)
        h ^= h >> np.uint32(13)
        h *= np.uint32(M2)
        h ^= h >> np.uint32(16)
        h -= h // n * n
        total += d[h].sum()
    return float(total)


def value_interval(pairs: DataFrame, *keys: str, iters: int = ITERS, conf: float = 0.95, seed: str = SEED, place: str = "query_id") -> DataFrame:
    """(keys, lo, hi): percentile interval of the mean of d, values in the order of ``place``.

    The values of a group, a number for each query, go to each of the tasks that
    share the pieces of its resamples; draws are made at most once for each
    number of the ring, however many values there are.
    """
    ship(pairs.sparkSession)
    kinds = dict(pairs.dtypes)
    rows = pairs.select(*keys, F.col(place).alias("__at"), F.col("d").cast("double").alias("__d"), F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("__slice"))
    own = lambda table: [pa.array([table.column(c)[0].as_py()], table.schema.field(c).type) for c in keys]
    named = ", ".join(f"`{c}` {kinds[c]}" for c in keys)

    def sums(table):
        d = np.ascontiguousarray(table.sort_by("__at").column("__d").to_numpy())
        bounds, _, _, used = stretches(len(d), iters, int(seed))
        k, ends = table.column("__slice")[0].as_py(), np.append(bounds[1:], RING)
        mine = np.flatnonzero(used)[k::SLICES]
        found = [piece_sum(d, int(bounds[p]), int(ends[p])) for p in mine]
        return pa.table([*own(table), pa.array([len(d)]), pa.array([mine.tolist()], pa.list_(pa.int64())), pa.array([found], pa.list_(pa.float64()))], [*keys, "n", "piece", "total"])

    def means(table):
        n = table.column("n")[0].as_py()
        bounds, first, last, _ = stretches(n, iters, int(seed))
        total = np.zeros(len(bounds))
        total[table.column("piece").combine_chunks().flatten().to_numpy()] = table.column("total").combine_chunks().flatten().to_numpy()
        turns = np.append(np.tile(total, int(last.max()) // len(bounds) + 1), 0.0)
        m = np.add.reduceat(turns, np.column_stack((first, last)).ravel())[::2] / n
        return pa.table([*own(table), pa.array([m.tolist()])], [*keys, "m"])

    rows = rows.repartition(SLICES, "__slice")  # by a stated number: few bytes, much work
    parts = rows.groupBy("__slice", *keys).applyInArrow(sums, f"{named}, n long, piece array<long>, total array<double>")
    out = parts.groupBy(*keys).applyInArrow(means, f"{named}, m array<double>")
    lo = (1 - conf) / 2
    return out.select(*keys, F.explode("m").alias("m")).groupBy(*keys).agg(F.percentile("m", F.lit(lo)).alias("lo"), F.percentile("m", F.lit(1 - lo)).alias("hi"))
