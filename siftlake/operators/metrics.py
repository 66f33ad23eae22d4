"""Hits, information-retrieval metrics, exposure, Pareto sets, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.sources.store import written

#: Buckets that the values of a group are counted in.
PLACES = 1 << 16


def first_hit(ranked: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, hit_rank): best rank of any gold document, null without one; every query has a row."""
    hits = ranked.join(gold.select("query_id", "corpus_idx").distinct(), ["query_id", "corpus_idx"]).groupBy("query_id").agg(F.min("rank").alias("hit_rank"))
    return queries.select("query_id").distinct().join(hits, "query_id", "left")


def rank_metrics(hits: DataFrame, *keys: str) -> DataFrame:
    """Recall at 1, 5, 10, 20, mean reciprocal rank and nDCG at 10 over queries."""
    r = F.col("hit_rank")
    recall = lambda k: F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    return hits.groupBy(*keys).agg(
        F.count("*").alias("n"), recall(1), recall(5), recall(10), recall(20),
        F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.when(r <= 10, 1.0 / F.log2(r + 1.0)).otherwise(0.0)), 6).alias("ndcg_10"),
    )


def pareto(cells: DataFrame, gain: str, cost: str) -> DataFrame:
    """Cells that no other dominates (gain at least, cost at most, one strictly)."""
    a, b = cells.alias("a"), cells.alias("b")
    better = (F.col(f"b.{gain}") >= F.col(f"a.{gain}")) & (F.col(f"b.{cost}") <= F.col(f"a.{cost}")) & ((F.col(f"b.{gain}") > F.col(f"a.{gain}")) | (F.col(f"b.{cost}") < F.col(f"a.{cost}")))
    return a.join(b, better, "left_anti")


def histogram(rows: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n): fixed width, last bin closed, values outside dropped, empty bins kept."""
    width = (hi - lo) / bins
    v = F.col(value)
    placed = rows.filter((v >= lo) & (v <= hi)).select(F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def group_stats(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.round(F.min(v), 6).alias("least"),
        F.round(F.percentile(v, F.lit(0.5)), 6).alias("median"), F.round(F.max(v), 6).alias("most"), F.bool_and(v == 0).alias("all_zero"),
    )


def percentile_floor(value: Column, share: float) -> Column:
    return F.floor(F.round(F.percentile(value, F.lit(share)) * 100, 6)) / 100


def quantiles(rows: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """(key, q: the exact quantiles, linear between two values) of few groups of many values.

    Equal values are counted first, then buckets of values; only the buckets that
    hold a wanted place are sorted, so no task has all values of a group.
    """
    v, w = F.col(value), F.col("__m")
    seen = written(rows.filter(v.isNotNull()).groupBy(key, value).agg(F.count("*").alias("__m")))
    span = written(seen.groupBy(key).agg(F.sum(w).alias("__n"), F.min(v).cast("double").alias("__lo"), (F.max(v).cast("double") - F.min(v)).alias("__width")))
    width, at = F.col("__width"), F.lit(0.0)
    for k, share in enumerate(shares):
        at = F.when(F.col("__k") == k, share * (F.col("__n") - 1)).otherwise(at)
    wanted = span.select(key, "__n", F.explode(F.array(*map(F.lit, range(len(shares))))).alias("__k")).withColumn("__at", at)
    low = F.floor("__at")
    wanted = wanted.select(key, "__k", (F.col("__at") - low).alias("__part"), F.explode(F.array(low, F.least(low + 1, F.col("__n") - 1))).alias("__place"))
    bucket = F.when((width > 0) & (width < float("inf")), F.floor((v - F.col("__lo")) / width * (PLACES - 1))).otherwise(F.lit(0)).cast("long")
    placed = seen.join(F.broadcast(span), key).select(key, value, "__m", bucket.alias("__b"))
    upto = lambda *by, order: F.sum(w).over(Window.partitionBy(*by).orderBy(order))
    sizes = placed.groupBy(key, "__b").agg(F.sum(w).alias("__m")).withColumn("__before", upto(key, order="__b") - w)  # PLACES rows a group at most
    there = lambda before: (before <= F.col("__place")) & (F.col("__place") < before + w)
    chosen = sizes.join(F.broadcast(wanted), key).filter(there(F.col("__before"))).select(key, "__b", "__before").distinct()
    inside = placed.join(F.broadcast(chosen), [key, "__b"]).withColumn("__first", F.col("__before") + upto(key, "__b", order=value) - w)
    found = inside.join(F.broadcast(wanted), key).filter(there(F.col("__first"))).groupBy(key, "__k", "__part")
    ends = found.agg(F.min(v).alias("__x"), F.max(v).alias("__y"))
    q = F.when(F.col("__x") == F.col("__y"), F.col("__x")).otherwise(F.col("__x") + (F.col("__y") - F.col("__x")) * F.col("__part"))
    return ends.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", q.alias("__q")))), lambda r: r["__q"]).alias("q"))
