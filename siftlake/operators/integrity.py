"""Shard, slice and claim checks as constraint queries: each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shard_violations(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(rule, key, n) of a hits table (model, alpha, query_id, hit): domain, missing, unknown and repeated ids."""
    domain = hits.filter(~F.col("hit").isin(0, 1) | F.col("hit").isNull()).groupBy(F.lit("domain").alias("rule"), F.col("model").alias("key")).agg(F.count("*").alias("n"))
    unknown = hits.join(queries, "query_id", "left_anti").groupBy(F.lit("unknown_id").alias("rule"), F.col("model").alias("key")).agg(F.count("*").alias("n"))
    repeated = hits.groupBy("model", "alpha", "query_id").count().filter("count > 1").groupBy(F.lit("repeated").alias("rule"), F.col("model").alias("key")).agg(F.count("*").alias("n"))
    expected = queries.select("query_id").distinct().count()
    short = hits.groupBy("model", "alpha").agg(F.count_distinct("query_id").alias("have")).filter(F.col("have") < expected).groupBy(F.lit("missing").alias("rule"), F.col("model").alias("key")).agg(F.count("*").alias("n"))
    return domain.unionByName(unknown).unionByName(repeated).unionByName(short)


def anchor_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of the anchor (query_id, hit) that differ between two shards; empty: they may be merged."""
    x, y = (d.select("query_id", "hit") for d in (a, b))
    return x.exceptAll(y).union(y.exceptAll(x))


def slice_violations(rows: DataFrame, least: int = 25, korean: float = 0.4) -> DataFrame:
    """(rule, n) of a query slice (query_id, lang, gold): size, language share, unique ids and golds."""
    size = rows.agg(F.lit("too_few").alias("rule"), F.count("*").alias("n")).filter(F.col("n") < least)
    share = rows.agg(F.lit("too_little_korean").alias("rule"), F.count("*").alias("n"), F.avg((F.col("lang") == "ko").cast("int")).alias("s")).filter(F.col("s") < korean).drop("s")
    ids = rows.groupBy("query_id").count().filter("count > 1").agg(F.lit("repeated_id").alias("rule"), F.count("*").alias("n")).filter("n > 0")
    gold = rows.groupBy("gold").count().filter("count > 1").agg(F.lit("repeated_gold").alias("rule"), F.count("*").alias("n")).filter("n > 0")
    return size.union(share).union(ids).union(gold)


def check_claims(expected: DataFrame, actual: DataFrame, tolerance: float = 5e-4) -> DataFrame:
    """(claim, expected, actual, status): OK, MISMATCH, SKIP (nothing expected), NEW or MISSING."""
    e, a = expected.select("claim", F.col("value").alias("expected"), F.lit(True).alias("ine")), actual.select("claim", F.col("value").alias("actual"), F.lit(True).alias("ina"))
    status = F.when(F.col("ine").isNull(), "NEW").when(F.col("ina").isNull(), "MISSING").when(F.col("expected").isNull(), "SKIP").when(F.abs(F.col("expected") - F.col("actual")) <= tolerance, "OK").otherwise("MISMATCH")
    return e.join(a, "claim", "full_outer").select("claim", "expected", "actual", status.alias("status"))


def first_use(rows: DataFrame, code: str, order: str) -> DataFrame:
    """Rows whose code an earlier row (by ``order``) has already used; one small row a code is what is joined back."""
    first = rows.groupBy(code).agg(F.min(order).alias("first"))
    return rows.join(first, code).filter(F.col("first") < F.col(order)).drop("first")


def gate_verdict(scored: DataFrame, most_jaccard: float, tau: float) -> DataFrame:
    """Whether a query passes: less lexical overlap and less similarity with its answer than allowed."""
    lexical, semantic = F.col("jaccard") < most_jaccard, F.col("cos") < tau
    return scored.withColumns({"lexical_pass": lexical, "semantic_pass": semantic, "passed": lexical & semantic, "only_semantic": ~semantic & lexical})


def gate_is_independent(model, evaluated: list[str]):
    """A gate's model must not be among the evaluated ones."""
    return ~model.isin(*evaluated)


def bundle_violations(bundle: DataFrame, recomputed: DataFrame, depths: list[str]) -> DataFrame:
    """(rule, model, n) of a bundle (model, retriever, query_id, hit) against vectors recomputed from the source.

    anchor: hits that differ; length: vectors with another number of queries;
    monotone: a hit at depths[0] that is lost at depths[1].
    """
    truth = recomputed.select("model", "retriever", "query_id", F.col("hit").alias("want"))
    anchor = bundle.join(truth, ["model", "retriever", "query_id"]).filter("hit <> want").groupBy(F.lit("anchor").alias("rule"), "model").agg(F.count("*").alias("n"))
    size = recomputed.select("query_id").distinct().agg(F.count("*").alias("size"))
    length = bundle.groupBy("model", "retriever").agg(F.count("*").alias("c")).join(F.broadcast(size)).filter("c <> size").groupBy(F.lit("length").alias("rule"), "model").agg(F.count("*").alias("n"))
    at = lambda r: F.max(F.when(F.col("retriever") == r, F.col("hit")))
    monotone = bundle.groupBy("model", "query_id").agg(at(depths[0]).alias("a"), at(depths[1]).alias("b")).filter("a > b").groupBy(F.lit("monotone").alias("rule"), "model").agg(F.count("*").alias("n"))
    return anchor.union(length).union(monotone)
