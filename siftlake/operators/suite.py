"""Suites over hit vectors: rates, paired contrasts, equivalence, exposure matrices, frontiers, evidence tiers.

A hit vector is a table (keys, query_id, hit); vectors are paired by query_id,
never by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.operators import resampling as RS
from siftlake.operators import stats as S
from siftlake.operators.resampling import ITERS, SEED  # noqa: F401

# The margins of equivalence and the primary one.
DELTAS, PRIMARY_DELTA = (0.03, 0.05, 0.10, 0.15, 0.20), 0.05


def hit_vectors(ranked: DataFrame, gold: DataFrame, queries: DataFrame, depth: int, *keys: str) -> DataFrame:
    """(keys, query_id, hit): 1 if any gold document is within the depth; every query has a row for each combination of keys."""
    found = ranked.filter(F.col("rank") <= depth).join(gold.select("query_id", "corpus_idx").distinct(), ["query_id", "corpus_idx"], "left_semi")
    found = found.select(*keys, "query_id").distinct().withColumn("hit", F.lit(1))
    grid = queries.select("query_id").distinct()
    if keys:
        grid = ranked.select(*keys).distinct().join(grid)
    return grid.join(found, [*keys, "query_id"], "left").select(*keys, "query_id", F.coalesce("hit", F.lit(0)).alias("hit"))


def rates(hits: DataFrame, *keys: str) -> DataFrame:
    """Hits, queries, rate and exact 95 % interval."""
    c = hits.groupBy(*keys).agg(F.sum("hit").cast("long").alias("k"), F.count("*").alias("n"))
    ci = S.clopper_pearson(F.col("k"), F.col("n"))
    return c.select(*keys, "k", "n", F.round(F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0), 4).alias("rate"), F.round(ci["lo"], 4).alias("lo"), F.round(ci["hi"], 4).alias("hi"))


def paired(hits: DataFrame, by: str, pairs: list[tuple[str, str, str]], *keys: str) -> DataFrame:
    """(keys, comparison, query_id, a, b, d) of each (name, first, second) value of ``by``, joined by query."""
    x = hits.select(*keys, "query_id", F.col(by).alias("x"), F.col("hit").alias("a"))
    y = hits.select(*keys, "query_id", F.col(by).alias("y"), F.col("hit").alias("b"))
    wanted = F.array(*[F.struct(F.lit(n).alias("comparison"), F.lit(p).alias("x"), F.lit(q).alias("y")) for n, p, q in pairs])
    x = x.withColumn("w", F.explode(wanted)).filter("x = w.x").select(*keys, "query_id", "w.comparison", "w.y", "a")
    return x.join(y, [*keys, "query_id", "y"]).select(*keys, "comparison", "query_id", "a", "b", (F.col("a") - F.col("b")).cast("double").alias("d"))


def bootstrap(pairs: DataFrame, *keys: str, iters: int = ITERS, conf: float = 0.95, seed: str = SEED) -> DataFrame:
    """(keys, n, mean, lo, hi): percentile interval of the mean of differences -1, 0 and 1.  n = 0 gives no row."""
    d = F.col("d")
    c = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses")).filter("n > 0")
    out = RS.percentile_interval(c, *keys, iters=iters, conf=conf, seed=seed)
    return out.select(*keys, "n", F.round((F.col("wins") - F.col("losses")) / F.col("n"), 6).alias("mean"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def contrasts(pairs: DataFrame, *keys: str, iters: int = ITERS, values: bool = False) -> DataFrame:
    """Wins, losses, ties, exact p, mean difference, its interval and whether that excludes zero.

    values: the differences d are any numbers, not those of a and b.
    """
    m = S.mcnemar(pairs, *keys).withColumn("n", F.col("wins") + F.col("losses") + F.col("ties"))
    if values:
        out = m.join(RS.value_interval(pairs, *keys, iters=iters), list(keys)).join(pairs.groupBy(*keys).agg(F.avg("d").alias("mean")), list(keys))
    else:
        out = RS.percentile_interval(m, *keys, iters=iters).withColumn("mean", (F.col("wins") - F.col("losses")) / F.col("n"))
    out = out.withColumns({c: F.round(c, 6) for c in ("mean", "lo", "hi")})
    zero = (F.col("lo") > 0) | (F.col("hi") < 0)
    return out.select(*keys, "n", "wins", "losses", "ties", "discordant", F.round("p_two_sided", 6).alias("p_two_sided"), F.round("p_one_sided", 6).alias("p_one_sided"), "mean", "lo", "hi", zero.alias("excludes_zero"))


def absolute_only(rate_rows: DataFrame, present: DataFrame, *keys: str) -> DataFrame:
    """Rates whose vectors are missing: tests stay null and the reason is given; nothing is made up."""
    known = present.select(*keys).distinct().withColumn("there", F.lit(True))
    out = rate_rows.join(known, list(keys), "left")
    return out.filter("there is null").drop("there").withColumns({"mean_diff": F.lit(None).cast("double"), "p_two_sided": F.lit(None).cast("double"), "reason": F.lit("hit vectors missing: absolute rate only")})


def equivalence(pairs: DataFrame, *keys: str, deltas=DELTAS) -> DataFrame:
    """Two one-sided tests at every margin with the largest p, the verdict and the n that would settle it."""
    t = S.tost(pairs, list(deltas), *keys)
    return t.select(*keys, "delta", "n", F.round("m", 6).alias("m"), F.round("p_max", 5).alias("p_max"), "equivalent", "n_required")


def exposure_matrix(rate_rows: DataFrame, exposures: DataFrame, actionable: Column) -> DataFrame:
    """Cells (index_mode, return_mode): recall by index mode, exposure by both, and the cut against the same mode and the full text.

    rate_rows: (index_mode, k, n, rate); exposures: (index_mode, return_mode, exposure).
    """
    cells = exposures.join(rate_rows, "index_mode")
    same = exposures.filter("index_mode = return_mode").select("index_mode", F.col("exposure").alias("own"))
    full = cells.filter("index_mode = 'full_text' and return_mode = 'full_text'").select(F.col("exposure").alias("base"), F.col("rate").alias("base_rate"))
    out = cells.join(same, "index_mode").join(F.broadcast(full))
    cut = lambda of: F.round(100 * (F.col(of) - F.col("exposure")) / F.col(of), 1)
    return out.select("index_mode", "return_mode", "k", "n", "rate", "exposure", actionable.alias("actionable"), cut("own").alias("cut_same_mode"), cut("base").alias("cut_baseline"), F.round(F.col("rate") - F.col("base_rate"), 4).alias("rate_delta"))


def best_point(cells: DataFrame) -> DataFrame:
    """The cheapest of the actionable cells with the highest rate."""
    return cells.filter("actionable").orderBy(F.desc("rate"), "exposure", "index_mode", "return_mode").limit(1)


def inflection(levels: DataFrame, *keys: str) -> DataFrame:
    """(keys, first_drop, deepest_safe) of (keys, level, mean, significant): the first significant drop and the level before it."""
    drop = F.min(F.when(F.col("significant") & (F.col("mean") < 0), F.col("level")))
    return levels.groupBy(*keys).agg(drop.alias("first_drop"), F.max("level").alias("last")).select(*keys, "first_drop", F.coalesce(F.col("first_drop") - 1, F.col("last")).alias("deepest_safe"))


def evidence(levels: DataFrame, *keys: str, delta: float = PRIMARY_DELTA) -> DataFrame:
    """Adds tier and recommended of (keys, level, mean, significant, equivalent, confounded), levels from 1.

    D: the query drifted to its answer; C: the loss reaches the margin or is
    significant; A: equivalence is shown; B: none of these.  Recommended is the
    deepest level before the first C or D, 0 if that is the first.
    """
    loss = (F.col("mean") <= -delta) | (F.col("significant") & (F.col("mean") < 0))
    tier = F.when(F.col("confounded"), "D").when(loss, "C").when(F.col("equivalent"), "A").otherwise("B")
    t = levels.withColumn("tier", tier)
    w = Window.partitionBy(*keys)
    stop = F.min(F.when(F.col("tier").isin("C", "D"), F.col("level"))).over(w)
    return t.withColumn("recommended", F.coalesce(stop - 1, F.max("level").over(w)))


def drift_verdict(significant: Column, shift: Column, margin_up: Column) -> Column:
    """What a shift of the queries towards their answers means."""
    up = shift > 0
    return F.when(significant & up & margin_up, "confounded").when(significant & up, "register_shift").when(~significant, "benign").otherwise("diverged")


def version_verdict(contrast_rows: DataFrame) -> DataFrame:
    """helps, if the interval of any index mode lies above zero, and which."""
    up = F.collect_set(F.when(F.col("lo") > 0, F.col("index_mode")))
    return contrast_rows.agg(F.array_join(F.array_sort(up), ",").alias("modes")).select(F.when(F.col("modes") != "", "helps").otherwise("no_significant_gain").alias("label"), "modes")


def conservative_level(levels: DataFrame, value: str, *keys: str) -> DataFrame:
    """The lowest level over models, and the models that set it."""
    w = Window.partitionBy(*keys)
    low = levels.withColumn("low", F.min(value).over(w)).filter(F.col(value) == F.col("low"))
    return low.groupBy(*keys).agg(F.max("low").alias(value), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))
