"""Exact paired statistics as Column expressions and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# One-sided 5 % and 80 % power.
Z_ALPHA, Z_BETA = 1.6448536269514722, 0.8416212335729143
#: Trials up to which a binomial tail is summed term by term.
SUMMED = 256


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for X ~ Binomial(n, p): the sum in logs up to n = ``SUMMED``, whose terms grow with the square of n, the incomplete beta function above; n = 0 gives 1."""
    def ln_choose(m, i):
        return F.aggregate(F.when(i > 0, F.sequence(F.lit(1), i)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, j: s + F.log((m - i + j).cast("double") / j))

    k, n = k.cast("int"), n.cast("int")
    term = lambda s, i: s + F.exp(ln_choose(n, i) + i * F.log(p) + (n - i) * F.log(1 - p))
    total = F.aggregate(F.when((k <= n) & (n <= SUMMED), F.sequence(k, n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), term)
    inner = (k >= 1) & (k <= n)
    beta = F.when(inner, upper_tail(F.when(inner, k).otherwise(1), F.when(inner, n).otherwise(1), p)).otherwise(F.when(k < 1, 1.0).otherwise(0.0))
    return F.when(n == 0, 1.0).when(n <= SUMMED, F.least(F.lit(1.0), total)).otherwise(F.least(F.lit(1.0), beta))


def mcnemar(pairs: DataFrame, *keys: str, a: str = "a", b: str = "b") -> DataFrame:
    """Wins, losses, ties and exact p of paired 0/1 outcomes."""
    x, y = F.col(a), F.col(b)
    c = pairs.groupBy(*keys).agg(F.sum((x > y).cast("long")).alias("wins"), F.sum((y > x).cast("long")).alias("losses"), F.sum((x == y).cast("long")).alias("ties"))
    disc = F.col("wins") + F.col("losses")
    two = F.least(F.lit(1.0), 2 * binomial_tail(F.greatest("wins", "losses"), disc, F.lit(0.5)))
    one = binomial_tail(F.col("wins"), disc, F.lit(0.5))
    return c.withColumns({"discordant": disc, "p_two_sided": F.when(disc == 0, 1.0).otherwise(two), "p_one_sided": F.when(disc == 0, 1.0).otherwise(one)})


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1: Stirling's series at x + 8."""
    y, below = x + 8, F.lit(1.0)
    for i in range(8):
        below = below * (x + i)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - 1 / (1680 * y * y * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + series - F.log(below)


def upper_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for X ~ Binomial(n, p), 1 <= k <= n and 0 < p < 1: the incomplete beta function by its continued
    fraction, whose terms grow with the root of n only."""
    a, b = k.cast("double"), (n - k + 1).cast("double")
    far = p >= (a + 1) / (a + b + 2)
    x, u, v = F.when(far, 1 - p).otherwise(p), F.when(far, b).otherwise(a), F.when(far, a).otherwise(b)

    def term(t, j):
        m = F.floor(j / 2).cast("double")
        odd = -(u + m) * (u + v + m) * x / ((u + 2 * m) * (u + 2 * m + 1))
        return F.when(j % 2 == 1, odd).otherwise(m * (v - m) * x / ((u + 2 * m - 1) * (u + 2 * m))) / (1 + t)

    terms = F.sequence((F.lit(200) + 8 * F.ceil(F.sqrt(n.cast("double")))).cast("int"), F.lit(1), F.lit(-1))
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.log(p) + b * F.log(1 - p)) / u
    part = front / (1 + F.aggregate(terms, F.lit(0.0), term))
    return F.when(far, 1 - part).otherwise(part)


def clopper_pearson(k: Column, n: Column, conf: float = 0.95, steps: int = 50) -> Column:
    """Struct (lo, hi): exact interval by bisection on the binomial tail, for counts of any size."""
    tail = (1 - conf) / 2

    def bisect(go_up):
        first = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def step(s, _):
            mid = (s["lo"] + s["hi"]) / 2
            up = go_up(mid)
            return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

        end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step)
        return (end["lo"] + end["hi"]) / 2

    lo = F.when(k == 0, 0.0).otherwise(bisect(lambda p: upper_tail(k, n, p) < tail))
    hi = F.when(k == n, 1.0).otherwise(bisect(lambda p: 1 - upper_tail(k + 1, n, p) > tail))
    return F.struct(F.when(n == 0, 0.0).otherwise(lo).alias("lo"), F.when(n == 0, 0.0).otherwise(hi).alias("hi"))


def normal_upper(z: Column) -> Column:
    """P(Z >= z) by the rational approximation of Abramowitz and Stegun 26.2.17 (error below 7.5e-8)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def tost(pairs: DataFrame, deltas: list[float], *keys: str, d: str = "d") -> DataFrame:
    """Two one-sided tests of the mean difference against each margin, and the n that would settle it."""
    s = pairs.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("sd")).withColumn("delta", F.explode(F.array(*map(F.lit, deltas))))
    m, sd, delta = F.col("m"), F.col("sd"), F.col("delta")
    se = sd / F.sqrt("n")
    low = F.when(se == 0, F.when(m > -delta, 0.0).otherwise(1.0)).otherwise(normal_upper((m + delta) / se))
    high = F.when(se == 0, F.when(m < delta, 0.0).otherwise(1.0)).otherwise(normal_upper((delta - m) / se))
    need = F.when((sd > 0) & (F.abs(m) < delta), F.ceil(F.pow((Z_ALPHA + Z_BETA) * sd / (delta - F.abs(m)), F.lit(2.0))))
    top = F.when(F.col("n") >= 2, F.greatest(low, high))
    return s.select(*keys, "delta", "n", "m", se.alias("se"), top.alias("p_max"), F.coalesce(top < 0.05, F.lit(False)).alias("equivalent"), F.when(F.col("n") >= 2, need).alias("n_required"))


def holm(rows: DataFrame, family: str, p: str, order: str) -> DataFrame:
    """Step-down adjusted p within each family; ties in the order of ``order``."""
    w = Window.partitionBy(family).orderBy(p, order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    k = F.count("*").over(Window.partitionBy(family))
    raw = rows.withColumn("family_size", k).withColumn("adj", F.least(F.lit(1.0), F.col(p) * (F.col("family_size") - F.row_number().over(w) + 1)))
    raw = raw.withColumn("p_adjusted", F.max("adj").over(run)).drop("adj")
    return raw.withColumn("significant", F.min((F.col("p_adjusted") < 0.05).cast("int")).over(run) == 1)


def draw(n: Column, *parts) -> Column:
    """Pseudo-random integer in 0..n-1 from the md5 of the parts; the same in any SQL engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long"), n)


def boundary_artifact(wins: Column, n: Column) -> Column:
    """Chance that a resample of n pairs misses all wins."""
    return F.pow((n - wins) / n, n)
