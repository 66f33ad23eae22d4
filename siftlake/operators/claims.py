"""Results as facts, and claims about them.

A fact is one field of one row of a result: (section, key, field, value, said),
value for numbers and truth values, said for text.  The facts of several results
are one table, whatever their columns: the assembly of all statistics.  A claim
(claim, section, key, field, expected, stated, tolerance) says what a fact is;
checking joins claims with the facts they name, so only those are looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACTS = "section string, key string, field string, value double, said string"
CLAIMS = "claim string, section string, key string, field string, expected double, stated string, tolerance double"
#: Tolerance of a claim that names none.
TOLERANCE = 5e-4


def key_of(*columns: str):
    """The columns' values with bars between them; null is ``-``."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))


def facts(rows: DataFrame, section: str, keys: list[str], fields: list[str] | None = None) -> DataFrame:
    """Facts of the fields (all other columns of a simple kind, if none are named) of every row; nulls are facts without a value."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    text = lambda c: isinstance(kinds[c], T.StringType)
    simple = lambda c: isinstance(kinds[c], (T.NumericType, T.BooleanType, T.StringType))
    fields = fields if fields is not None else [c for c in rows.columns if c not in keys and simple(c)]
    number, word = F.lit(None).cast("double"), F.lit(None).cast("string")
    each = [F.struct(F.lit(c).alias("field"), (number if text(c) else F.col(c).cast("double")).alias("value"), (F.col(c) if text(c) else word).alias("said")) for c in fields]
    return rows.select(F.lit(section).alias("section"), key_of(*keys).alias("key"), F.explode(F.array(*each)).alias("f")).select("section", "key", "f.field", "f.value", "f.said")


def assemble(parts: list[DataFrame]) -> DataFrame:
    """One table of all facts."""
    return reduce(DataFrame.unionByName, parts)


def check(claims: DataFrame, found: DataFrame) -> DataFrame:
    """The claims with actual, heard (its text) and status.

    SKIP: the section has no facts, or the fact no value; ERROR: no such fact, or
    several; NEW: nothing is expected yet; OK, MISMATCH: within the tolerance
    (numbers) or equal (text), or not.
    """
    at = ["section", "key", "field"]
    named = found.join(claims.select(*at).distinct(), at, "left_semi").groupBy(*at).agg(F.count("*").alias("n"), F.max("value").alias("actual"), F.max("said").alias("heard"))
    ran = found.join(claims.select("section").distinct(), "section", "left_semi").select("section").distinct().withColumn("ran", F.lit(True))
    near = F.abs(F.col("actual") - F.col("expected")) <= F.coalesce("tolerance", F.lit(TOLERANCE))
    right = F.when(F.col("stated").isNotNull(), F.col("heard").eqNullSafe(F.col("stated"))).otherwise(F.coalesce(near, F.lit(False)))
    status = (
        F.when(F.col("ran").isNull(), "SKIP").when(F.col("n").isNull() | (F.col("n") > 1), "ERROR").when(F.col("actual").isNull() & F.col("heard").isNull(), "SKIP")
        .when(F.col("expected").isNull() & F.col("stated").isNull(), "NEW").when(right, "OK").otherwise("MISMATCH")
    )
    out = claims.join(named, at, "left").join(ran, "section", "left").withColumn("status", status)
    several = F.col("n") > 1
    return out.select("claim", *at, "expected", "stated", "tolerance", F.when(~several, F.col("actual")).alias("actual"), F.when(~several, F.col("heard")).alias("heard"), "status")


def updated(checked: DataFrame) -> DataFrame:
    """The claims with what was found in place of what was expected where the two differ or nothing was; such rows are UPDATED."""
    take = F.col("status").isin("MISMATCH", "NEW")
    return checked.select("claim", "section", "key", "field", F.when(take, F.col("actual")).otherwise(F.col("expected")).alias("expected"), F.when(take, F.col("heard")).otherwise(F.col("stated")).alias("stated"), "tolerance", F.when(take, "UPDATED").otherwise(F.col("status")).alias("status"))
