"""Results as facts, claims about them, and the registry's versions."""

from __future__ import annotations

import pytest

from siftlake import jobs
from siftlake.operators import claims as K
from siftlake.sources.tables import Versions

ROWS = "model string, level int, rate double, note string, fine boolean, list array<int>"


def result(spark):
    return spark.createDataFrame([("a", 1, 0.5, "x", True, [1]), ("a", 2, None, None, None, None), (None, 1, 0.25, "y", False, []), ("b", 1, 1.0, "x", True, [1]), ("b", 1, 0.0, "z", True, [1])], ROWS)


def found(spark):
    return K.assemble([K.facts(result(spark), "rates", ["model", "level"]), K.facts(result(spark).limit(0), "empty", ["model"])])


def claim(claim, key, field, expected=None, stated=None, tolerance=None, section="rates"):
    return (claim, section, key, field, expected, stated, tolerance)


def test_facts_of_any_columns(spark):
    rows = found(spark)
    assert rows.columns == ["section", "key", "field", "value", "said"] and rows.count() == 15  # rate, note and fine of five rows
    got = {(r.key, r.field): (r.value, r.said) for r in rows.filter("key not like 'b|%'").collect()}
    assert got[("a|1", "rate")] == (0.5, None) and got[("a|1", "note")] == (None, "x") and got[("a|1", "fine")] == (1.0, None)
    assert got[("a|2", "rate")] == (None, None) and got[("-|1", "rate")] == (0.25, None)


def test_each_status(spark):
    given = [
        claim("near", "a|1", "rate", 0.5004), claim("far", "a|1", "rate", 0.51), claim("wide", "a|1", "rate", 0.51, tolerance=0.02), claim("zero", "a|1", "rate", 0.5, tolerance=0.0),
        claim("text", "a|1", "note", stated="x"), claim("other text", "a|1", "note", stated="y"), claim("number of a text", "a|1", "note", 1.0), claim("text of a number", "a|1", "rate", stated="x"),
        claim("truth", "-|1", "fine", 0.0), claim("no value", "a|2", "rate", 0.5), claim("no fact", "c|1", "rate", 0.5), claim("no field", "a|1", "speed", 0.5), claim("two facts", "b|1", "rate", 0.5),
        claim("not run", "a|1", "rate", 0.5, section="empty"), claim("new", "a|1", "rate"), claim("near", "a|1", "rate", 0.5004), claim(None, None, None), claim("no section", "a|1", "rate", 0.5, section=None),
    ]
    got = K.check(spark.createDataFrame(given, K.CLAIMS), found(spark))
    assert got.count() == len(given)
    assert {r.claim: r.status for r in got.collect()} == {
        "near": "OK", "far": "MISMATCH", "wide": "OK", "zero": "OK", "text": "OK", "other text": "MISMATCH", "number of a text": "MISMATCH", "text of a number": "MISMATCH",
        "truth": "OK", "no value": "SKIP", "no fact": "ERROR", "no field": "ERROR", "two facts": "ERROR", "not run": "SKIP", "new": "NEW", None: "ERROR", "no section": "SKIP",
    }
    assert {r.status for r in K.check(spark.createDataFrame(given, K.CLAIMS), found(spark).limit(0)).collect()} == {"SKIP"}
    assert K.check(spark.createDataFrame([], K.CLAIMS), found(spark)).count() == 0


def test_registry_is_updated_in_versions(spark, tmp_path):
    out, folder = str(tmp_path / "out"), f"file://{tmp_path}/registry"
    found(spark).write.parquet(f"{out}/u20_summary")
    with pytest.raises(ValueError):
        jobs.verify(spark, out, folder)
    given = [claim("far", "a|1", "rate", 0.9), claim("text", "a|1", "note", stated="y"), claim("new", "-|1", "rate"), claim("no fact", "c|1", "rate", 0.5), claim("right", "a|1", "fine", 1.0)]
    Versions(spark, folder).adopt(spark.createDataFrame(given, K.CLAIMS), "claims-0")
    assert jobs.verify(spark, out, folder) == {"MISMATCH": 2, "NEW": 1, "ERROR": 1, "OK": 1}
    assert jobs.verify(spark, out, folder, update=True) == {"UPDATED": 3, "ERROR": 1, "OK": 1}
    assert jobs.verify(spark, out, folder) == {"OK": 4, "ERROR": 1}
    got = {r.claim: (r.expected, r.stated) for r in Versions(spark, folder).read().collect()}
    assert got == {"far": (0.5, None), "text": (None, "x"), "new": (0.25, None), "no fact": (0.5, None), "right": (1.0, None)}
    Versions(spark, folder).revert()
    assert jobs.verify(spark, out, folder) == {"MISMATCH": 2, "NEW": 1, "ERROR": 1, "OK": 1}


def test_claims_that_name_a_hot_fact_lose_no_row(spark):
    claims = spark.range(5000).selectExpr("cast(id as string) claim", "'rates' section", "'a|1' key", "'rate' field", "0.5D expected", "cast(null as string) stated", "cast(null as double) tolerance")
    assert K.check(claims, found(spark)).filter("status = 'OK'").count() == 5000
