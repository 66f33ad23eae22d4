"""Whole jobs whose work grows with the input: draws, negatives, scores of all pairs, blends of ablated queries."""

from __future__ import annotations

import time

import duckdb
import numpy as np
from compare import SF, differences, oracle
from pyspark.sql import functions as F

from siftlake.operators import lexical_index as X
from siftlake.operators import metrics as M
from siftlake.operators import resampling as RS
from siftlake.operators import retrieval as R
from siftlake.operators import stats as S
from siftlake.plans.registry import ORACLE_SQL, QUERIES

SMALL = SF.replace("sf0.01", "sf0.001")


def test_resamples_share_the_ring(monkeypatch):
    """Where resamples overlap, their draws are made once, and each has the mean of its own places."""
    for n, iters in ((60, 500), (1_000_003, 20), (3_000_000, 2_000)):
        bounds, first, last, used = RS.stretches(n, iters, 20260626)
        size = np.diff(np.append(bounds, RS.RING))
        assert size[used].sum() <= min(n * iters, RS.RING)
        assert np.array_equal(np.add.reduceat(np.append(np.tile(size, 2), 0), np.column_stack((first, last)).ravel())[::2], np.full(iters, n))
    d = np.random.default_rng(4).normal(size=700)
    assert all(abs(RS.piece_sum(d, it * RS.STRIDE + 20260626, it * RS.STRIDE + 20260626 + 700) - d[RS.places(np.array([it]), 700, 20260626)].sum()) < 1e-9 for it in range(50))


def test_exact_p_of_many_pairs(spark):
    """The tail of 300,000 pairs is that of a plain sum, and takes no row or loop that grows with the square of them."""
    rows = [(k, n) for n in (255, 257, 5_000, 300_000) for k in (0, 1, n // 2 - 40, n // 2, n // 2 + 1, n // 2 + 60, n // 2 + 900, n) if 0 <= k <= n]
    start = time.time()
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", S.binomial_tail(F.col("k"), F.col("n"), F.lit(0.5)).alias("p")).collect()
    assert time.time() - start < 60
    for r in got:
        lf = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, r.n + 1)))))
        i = np.arange(r.k, r.n + 1)
        assert abs(r.p - min(1.0, np.exp(lf[r.n] - lf[i] - lf[r.n - i] + r.n * np.log(0.5)).sum())) < 1e-7


def test_negatives_make_no_row_for_a_pair_of_one_label(spark, tmp_path):
    """Draws meet their own labels; the result is that of the SQL, null labels included."""
    rows = [(k, None if k % 7 == 3 or k == 20 else k % 2) for k in range(400)]
    spark.createDataFrame(rows, "vec_id long, label long").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    out = QUERIES["j16_negatives_without_gold"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == sorted(con.execute(ORACLE_SQL["j16_negatives_without_gold"]).fetchall())
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "LeftAnti" not in plan and plan.count("Join ") == 1


def test_quantiles_without_a_task_of_all_values(spark):
    """Exact quantiles of values spread, equal and single, and none by an aggregate that holds a group's values."""
    rnd = np.random.default_rng(6)
    groups = {"a": np.round(rnd.normal(size=1500), 9), "b": np.repeat([0.25, 0.5], [900, 100]), "c": np.array([3.0]), "d": np.array([7.0] * 50)}
    rows = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("a", None)], "kind string, cos double")
    out = M.quantiles(rows, "kind", "cos", [0.1, 0.5, 0.9])
    got = {r.kind: r.q for r in out.collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert np.allclose(got[k], np.quantile(v, [0.1, 0.5, 0.9]), atol=1e-12)
    assert "percentile(" not in QUERIES["g3_threshold_calibration"](spark, SMALL)._jdf.queryExecution().analyzed().toString()


def test_trained_recall_by_language(spark):
    """Every retriever has its rate over all queries and over those of each language."""
    rows = {(r.retriever, r.tag): r for r in QUERIES["r10_trained_recall"](spark, SMALL).collect()}
    assert {name for name, _ in rows} == {"trained", "hashed", "bm25"}
    for name in ("trained", "hashed", "bm25"):
        parts = [rows[name, tag] for tag in ("en", "ko") if (name, tag) in rows]
        assert sum(r.n for r in parts) == rows[name, "overall"].n > 0 and sum(r.hits for r in parts) == rows[name, "overall"].hits


def test_all_pairs_stay_in_matrices(spark, monkeypatch):
    """The pairs of queries and documents are not joined, shuffled or sorted, and rows are those of the SQL."""

    def pairs(*_, **__):
        raise AssertionError("a joined row for every token of a pair")

    monkeypatch.setattr(R, "bm25_scores", pairs)
    monkeypatch.setattr(X, "CELLS", 1 << 12)
    con = oracle(SMALL)
    for name in ("r8_minmax", "r4_two_scorers_agree"):
        assert not differences(spark, con, name, QUERIES[name], ORACLE_SQL[name], SMALL)


def test_a_wrong_scorer_is_found(spark):
    """A walk with another weight, or without a token, differs in the pairs that it touches."""
    docs = spark.createDataFrame([(k, "a b" if k % 2 else "b c c") for k in range(40)], "corpus_idx long, text string")
    index, q = R.bm25_index(docs), spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, tok string, m long")
    idf = {r.tok: r.idf for r in index.idf.collect()}
    for walk, factor, want in ((["a", "b", "b"], 1.0, (40, 0)), (["a", "b"], 1.0, (40, 40)), (["b", "b"], 1.0, (40, 20)), (["a", "b", "b"], 1.1, (40, 40))):
        walks = spark.createDataFrame([(1, walk, [idf[t] * factor for t in walk])], "query_id long, walk array<string>, idfs array<double>")
        assert tuple(X.agreement(index, q, walks).first()) == want


def test_ablated_queries_are_blended_once(spark):
    """The contrasts read hits at several places; the passes over all pairs are not repeated for each."""
    out = QUERIES["x1_decay_contrasts"](spark, SMALL)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInArrow" not in plan and "MapInArrow" not in plan
    assert out.count() == 25
