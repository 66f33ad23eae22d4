"""Stored index, blocks with balls, grids, passages, resampling and kept tables against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.operators import blocks as V
from siftlake.operators import lexical_index as X
from siftlake.operators import resampling as RS
from siftlake.operators import retrieval as R
from siftlake.operators.passages import held_passages
from siftlake.sources import store


@pytest.mark.parametrize("seed", [1, 2])
def test_held_passages(spark, seed):
    rnd = random.Random(seed)
    words = ["ab", "ba", "é中", "x", "abab", "hello world", "\U0001f600"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 30, 200])))) for i in range(120)]
    docs += [(7, None), (None, docs[5][1]), (3, docs[5][1]), (None, "")]
    passages = []
    for j in range(200):
        text = rnd.choice(docs)[1] or ""
        a, n = rnd.randrange(len(text) + 1), rnd.choice([0, 1, 2, 3, 5, 7, 8, 12, 20, 30, 31, 32, 50, 200])
        passages.append((j % 190, text[a : a + n] + ("z" if rnd.random() < 0.2 else "")))
    passages += [(1000, None), (1001, docs[9][1]), (1002, "ab" * 20)]
    d, p = spark.createDataFrame(docs, "corpus_idx long, text string"), spark.createDataFrame(passages, "query_id long, passage string")
    want = sorted(((i, k) for i, x in passages for k, t in docs if x is not None and t is not None and x in t), key=repr)
    assert sorted((tuple(r) for r in held_passages(d, p).collect()), key=repr) == want
    some = p.filter("length(passage) > 3")
    plan = held_passages(d, some)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert held_passages(d.limit(0), p).collect() == [] and held_passages(d, p.limit(0)).collect() == []


def test_winnowed_fingerprints_of_a_part_are_those_of_the_whole():
    rnd = np.random.default_rng(3)
    text = rnd.integers(97, 100, 3000).astype(np.uint64)
    for lo, n in ((0, 31), (5, 31), (700, 40), (2000, 1000)):
        assert set(V_marks(text[lo : lo + n])) <= set(V_marks(text))
        assert len(V_marks(text[lo : lo + n]))


def V_marks(x):
    from siftlake.operators.passages import fingerprints

    return fingerprints(x, 16).tolist()


def plain_bm25(docs, queries, k):
    n = len(docs)
    length = {i: len(t) for i, t in docs.items()}
    avgdl = sum(length.values()) / n or 1.0
    df = {}
    for t in docs.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for q, words in queries.items():
        scores = {}
        for i, t in docs.items():
            for w in words:
                if f := t.count(w):
                    idf = math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1)
                    scores[i] = scores.get(i, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[i] / avgdl))
        best = sorted((-round(s, 9), i) for i, s in scores.items())[:k]
        out += [(q, i, round(-s, 6), r) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_ranges_are_skipped_and_results_stay(spark, monkeypatch):
    """Rare words stand in few ranges: most are ruled out by their bounds."""
    monkeypatch.setattr(X, "RANGE", 8)
    rnd = random.Random(4)
    docs = {i: [rnd.choice("abc") for _ in range(rnd.randrange(1, 6))] + (["rare"] * 3 if i in (40, 41, 43, 300) else []) for i in range(600)}
    queries = {1: ["rare", "a"], 2: ["b"], 3: ["rare"], 4: ["none"], 5: ["a", "a", "c"]}
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "corpus_idx long, text string").repartition(3)
    q = spark.createDataFrame([(i, " ".join(t)) for i, t in queries.items()], "query_id long, text string")
    index = R.bm25_index(d)
    got = X.search(index, R.query_tokens(q), 3)
    full = [(r.query_id, r.corpus_idx, round(r.score, 6), r["rank"]) for r in got.filter("score > 0").collect()]
    assert sorted(full) == plain_bm25(docs, queries, 3)
    pairs = X.surviving(index, X.Asked.of(index, R.query_tokens(q)), 3).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("chosen").alias("kept")).collect()
    share = {r.query_id: (r.kept, r.n) for r in pairs}
    assert share[1][0] <= 5 and share[1][1] > 60, share
    assert sorted({r.tok: r.df for r in index.idf.collect()}.items()) == [("a", sum("a" in t for t in docs.values())), ("b", sum("b" in t for t in docs.values())), ("c", sum("c" in t for t in docs.values())), ("rare", 4)]


def test_index_of_odd_rows(spark):
    d = spark.createDataFrame([(0, None), (1, ""), (2, "x y"), (None, "x"), (-5, "y")], "corpus_idx long, text string")
    index = R.bm25_index(d)
    assert (index.n, index.low) == (4, [-5, 0, 1, 2])
    q = spark.createDataFrame([(1, "x"), (2, None)], "query_id long, text string")
    assert [(r.corpus_idx, r["rank"], r.score > 0) for r in R.bm25_topk(d, q, 3).orderBy("rank").collect()] == [(2, 1, True), (-5, 2, False), (0, 3, False)]
    assert R.bm25_topk(d.limit(0), q, 3).collect() == []


def test_balls_rule_blocks_out(spark, monkeypatch):
    """Clustered vectors: the rows are those of all products, most blocks are not read."""
    monkeypatch.setattr(V, "BLOCK", 20)
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(30, 8))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = np.concatenate([c + 0.02 * rnd.normal(size=(40, 8)) for c in centres])
    x = np.concatenate([x, np.repeat(x[:1], 50, 0)])
    v = spark.createDataFrame([(k, [float(c) for c in r]) for k, r in enumerate(x)] + [(9000, None), (None, [0.0] * 8)], "corpus_idx long, v array<double>").repartition(4)
    asked = list(range(0, 1200, 100))
    q = spark.createDataFrame([(k, [float(c) for c in x[k]]) for k in asked] + [(9001, None)], "query_id long, q array<double>")
    for others, views in ((False, {"all": 0}), (True, {"all": 0, "half": 4})):
        found = V.vector_blocks(v, "test", store.uuid.uuid4().hex, tuple(sorted(set(views.values()))))
        search = V.DenseSearch(found, q, 7, views, others)
        want = []
        for name, d in views.items():
            for k in asked:
                s = np.round(x[:, : d or None] @ x[k, : d or None], 9)
                order = sorted((-s[i], i) for i in range(len(x)) if not (others and i == k))[:7]
                want += [(name, k, i, r) for r, (_, i) in enumerate(order, 1)]
        assert sorted((r.view, r.query_id, r.corpus_idx, r["rank"]) for r in search.topk().collect()) == sorted(want)
        pairs, blocks = search.surviving().filter("view = 'all'").count(), found.heads.count()
        assert pairs < 0.5 * blocks * len(asked), (pairs, blocks)
    with pytest.raises(Exception, match="one length"):
        V.DenseSearch(found, spark.createDataFrame([(1, [1.0])], "query_id long, q array<double>"), 2, {"all": 0}).topk().collect()


def test_grid_ranks_places_and_quantiles(spark, monkeypatch):
    monkeypatch.setattr(V, "RANGE", 16)
    monkeypatch.setattr(V, "QUERIES", 3)
    rnd = np.random.default_rng(5)
    x, label = np.round(rnd.normal(size=(150, 4)), 1), rnd.integers(0, 5, 150)
    ids = [3 * k for k in range(150)]
    v = spark.createDataFrame([(ids[k], x[k].tolist(), int(label[k])) for k in range(150)] + [(7000, None, 1)], "corpus_idx long, v array<double>, label int").repartition(3)
    asked = list(range(0, 150, 14))
    q = v.filter(F.col("corpus_idx").isin([ids[k] for k in asked])).select(F.col("corpus_idx").alias("query_id"), F.col("v").alias("q"), "label")
    grid = V.Grid(v, q)
    s = np.round(x @ x.T, 9)
    for got, share in zip(grid.quantiles([0.0, 0.1, 0.5, 0.9, 1.0]), (0.0, 0.1, 0.5, 0.9, 1.0), strict=True):
        assert abs(got - np.quantile(s[asked].ravel(), share)) < 1e-9
    for r in grid.gold_ranks([0.0]).collect():
        k = ids.index(r.query_id)
        unit = np.round((s[k] - s[k].min()) / (s[k].max() - s[k].min()), 9)
        order = sorted(range(150), key=lambda i: (-unit[i], ids[i]))
        assert r.hit_rank == next(n for n, i in enumerate(order, 1) if label[i] == label[k] and i != k)
    for r in grid.gold_place().collect():
        k = ids.index(r.query_id)
        gold = [s[k][i] for i in range(150) if label[i] == label[k] and i != k]
        other = [s[k][i] for i in range(150) if label[i] != label[k]]
        assert (r.best, r.below, r.n) == (max(gold), sum(o < max(gold) for o in other), len(other))


def test_resample_distribution():
    for n, w, l in ((1, 1, 0), (5, 2, 1), (7, 0, 0), (6, 3, 3), (40, 9, 4), (3000, 300, 200)):
        values, upto = RS.difference_distribution(n, w, l)
        p = np.diff(np.concatenate(([0.0], upto)))
        assert abs(upto[-1] - 1) < 1e-9
        assert abs((values * p).sum() - (w - l)) < 1e-6
        assert abs((values**2 * p).sum() - (w - l) ** 2 - (w + l - (w - l) ** 2 / n)) < 1e-5
    rnd = np.random.default_rng(1)
    d = np.array([1] * 9 + [-1] * 4 + [0] * 27)
    drawn = np.quantile(rnd.choice(d, (20_000, 40)).mean(1), [0.025, 0.975])
    own = np.quantile(RS.draw(*RS.difference_distribution(40, 9, 4), RS.uniforms("7", 20_000)) / 40, [0.025, 0.975])
    assert np.abs(drawn - own).max() <= 0.0251


def test_value_intervals(spark):
    rnd = np.random.default_rng(8)
    rows = [(g, k, float(x)) for g, n in (("a", 60), ("b", 1)) for k, x in enumerate(rnd.normal(0.3, 1, n))]
    got = {r.g: r for r in RS.value_interval(spark.createDataFrame(rows, "g string, query_id long, d double"), "g").collect()}
    x = np.array([d for g, _, d in rows if g == "a"])
    assert abs(got["a"].lo - (x.mean() - 1.96 * x.std() / 60**0.5)) < 0.05
    assert got["b"].lo == got["b"].hi == rows[-1][2]
    at = RS.places(np.arange(4000), 60, 20260626)
    assert abs(np.bincount(at.ravel(), minlength=60) / at.size * 60 - 1).max() < 0.06


def test_sign_flips(spark):
    r = RS.sign_flips(spark.createDataFrame([(30, 12, 2), (5, 0, 0)], "n long, wins long, losses long"), 2_000).collect()
    assert r[1].p == 1.0 and 0.004 < r[0].p < 0.03


def test_kept_tables_follow_their_files(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []
    spark.range(3).write.parquet(path)

    def build():
        calls.append(1)
        return spark.read.parquet(path)

    assert store.kept(spark, "t", store.state_of(spark, path), build).count() == 3
    assert store.kept(spark, "t", store.state_of(spark, path), build).count() == 3
    assert len(calls) == 1
    before = store.plan_state(spark.read.parquet(path))
    spark.range(2).write.mode("append").parquet(path)
    assert store.kept(spark, "t", store.state_of(spark, path), build).count() == 5
    assert store.plan_state(spark.read.parquet(path)) != before
    assert store.plan_state(spark.range(3)) != store.plan_state(spark.range(3))
    assert store.plan_state(spark.read.parquet(path).filter("id > 0")) == store.plan_state(spark.read.parquet(path).filter("id > 0"))
