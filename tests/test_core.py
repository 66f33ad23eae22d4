"""Literal cases: ranks, ties, no signal, fill, statistics, parsing, integrity, streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import corpus as C
from siftlake.operators import integrity as I
from siftlake.operators import metrics as M
from siftlake.operators import retrieval as R
from siftlake.operators import spans as P
from siftlake.operators import stats as S


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_zero_fill_and_no_signal(spark):
    docs = spark.createDataFrame([(0, "alpha beta"), (1, "gamma"), (2, "delta alpha alpha"), (3, "epsilon")], "corpus_idx long, text string")
    q = spark.createDataFrame([(0, "alpha alpha zeta"), (1, "한글 없음"), (2, "")], "query_id long, text string")
    index = R.bm25_index(docs)
    got = R.top_k(R.bm25_scores(index, R.query_tokens(q)), docs, 10).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.corpus_idx, round(r.score, 6)) for r in got] == [(0, 2, 1.587281), (0, 0, 1.309751), (0, 1, 0.0), (0, 3, 0.0)]
    two = R.top_k(R.bm25_scores(index, R.query_tokens(q)), docs, 3).orderBy("rank").collect()
    assert [r.corpus_idx for r in two] == [2, 0, 1]


def test_ties_do_not_depend_on_partitions(spark):
    rows = [(0, k, float(k % 5)) for k in range(40)]
    want = [k for _, k, s in sorted(rows, key=lambda r: (-r[2], r[1]))]
    for n in (1, 7, 32):
        df = spark.createDataFrame(rows, "query_id long, corpus_idx long, score double").repartition(n)
        got = df.withColumn("rank", F.row_number().over(R.by_rank("query_id"))).orderBy("rank").collect()
        assert [r.corpus_idx for r in got] == want


def test_blend_without_signal_is_dense(spark):
    lexical = spark.createDataFrame([], "query_id long, corpus_idx long, unit double")
    dense = spark.createDataFrame([(0, k, k / 49) for k in range(50)], "query_id long, corpus_idx long, unit double")
    got = R.blend(lexical, dense, [0.7, 0.5, 0.3]).withColumn("rank", F.row_number().over(R.by_rank("alpha", "query_id"))).filter("rank = 1").collect()
    assert {r.corpus_idx for r in got} == {49}


def test_constant_scores_normalise_to_zero(spark):
    df = spark.createDataFrame([(0, k, 2.0) for k in range(4)], "query_id long, corpus_idx long, score double")
    assert {r.unit for r in R.minmax(df, F.lit(4)).collect()} == {0.0}
    assert {r.unit for r in R.minmax(df, F.lit(9)).collect()} == {1.0}


def test_binomial_and_mcnemar(spark):
    for k, n in ((29, 29), (14, 26), (5, 8), (3, 8), (20, 30), (0, 0)):
        exact = sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
        assert abs(one(spark, S.binomial_tail(F.col("k"), F.col("n"), F.lit(0.5)), k=k, n=n) - exact) < 1e-12
    pairs = spark.createDataFrame([("x", 1, 0)] * 29 + [("x", 1, 1)] * 42 + [("y", 1, 0)] * 3 + [("y", 0, 1)] * 5 + [("y", 0, 0)] * 63 + [("z", 1, 1)], "key string, a int, b int")
    got = {r.key: r for r in S.mcnemar(pairs, "key").collect()}
    assert (got["x"].wins, got["x"].losses, got["x"].ties) == (29, 0, 42) and abs(got["x"].p_two_sided - 2**-28) < 1e-15
    assert round(got["y"].p_two_sided, 4) == 0.7266 and got["z"].p_two_sided == 1.0


def test_clopper_pearson(spark):
    for (k, n), (lo, hi) in {(0, 10): (0.0, 0.3085), (1, 45): (0.0006, 0.1177), (3, 8): (0.0852, 0.7551), (71, 71): (0.9494, 1.0)}.items():
        got = one(spark, S.clopper_pearson(F.col("k"), F.col("n")), k=k, n=n)
        assert abs(got.lo - lo) < 2e-4 and abs(got.hi - hi) < 2e-4


def plain_interval(k, n):
    def tail(k, p):
        ln = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k, n + 1)]
        return math.fsum(math.exp(x) for x in ln)

    def root(above):
        lo, hi = 0.0, 1.0
        for _ in range(45):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if above(mid) else (mid, hi)
        return lo

    return (root(lambda p: tail(k, p) >= 0.025) if k else 0.0), (root(lambda p: 1 - tail(k + 1, p) <= 0.025) if k < n else 1.0)


def test_clopper_pearson_of_large_counts(spark):
    for k, n in ((0, 1), (1, 1), (5, 9), (449, 3980), (1990, 3980), (3979, 3980), (1, 20000), (11000, 20000)):
        got = one(spark, S.clopper_pearson(F.col("k"), F.col("n")), k=k, n=n)
        assert max(abs(x - y) for x, y in zip((got.lo, got.hi), plain_interval(k, n), strict=True)) < 1e-8


def test_clopper_pearson_query_has_the_counts_of_the_table(spark, tmp_path):
    from siftlake.plans.registry import QUERIES

    rows = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.quality: r for r in QUERIES["u2_u4_clopper_pearson"](spark, str(tmp_path)).collect()}
    for q in (0, 1):
        k, n = sum(t for _, y, t in rows if y == q), sum(y == q for _, y, _ in rows)
        lo, hi = plain_interval(k, n)
        assert (got[q].k, got[q].n, got[q].lo, got[q].hi) == (k, n, round(lo, 4), round(hi, 4))


def test_equivalence(spark):
    d = spark.createDataFrame([("a", x) for x in [1.0] * 3 + [-1.0] * 5 + [0.0] * 63] + [("b", 0.0)] * 71 + [("c", 1.0)], "key string, d double")
    got = {(r.key, r.delta): r for r in S.tost(d, [0.03, 0.15], "key").collect()}
    assert not got["a", 0.03].equivalent and got["a", 0.15].equivalent and got["b", 0.03].equivalent and not got["c", 0.15].equivalent
    need = S.tost(d, [0.05], "key").filter("key = 'a'").first().n_required
    assert 100 < need < 2000


def test_holm(spark):
    rows = [("f", "a", 0.001), ("f", "b", 0.01), ("f", "c", 0.04), ("f", "d", 0.5), ("g", "only", 0.03)]
    got = {r.name: r for r in S.holm(spark.createDataFrame(rows, "family string, name string, p double"), "family", "p", "name").collect()}
    assert [round(got[k].p_adjusted, 6) for k in "abcd"] == [0.004, 0.03, 0.08, 0.5]
    assert got["b"].significant and not got["c"].significant and got["only"].p_adjusted == 0.03


def test_boundary(spark):
    assert abs(one(spark, S.boundary_artifact(F.col("w"), F.col("n")), w=3, n=13) - (10 / 13) ** 13) < 1e-12


def test_text_functions(spark):
    at = lambda c, t: one(spark, c, t=t)
    assert at(T.tokens("t"), "Été A-b 한글3x") == ["t", "a", "b", "한글3x"]
    assert at(T.first_sentence("t"), "One; two.  Three") == "One; two."
    assert at(T.clean_text("t"), " a  , b ;c ") == "a, b;c"
    assert at(T.strip_control_codes("t"), "See 3A001.b and ECCN x; ") == "See and x"
    assert at(T.normalize_code("t"), "eccn-2b001.a ") == "2B001A"
    assert [at(T.singular(F.col("t")), w) for w in ("batteries", "lenses", "glass", "status", "gas")] == ["battery", "lense", "glass", "status", "gas"]
    assert at(C.drop_tokens(F.col("t"), F.array(F.lit("titanium"), F.lit("aerospace"))), "Titanium parts for  aerospace use, titaniums") == "parts for use, titaniums"
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert one(spark, T.significant(F.lit(1.23456789e-12))) == 1.23457e-12
    assert one(spark, T.code_leak("q", "c"), q="about 2b001 here", c="ECCN-2B001") and not one(spark, T.code_leak("q", "c"), q="about it", c="ECCN-2B001")


def test_spans_are_claimed_once(spark):
    found = one(spark, P.annotate(F.col("t"), {"material": ["titanium alloy", "titanium"], "use": ["alloy wheel"]}), t="5 mm titanium alloy wheel, Titanium 3")
    assert sorted((r.category, r.surface) for r in found) == [("material", "Titanium"), ("material", "titanium alloy"), ("quantitative_spec", "3"), ("quantitative_spec", "5 mm")]


def test_metrics(spark):
    ranked = spark.createDataFrame([(0, 5, 1), (0, 6, 2), (1, 7, 3)], "query_id long, corpus_idx long, rank int")
    gold = spark.createDataFrame([(0, 6), (0, 9), (1, 7)], "query_id long, corpus_idx long")
    q = spark.createDataFrame([(0,), (1,), (2,)], "query_id long")
    r = M.rank_metrics(M.first_hit(ranked, gold, q)).first()
    assert (r.n, r.recall_1, round(r.recall_5, 4), round(r.mrr, 4)) == (3, 0.0, 0.6667, round((1 / 2 + 1 / 3) / 3, 4))
    cells = spark.createDataFrame([(1, 0.5, 10.0), (2, 0.5, 12.0), (3, 0.6, 12.0)], "id int, g double, c double")
    assert {r.id for r in M.pareto(cells, "g", "c").collect()} == {1, 3}
    h = M.histogram(spark.createDataFrame([(0.0,), (1.0,), (0.99,), (5.0,)], "x double"), "x", 0.0, 1.0, 4)
    assert {r.bin: r.n for r in h.collect()} == {0: 1, 1: 0, 2: 0, 3: 2}


def test_integrity(spark):
    q = spark.createDataFrame([(0,), (1,)], "query_id long")
    hits = spark.createDataFrame([("m", 0.5, 0, 1), ("m", 0.5, 0, 1), ("m", 0.5, 7, 2)], "model string, alpha double, query_id long, hit int")
    assert {r.rule for r in I.shard_violations(hits, q).collect()} == {"domain", "unknown_id", "repeated"}
    assert I.anchor_mismatch(hits, hits).count() == 0
    s = spark.createDataFrame([(0, "en", "a"), (0, "en", "a")], "query_id long, lang string, gold string")
    assert {r.rule for r in I.slice_violations(s).collect()} == {"too_few", "too_little_korean", "repeated_id", "repeated_gold"}


def test_stream_of_shards(spark, tmp_path):
    from siftlake.streaming.shards import HITS, merge_stream

    q = spark.createDataFrame([(0,), (1,)], "query_id long")
    for k, rows in enumerate(([("m", 0.5, 0, 1), ("m", 0.5, 9, 1)], [("m", 0.5, 0, 1), ("m", 0.5, 1, 0), ("m", 0.5, 1, 3)])):
        spark.createDataFrame(rows, HITS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        merge_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", q).awaitTermination(120)
        assert k in (0, 1)
    assert sorted((r.query_id, r.hit) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(0, 1), (1, 0)]


def test_lines_and_substitution(spark):
    rows = spark.createDataFrame([(1, "x\n1. a\nb\n2. c")], "id long, text string")
    got = {r.entry: r.text for r in C.assemble_lines(rows, "id", "text", F.col("line").rlike(r"^\d")).collect()}
    assert got == {0: "x", 1: "1. a b", 2: "2. c"}
    rules = spark.createDataFrame([(1, None, "cat", "animal"), (1, None, "black cat", "pet"), (2, None, "dog", "animal"), (1, "ko", "the", "-")], "tier int, lang string, phrase string, hypernym string")
    qs = spark.createDataFrame([(0, "en", "the black cat, a cat and a dog")], "query_id long, lang string, text string")
    r = C.substitute(qs, rules, 1).first()
    assert (r.text, r.applied) == ("the pet, a animal and a dog", 2)


def test_windowed_counts(spark):
    from siftlake.streaming.shards import windowed_counts

    rows = [("2024-01-01 00:10:00", "a", 1.5), ("2024-01-01 00:59:59", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0), ("2024-01-01 00:30:00", "b", None)]
    events = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    got = sorted((str(r.start), r.event_type, r.n, r.total) for r in windowed_counts(events).collect())
    assert got == [("2024-01-01 00:00:00", "a", 2, 3.5), ("2024-01-01 00:00:00", "b", 1, None), ("2024-01-01 01:00:00", "a", 1, 4.0)]
