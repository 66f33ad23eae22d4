"""Work that follows the input: results by plain versions, and plans without a row for a pair."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from compare import SF
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import audits as A
from siftlake.operators import latent as L
from siftlake.operators import lexical_index as X
from siftlake.operators import passages as P
from siftlake.operators import retrieval as R
from siftlake.operators.blocks import Grid
from siftlake.plans.registry import QUERIES

SMALL = SF.replace("sf0.01", "sf0.001")


def test_twins_of_many_copies_meet_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(A, "TWIN_ROWS", 5, raising=False)
    monkeypatch.setattr(A, "TWIN_BUNDLE", 40, raising=False)
    monkeypatch.setattr(A, "TWIN_CELLS", 30, raising=False)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    sets = [[rnd.choice(words[: rnd.choice([4, 40])]) for _ in range(rnd.randrange(9))] for _ in range(150)]
    sets += [["a", "b", "c", "d", x] for x in words] + [["a", "b", "c", "d"]] * 60
    left, right = sets[::2] + [None], sets[1::2] + [[]]
    want = set()
    for i, x in enumerate(left):
        found = [(round(len(set(x) & set(y)) / len(set(x) | set(y)), 9), k) for k, y in enumerate(right) if x and y]
        if found and max(found)[0] >= 0.4:
            want.add((i, max(found)[1], max(found)[0]))
    frame = lambda rows, name: spark.createDataFrame(list(enumerate(rows)), f"{name} long, toks array<string>")
    out = A.twins(frame(left, "left_id"), frame(right, "right_id"), 0.4)
    assert {tuple(r) for r in out.collect()} == want
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert A.twins(frame([], "left_id"), frame(right, "right_id"), 0.4).collect() == []


def test_ablation_sweeps_search_the_index(spark, monkeypatch):
    def pairs(*_, **__):
        raise AssertionError("a row for every pair of query and document")

    monkeypatch.setattr(R, "bm25_scores", pairs)
    for name, n in (("r21_r23_ablation_sweep", 6), ("r7_r23_ablation_permissive", 12)):
        assert QUERIES[name](spark, SMALL).count() == n


def test_postings_give_the_sums_of_a_plain_product(monkeypatch):
    monkeypatch.setattr(X, "ENTRIES", 7, raising=False)
    monkeypatch.setattr(X, "OFTEN", 2, raising=False)
    rnd = np.random.default_rng(2)
    f = rnd.integers(0, 3, (5, 30)) * (rnd.random((5, 30)) < 0.5)
    lists = [[(i, int(f[t, i]), 9) for i in range(30) if f[t, i]] for t in range(5)]
    blocks = pa.table({"tok": pa.chunked_array([[f"t{t}" for t in range(5)]])} | {c: pa.chunked_array([[[x[k] for x in own] for own in lists]]) for k, c in enumerate(("docs", "fs", "dls"))})
    p = X.Postings(blocks, 9.0, np.arange(30)[::-1])
    w = rnd.random((4, 5))
    q, tok = np.divmod(np.arange(20), 5)
    asked = pa.chunked_array([[f"t{t}" for t in tok] + ["unknown"]])
    got = p.scores(p.known(asked), np.append(q, 0), np.append(w.ravel(), 1.0), 4)
    assert np.allclose(got[:, ::-1], w @ (f * 2.2 / (f + 1.2)))


def test_term_coverage_reads_entries_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("concat('k', doc_id % 3) as code", "text", "doc_id")
    asked = spark.createDataFrame([(1, "en", docs.orderBy("doc_id").first().text[:200]), (2, "en", "nowhere"), (3, "en", None)], "query_id long, lang string, text string")
    gold = spark.createDataFrame([(q, f"k{k}") for q in (1, 2) for k in range(3)], "query_id long, code string")
    out = A.term_coverage(asked, gold, docs.select("code", "text"), ["that"])
    got = {r.query_id: r for r in out.collect()}
    terms = asked.select("query_id", T.item_terms("text", "lang", ["that"]).alias("t")).filter("query_id = 1").first().t
    assert got[1].n_terms == len(terms) and len(terms) - 1 <= got[1].n_present <= len(terms)
    assert (got[2].n_terms, got[2].n_present, got[3].n_terms, got[3].coverage) == (1, 0, 0, None)
    assert not any("documents" in x for x in out.inputFiles())


def test_tokens_of_a_batch_are_those_of_the_column(spark):
    from siftlake.functions.words import token_lists

    rnd = random.Random(4)
    letters = ["a", "Z", "9", " ", "-", "가", "힣", "\uabff", "\ud7a4", "ꀀ", "é", "İ", "\u212a", "中", "\U0001f600", "\x00", "\n"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 2, 30]))) for _ in range(300)] + [None, "", "ab", "cd", "가", "각"]
    plain = lambda t: ["".join(c.lower() if c < "\x80" else c for c in w) for w in re.findall("[A-Za-z0-9가-힣]+", t or "")]
    for kind in (pa.string(), pa.large_string()):
        rows = pa.array(texts, kind)
        assert token_lists(rows).to_pylist() == [plain(t) for t in texts]
        assert token_lists(rows.slice(280, 25)).to_pylist() == [plain(t) for t in texts[280:305]]
        assert token_lists(rows.slice(0, 0)).to_pylist() == token_lists(pa.array([], kind)).to_pylist() == []
    own = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(T.tokens("t").alias("k")).collect()
    assert [r.k for r in own] == [plain(t) for t in texts]


def test_chosen_fingerprints_are_the_least_of_their_windows():
    data = np.random.default_rng(6).integers(97, 99, 5000).astype(np.uint64)
    every = P.fingerprints(data[:31], 16).tolist()
    want = sorted({x for k in range(len(data) - 30) for x in P.fingerprints(data[k : k + 31], 16).tolist()})
    assert len(every) == 1 and sorted(P.fingerprints(data, 16).tolist()) == want
    allowed = np.zeros(P.BITS, bool)
    allowed[[x & (P.BITS - 1) for x in want[::3]]] = True
    assert sorted(P.fingerprints(data, 16, allowed).tolist()) == [x for x in want if allowed[x & (P.BITS - 1)]]


def test_vectors_and_marks_of_texts_are_made_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("corpus_idx"), "text")
    v = R.hashed_dense(docs, "corpus_idx", F.col("text"), (16,))
    grid = Grid(v, v.select(F.col("corpus_idx").alias("query_id"), F.col("v").alias("q")).limit(3))
    assert "MapInArrow" not in grid.docs._jdf.queryExecution().executedPlan().toString()
    passages = docs.limit(5).select(F.col("corpus_idx").alias("query_id"), F.substring("text", 1, 60).alias("passage"))
    plan = P.held_passages(docs, passages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the passages' own fingerprints


def test_trained_vectors_cut_texts_once(spark, monkeypatch):
    calls, cut = [], L.term_rows
    monkeypatch.setattr(L, "term_rows", lambda *a: calls.append(a) or cut(*a))
    from siftlake.plans import suite
    from siftlake.sources import store

    monkeypatch.setattr(suite, "_MODELS", {})
    monkeypatch.setattr(store, "_KEPT", {})
    assert QUERIES["r10_trained_vectors"](spark, SMALL).count() > 0 and len(calls) == 1


def test_blocks_are_not_shuffled_to_meet_few_tokens(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("corpus_idx"), "text")
    index = R.bm25_index(docs)
    asked = X.Asked.of(index, R.query_tokens(docs.limit(3).select(F.col("corpus_idx").alias("query_id"), "text")))
    plan = X.bounds(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [tok" in plan and "SortMergeJoin [tok" not in plan
    assert "MapInArrow" not in X.surviving(index, asked, 5).select("query_id", "bound")._jdf.queryExecution().optimizedPlan().toString()


def test_no_null_arrays_are_sent_to_kernels(spark):
    """Arrow's writer goes through all null lists before a row again, which made passes of a grid quadratic in a batch."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("corpus_idx"), "text")
    q = docs.limit(3).select(F.col("corpus_idx").alias("query_id"), "text")
    index, asked = R.bm25_index(docs), R.query_tokens(q)
    grid = Grid(R.hashed_dense(docs, "corpus_idx", F.col("text"), (16,)), R.hashed_dense(q, "query_id", F.col("text"), (16,), "q"), index, asked)
    found = X.Asked.of(index, asked)
    for rows in (grid.rows(), grid.rows(grid.extremes()), X.sent(found, X.bounds(index, found))):
        lists = [c for c, kind in rows.dtypes if kind.startswith("array")]
        assert len(lists) > 1 and rows.filter(" or ".join(f"{c} is null" for c in lists)).count() == 0 < rows.count()


def test_blocks_are_bytes_and_taken_out_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("corpus_idx"), "text")
    index, asked = R.bm25_index(docs), R.query_tokens(docs.limit(3).select(F.col("corpus_idx").alias("query_id"), "text"))
    assert dict(index.blocks.dtypes)["data"] == "binary"
    found = X.Asked.of(index, asked)
    again = X.Asked.of(index, R.query_tokens(docs.limit(3).select(F.col("corpus_idx").alias("query_id"), "text")))
    assert again.blocks.inputFiles() == found.blocks.inputFiles()
    read = X.best_in(index, found, X.bounds(index, found), 5).inputFiles()
    assert read and not set(read) & set(index.blocks.inputFiles())
    want = docs.select("corpus_idx", F.explode(T.tokens("text")).alias("tok")).groupBy("corpus_idx", "tok").count()
    assert index.postings.select("corpus_idx", "tok", "f").exceptAll(want).count() == want.exceptAll(index.postings.select("corpus_idx", "tok", "f")).count() == 0


def test_texts_are_not_shuffled_to_meet_few_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("corpus_idx"), "text")
    passages = docs.limit(5).select(F.col("corpus_idx").alias("query_id"), F.substring("text", 1, 60).alias("passage"))
    plan = P.held_passages(docs, passages)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and all("BroadcastHashJoin" in line for line in plan.splitlines() if "LeftSemi" in line)


def test_hashed_vectors_of_batches_are_those_of_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "WORDS", 2)
    rows = spark.createDataFrame([(0, "a b a"), (1, ""), (2, "가 b"), (3, None), (4, "c")], "k long, t string")
    got = {r.k: list(r.v) for r in R.hashed_dense(rows, "k", F.col("t"), (8,)).collect()}
    want = {}
    for r in R.hashed_vectors(rows, "k", F.col("t"), 8).collect():
        want.setdefault(r.k, [0.0] * 8)[r.bucket] = r.weight
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)


def test_first_sentences_read_the_head_of_a_text(spark):
    rnd = random.Random(9)
    bits = ["a", "word", ".", ". ", "; ", ";\n", " ", "  \t ", "é", "\u00a0", "x" * 70, "y" * 100, " " * 900, T.MARK, "\U0001f600"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 3, 10, 40, 300]))) for _ in range(400)] + [None, "", " " * 5000 + "a. b", "a. " + " " * 3000 + "b" * 400]

    def plain(text):
        t = re.sub(r"\s+", " ", text or "").strip(" ")
        parts = re.sub(r"([.;])\s+", r"\1" + T.MARK, t).split(T.MARK)
        return (parts[0] + " " + parts[1] if len(parts[0]) < 80 and len(parts) > 1 else parts[0])[:260].strip(" ")

    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    for r in rows.select("i", T.first_sentence("t").alias("s")).collect():
        assert r.s == plain(texts[r.i]), (texts[r.i], r.s)
    assert "1368" in rows.select(T.first_sentence("t"))._jdf.queryExecution().analyzed().toString()


def test_the_first_pass_of_a_grid_ranks_as_a_search_does(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("corpus_idx"), "text")
    q = docs.filter("corpus_idx % 40 = 0").select(F.col("corpus_idx").alias("query_id"), F.substring("text", 1, 200).alias("text"))
    dims, views = (16, 32), {"a": (0, 16), "b": (16, 48)}
    vectors = lambda counts: (R.hashed_dense(docs, "corpus_idx", F.col("text"), dims, counts=counts), R.hashed_dense(q, "query_id", F.col("text"), dims, "q", counts=counts))
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    index, asked = R.bm25_index(docs), R.query_tokens(q)
    grid = Grid(*vectors(True), index, asked, views=views, counts=True)
    assert dict(grid.docs.dtypes)["v"] == "array<int>"
    passed = grid.first_pass(10)
    want = X.search(index, asked, 10).filter("score > 0").select("query_id", "corpus_idx", "score", "rank")
    assert rows(grid.lexical_topk(10, passed).select("query_id", "corpus_idx", "score", "rank")) == rows(want) != []
    plain = Grid(*vectors(False), index, asked, views=views)
    assert rows(grid.blended_topk([0.5, 0.0], 10, passed)) == rows(plain.blended_topk([0.5, 0.0], 10))


def test_hits_are_found_without_a_search_of_their_own(spark, monkeypatch):
    from siftlake.sources import store

    monkeypatch.setattr(store, "_KEPT", {})
    monkeypatch.setattr(X, "search", lambda *a, **k: 1 / 0)
    monkeypatch.setattr(R, "bm25_topk", lambda *a, **k: 1 / 0)
    assert {r.retriever for r in QUERIES["u5_u6_equivalence"](spark, SMALL).select(F.col("comparison").alias("retriever")).collect()} == {"hybrid_vs_bm25", "dense_vs_bm25", "hybrid_vs_dense"}


def test_an_index_is_built_without_a_shuffle(spark, monkeypatch):
    made, kept = [], X.kept
    monkeypatch.setattr(X, "kept", lambda s, name, state, build, *by: kept(s, name, state, lambda: made.append((name, build())) or made[-1][1], *by))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select((F.col("doc_id") + 7).alias("corpus_idx"), "text")
    index = R.bm25_index(docs)
    assert index.n == docs.count()
    (plan,) = [d._jdf.queryExecution().executedPlan().toString() for name, d in made if name.endswith("-blocks")]
    assert "MapInArrow" in plan and "Exchange" not in plan
