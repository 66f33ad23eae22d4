"""Sub-word lengths and trained vectors against plain versions."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from siftlake.operators import latent as L
from siftlake.operators import retrieval as R
from siftlake.operators import subwords as W

PIECES = [b" a", b" ab", b"ab", b"abc", b" abcd", b"\xe4\xb8\xad", b" \xe4", b"bca", b"x y", b"\tz", b"zzzz"]


def plain_count(text: str | None, pieces) -> int:
    known, n = set(pieces), 0
    for word in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        word, at = b" " + word, 0
        while at < len(word):
            at += max((k for k in range(1, len(word) - at + 1) if word[at : at + k] in known), default=1)
            n += 1
    return n


@pytest.mark.parametrize("seed", [1, 2])
def test_words_are_cut_as_by_a_plain_loop(seed, monkeypatch):
    monkeypatch.setattr(W, "SLICE", 7)
    monkeypatch.setattr(W, "LONG", 9)
    rnd = random.Random(seed)
    usable = [p for p in PIECES if not any(b in W.SPACES for b in p[1:])]
    texts = ["".join(rnd.choice(["a", "b", "c", "d", "中", " ", "\t", "\n", "z", "\x0b", "é"]) for _ in range(rnd.choice([0, 1, 2, 9, 60, 300]))) for _ in range(80)]
    texts += ["", " ", "ab" * 200, "  ab  ", "\x1c", " a b"]
    for kind in (pa.string(), pa.large_string()):
        rows = pa.array(texts, kind)
        assert W.Trie.of(usable).lengths(rows).tolist() == [plain_count(t, usable) for t in texts]
        assert W.Trie.of(usable).lengths(rows.slice(30, 20)).tolist() == [plain_count(t, usable) for t in texts[30:50]]
    assert W.Trie.of(usable).lengths(pa.array([], pa.string())).tolist() == []


def test_subword_count_is_a_column(spark, tmp_path):
    """Nulls and empty texts have 0; repeated rows and any other column stay; a vocabulary is a file."""
    import base64

    path = tmp_path / "pieces"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % k for k, p in enumerate(PIECES)) + b"\n")
    assert b"x y" not in W.pieces_of(str(path)) and b" ab" in W.pieces_of(str(path))
    texts = [None, "", "ab abcd", "ab abcd", "zzzzz 中", "x y"]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "`a.b` long, text string, n int")
    got = d.withColumn("n_subwords", W.subword_count(spark, "text", str(path))).orderBy("`a.b`").collect()
    assert [r.n_subwords for r in got] == [plain_count(t, W.pieces_of(str(path))) for t in texts]
    assert d.limit(0).select(W.subword_count(spark, "text", str(path)).alias("k")).collect() == []


def plain_terms(texts: list[str | None], width: int):
    """The matrix of weighted buckets and the idf, by the definition."""
    import hashlib

    counts = np.zeros((len(texts), width))
    for k, t in enumerate(texts):
        for w in re.findall("[A-Za-z0-9가-힣]+", t or ""):
            counts[k, int(hashlib.md5(w.lower().encode()).hexdigest()[:8], 16) % width] += 1
    some = counts.sum(1) > 0
    df, n = (counts > 0).sum(0), some.sum()
    idf = np.array([math.log((1 + n) / (1 + f)) + 1 if f else 0.0 for f in df])
    a = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return a / np.maximum(np.sqrt((a * a).sum(1)), 1e-300)[:, None], some, idf


def topics(seed: int) -> list[str | None]:
    rnd = random.Random(seed)
    words = [[f"t{k}w{j}" for j in range(12)] for k in range(5)]
    texts = []
    for i in range(150):
        own = words[0] if rnd.random() < 0.4 else words[i % 5]  # one topic has a third of the rows and more
        texts.append(" ".join(rnd.choice(own if rnd.random() < 0.9 else rnd.choice(words)) for _ in range(rnd.randrange(5, 60))))
    return texts + [None, "", "...", texts[0], texts[0]]


def test_basis_is_that_of_a_plain_svd(spark, monkeypatch):
    monkeypatch.setattr(L, "ENTRIES", 100)
    texts, width, rank = topics(3), 256, 4
    d = spark.createDataFrame([(i if i % 7 else None, t, 0) for i, t in enumerate(texts)], "corpus_idx long, text string, at int").repartition(5)
    model = L.train(d, "text", rank=rank, width=width, rounds=12)
    a, some, idf = plain_terms(texts, width)
    values, right = np.linalg.svd(a)[1:]
    assert np.allclose(model.idf, idf)
    assert np.allclose(model.values, values[:rank], rtol=1e-6)
    overlap = np.linalg.svd(right[:rank] @ model.basis)[1]  # cosines of the angles between the two subspaces
    assert overlap.min() > 1 - 1e-6
    assert np.allclose(model.basis.T @ model.basis, np.eye(rank), atol=1e-9)


def test_vectors_and_ranking(spark, monkeypatch):
    monkeypatch.setattr(L, "ENTRIES", 64)
    texts, width = topics(5), 256
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "corpus_idx long, text string, v string").repartition(4)
    model = L.train(d, "text", rank=6, width=width)
    vectors = model.encode(d, "corpus_idx", "text")
    got = {r.corpus_idx: np.array(r.v) for r in vectors.collect()}
    a, some, _ = plain_terms(texts, width)
    want = a @ model.basis
    assert sorted(got) == np.flatnonzero(some).tolist()
    for k, v in got.items():
        assert np.allclose(v, want[k] / np.linalg.norm(want[k]), atol=1e-9)
    assert model.encode(spark.createDataFrame([(1, "unseen words"), (2, None)], "k long, text string"), "k", "text").collect() == []
    q = spark.createDataFrame([(0, texts[7]), (1, texts[20])], "query_id long, text string")
    top = R.dense_topk(model.encode(q, "query_id", "text", "q"), vectors, 3).collect()
    ids = np.array(sorted(got))
    for query, own in ((0, 7), (1, 20)):
        s = np.round([got[i] @ got[own] for i in ids], 9)
        assert [r.corpus_idx for r in sorted(top, key=lambda r: r["rank"]) if r.query_id == query] == ids[np.lexsort((ids, -s))[:3]].tolist()


def test_small_corpora(spark):
    empty = spark.createDataFrame([], "corpus_idx long, text string")
    model = L.train(empty, "text", rank=4, width=64)
    assert model.basis.shape == (64, 0) and model.encode(empty, "corpus_idx", "text").collect() == []
    d = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "corpus_idx long, text string")
    assert model.encode(d, "corpus_idx", "text").collect() == []
    one = L.train(d, "text", rank=4, width=64)
    assert one.basis.shape == (64, 1)
    assert [(r.corpus_idx, np.round(r.v, 9).tolist()) for r in one.encode(d, "corpus_idx", "text").orderBy("corpus_idx").collect()] == [(1, [1.0]), (2, [1.0])]


def test_rows_do_not_meet_in_one_task(spark):
    d = spark.createDataFrame([(i, "a b c") for i in range(50)], "corpus_idx long, text string").repartition(6)
    plan = L.train(d, "text", rank=1, width=64).encode(d, "corpus_idx", "text")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
