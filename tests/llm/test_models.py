"""The trained parts against plain versions: label model, voters, linear machines, language decisions."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftlake.llm import language_id, linear, lm_scoring, toxicity
from siftlake.llm.common import text_bytes


def plain_label_model(votes, weights, prior, rounds=60):
    """The same model row by row: soft classes, vote tables smoothed by a half, discounts half way."""
    m = len(votes[0])
    q = [1 / (1 + math.exp(-2 * (sum(v > 0 for v in r) - 0.5 * sum(v < 0 for v in r)))) for r in votes]
    discount = [1.0] * m
    for step in range(rounds):
        table = {}
        for c in (0, 1):
            own = [w * (x if c else 1 - x) for w, x in zip(weights, q, strict=True)]
            for j in range(m):
                for v in (-1, 0, 1):
                    table[c, j, v] = (sum(o for o, r in zip(own, votes, strict=True) if r[j] == v) + 0.5) / (sum(own) + 1.5)
        if step == rounds // 2:
            mean = {(c, j): table[c, j, 1] - table[c, j, -1] for c in (0, 1) for j in range(m)}
            cov = [[sum(w * sum((x if c else 1 - x) * (r[i] - mean[c, i]) * (r[j] - mean[c, j]) for c in (0, 1)) for w, x, r in zip(weights, q, votes, strict=True)) / sum(weights) for j in range(m)] for i in range(m)]
            sd = [math.sqrt(max(cov[i][i], 1e-9)) for i in range(m)]
            discount = [1 / (1 + sum((cov[i][j] / (sd[i] * sd[j])) ** 2 for j in range(m) if j != i)) for i in range(m)]
        q = [1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(discount[j] * math.log(table[1, j, r[j]] / table[0, j, r[j]]) for j in range(m))))) for r in votes]
    return q, discount


def test_label_model():
    rnd = random.Random(3)
    truth = [rnd.random() < 0.3 for _ in range(80)]
    votes = []
    for t in truth:
        r = [(1 if t else -1) if rnd.random() < a else rnd.choice([-1, 0, 1]) for a in (0.8, 0.6, 0.3)]
        votes.append([*r, r[0]])  # the last voter copies the first
    weights = [2.0 if t else 0.7 for t in truth]
    q, discount = plain_label_model(votes, weights, 0.3)
    model = toxicity.LabelModel(np.array(votes, np.int8), 0.3, weight=np.array(weights))
    assert np.allclose(model.posterior(np.array(votes, np.int8)), q, atol=1e-9) and np.allclose(model.weight, discount)
    assert model.weight[0] < model.weight[1] and sum((x > 0.5) == t for x, t in zip(q, truth, strict=True)) > 60


def test_votes_of_words():
    words, heads = ["vileword", "nasty", "grimslurred"], ["grimsl"]
    fingerprints = lambda t, k: toxicity.word_hashes(*text_bytes(__import__("pyarrow").array([t])))[k]
    voters = toxicity.Voters(np.concatenate([fingerprints(w, 0) for w in words]), fingerprints(heads[0] + "xx", 1))
    texts = ["", "a plain text of words", "Vileword, NASTY nasty! grimslurred", "nasty", "grimslurs grimslug calm", "x " * 400 + "nasty", "same same same same", "## $$ %% ab"]
    votes, _ = voters.see(*text_bytes(__import__("pyarrow").array(texts)))
    for text, got in zip(texts, votes, strict=True):
        tokens = re.findall("[a-z]+", text.lower())
        hit = collections.Counter(t for t in tokens if t in words)
        head = sum(len(t) > 6 and t[:6] in heads for t in tokens)
        total, dense = sum(hit.values()), sum(hit.values()) / max(1, len(tokens))
        lists = [int(hit[words[k]] > 0) if k < len(words) else 0 for k in range(toxicity.LISTS)]
        three = lambda x: 1 if x >= 2 else -1 if x == 0 else 0
        assert got[: toxicity.LISTS].tolist() == lists
        assert got[toxicity.LISTS : toxicity.LISTS + 3].tolist() == [three(total), three(len(hit)), three(head)]
        assert got[toxicity.LISTS + 3] == (1 if dense >= 0.004 else -1 if dense < 0.0005 else 0)


def plain_toxicity(texts, labels):
    """The whole fit and all scores, word by word: texts {id: text}, labels {id: 0 or 1} to learn from."""
    hashed = lambda t, k: int(toxicity.word_hashes(*text_bytes(pa.array([t])))[k].view(np.int64)[0])  # noqa: E731  orders ties only
    split = {i: re.findall("[a-z]+", (t or "").lower()) for i, t in texts.items()}
    heads_of = lambda w: [x[:6] for x in w if len(x) > 6]
    total = [sum(v == c for v in labels.values()) for c in (0, 1)]

    def marking(part, column, most):
        seen = {c: collections.Counter(x for i, v in labels.items() if v == c for x in set(part(split[i]))) for c in (0, 1)}
        found = []
        for x, t in seen[1].items():
            c, n = seen[0][x], sum(total)
            g = 2 * sum(k * math.log(k / ((t + c) * (m / n))) for k, m in ((t, total[1]), (c, total[0])) if k)
            if t >= 3 and ((t + 0.5) / (total[1] + 1)) / ((c + 0.5) / (total[0] + 1)) >= toxicity.RATIO and g >= toxicity.SURE:
                found.append((-g, hashed(x if column == 0 else x + "x", column), x))
        return [x for _, _, x in sorted(found)[:most]]

    words, heads = marking(list, 0, toxicity.MOST_WORDS), marking(heads_of, 1, toxicity.MOST_HEADS)

    def features(i):
        text, w = texts[i] or "", split[i]
        hit = collections.Counter(x for x in w if x in words)
        head = collections.Counter(x for x in heads_of(w) if x in heads)
        n, kinds, h = sum(hit.values()), len(hit), sum(head.values())
        dense_ = n / max(1, len(w))
        capitals = sum("A" <= c <= "Z" for c in text) / max(1, sum(map(len, w)))
        symbols = sum(c in "#$%&*!|<>{}=" for c in text) / max(1, len(text))
        repeated = sum(a == b for a, b in zip(w, w[1:], strict=False)) / max(1, len(w))
        x = [math.log1p(hit[k]) for k in words] + [math.log1p(head[k]) for k in heads] + [math.log1p(n), min(kinds, 4), math.log1p(h), min(100 * dense_, 5), capitals, symbols, repeated]
        three = lambda k: 1 if k >= 2 else -1 if k == 0 else 0
        votes = [int(any(hit[k] for k in words[j :: toxicity.LISTS])) for j in range(toxicity.LISTS)]
        votes += [three(n), three(kinds), three(h), 1 if dense_ >= 0.004 else -1 if dense_ < 0.0005 else 0, int(capitals > 0.5 and n > 0), -int(repeated > 0.3 and n == 0), -int(symbols > 0.1 and n == 0)]
        return x, votes

    learned = [features(i) for i in labels]
    q = np.array(plain_label_model([v for _, v in learned], [1.0] * len(learned), total[1] / sum(total))[0])
    x = np.array([[*f, 1.0] for f, _ in learned])
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, 1e-3), 0)
    for _ in range(50):  # Newton's steps to the one least loss
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(q) + np.diag(ridge), x.T @ (p - q) / len(q) + ridge * w)
    return words, heads, {i: 1 / (1 + math.exp(-float(np.array([*features(i)[0], 1.0]) @ w))) for i in texts}


def test_toxicity_of_whole_tables(spark):
    """Words, heads and every score of the query against a plain fit."""
    rnd = random.Random(12)
    bad, calm = ["vilewordx", "nastyterm", "grimslur", "grimslurred", "ugh"], [f"plain{c}" for c in "abcdefghijklmnopqrst"]
    texts, labels = {}, {}
    for k in range(260):
        toxic = k % 4 == 0
        w = [rnd.choice(calm) for _ in range(rnd.randrange(5, 40))] + [rnd.choice(bad) for _ in range(rnd.randrange(1, 4) if toxic else rnd.random() < 0.05)]
        rnd.shuffle(w)
        text = " ".join(w) + rnd.choice(["", "!!", " ## $$", ""])
        texts[k] = text.upper() if rnd.random() < 0.15 else text
        labels[k] = int(toxic)
    texts |= {900: None, 901: "", 902: "ugh " * 500, 903: "same same same", 904: "!!##", 905: "NASTYTERM " * 30 + "calm"}
    learn = {k: v for k, v in labels.items() if zlib.crc32(str(k).encode()) % 5}
    words, heads, want = plain_toxicity(texts, learn)
    assert set(words) >= {"vilewordx", "nastyterm"} and "grimsl" in heads
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lab = spark.createDataFrame([(k, v, "x") for k, v in labels.items()], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lab).collect()}
    assert set(got) == set(want)
    assert max(abs(got[k].score - want[k]) for k in want) < 0.005
    assert all(got[k].predicted == (want[k] >= 0.5) for k in want if abs(want[k] - 0.5) > 0.005)


def dense(rows, width):
    out = np.zeros((len(rows), width))
    for k, (c, v) in enumerate(rows):
        np.add.at(out[k], c, v)
    return out


def test_linear_machines_reach_the_least_loss():
    rnd = np.random.default_rng(5)
    rows = [(np.sort(rnd.choice(12, 4, replace=False)), rnd.normal(size=4)) for _ in range(60)]
    x, width = dense(rows, 12), 12
    y = np.where(x @ rnd.normal(size=12) + 0.3 * rnd.normal(size=60) > 0, 1.0, -1.0)
    q, part = 1 / (1 + np.exp(-3 * y)), rnd.uniform(0.5, 2, 60)
    cost = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    share = part / part.sum()
    losses = {
        "svm": lambda w: cost @ np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) ** 2 + 1e-3 / 2 * w[:-1] @ w[:-1],
        "logistic": lambda w: share @ (np.logaddexp(0, x @ w[:-1] + w[-1]) - q * (x @ w[:-1] + w[-1])) + 1e-4 / 2 * w[:-1] @ w[:-1],
    }
    sparse = linear.Rows.of(rows, width)
    found = {"svm": linear.svm(sparse, y), "logistic": linear.logistic(sparse, q, 1e-4, part)}
    for name, loss in losses.items():
        w = np.zeros(width + 1)
        step = 0.5
        for _ in range(20_000):  # plain gradient descent by differences
            g = np.array([(loss(w + 1e-5 * e) - loss(w - 1e-5 * e)) / 2e-5 for e in np.eye(width + 1)]) if _ < 2500 else np.zeros(width + 1)
            if not g.any():
                break
            while loss(w - step * g) > loss(w) and step > 1e-9:
                step /= 2
            w, step = w - step * g, step * 1.5
        assert loss(found[name]) <= loss(w) + 1e-4 * max(1, abs(loss(w)))
    assert np.allclose(sparse.dot(np.arange(12.0)), x @ np.arange(12.0))


def test_languages_decided_document_by_document():
    rnd = random.Random(6)
    syllables = {"en": "th he in er an", "fr": "es le de en eu", "de": "en er ch ei sc", "es": "os as ar ci on", "xx": "qa zu wy vo kx"}
    make = lambda k: " ".join("".join(rnd.choice(syllables[k].split()) for _ in range(3)) for _ in range(12))
    labels = [k for k in syllables for _ in range(30)]
    texts = [make(k) for k in labels]
    array = lambda t: text_bytes(__import__("pyarrow").array(t))
    rows = []
    for t in texts:
        bins, _ = language_id.grams(*array([t]))
        c, n = np.unique(bins, return_counts=True)
        rows.append((c.astype(np.int64), n / max(1, n.sum())))
    model = language_id.Model(labels, rows)
    fresh = [make(k) for k in syllables for _ in range(10)] + ["", "x", "12 34"]
    names, scores = model.predict(*language_id.grams(*array(fresh)))
    weight = {task: (model.weights[i].astype(float), model.bias[i], model.slopes[i]) for i, task in enumerate(model.tasks)}
    groups = list(model.families.values())
    sigmoid = lambda v: 1 / (1 + math.exp(-max(-40, min(40, v))))
    for text, name, score in zip(fresh, names, scores, strict=True):
        bins, _ = language_id.grams(*array([text]))

        def margin(task):
            w, b, s = weight[task]
            return s * (sum(w[i] for i in bins.tolist()) / max(1, len(bins)) + b)

        if len(groups) == 1:
            chance = [1.0]
        elif len(groups) == 2:
            chance = [sigmoid(margin(("family", 0, 0))), 1 - sigmoid(margin(("family", 0, 0)))]
        else:
            raw = [sigmoid(margin(("family", f, 0))) for f in range(len(groups))]
            chance = [c / sum(raw) for c in raw]
        f = max(range(len(groups)), key=lambda k: chance[k])
        best = []
        for a in groups[f]:
            other = [(b, margin(("pair", a, b)) if a < b else -margin(("pair", b, a))) for b in groups[f] if b != a]
            wins = sum((m >= 0) if a < b else (m > 0) for b, m in other)
            sure = sum(sigmoid(m) for _, m in other) / len(other) if other else 1.0
            best.append((wins + sigmoid(sum(m for _, m in other)) * 0.5, a, sure))
        key, a, sure = max(best, key=lambda x: x[0])
        assert abs(score - chance[f] * sure) < 1e-4
        assert name == model.names[a] or sorted(b[0] for b in best)[-2] > key - 1e-4
    assert sum(a == b for a, b in zip(names, [k for k in syllables for _ in range(10)], strict=False)) > 45


def test_a_repeated_id_is_one_row_of_the_fit(spark, monkeypatch):
    """One labelled id a thousand times, and labelled ids that no document has."""
    rows = [(k, f"plain words {k} of nothing at all" + (" vileword nasty" if k % 5 == 0 else ""), "en" if k % 2 else "de") for k in range(60)]
    docs = spark.createDataFrame(rows + [rows[5]] * 1000 + [(5, None, "de"), (6, "another text", "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(90)], "doc_id long, toxic int")
    seen, plain = {}, toxicity.LabelModel.__init__

    def watched(self, votes, prior, **more):
        seen.update(n=len(votes), prior=prior)
        plain(self, votes, prior, **more)

    monkeypatch.setattr(toxicity.LabelModel, "__init__", watched)
    assert toxicity.fit(docs, labels, lambda c: F.lit(True)) is not None
    assert seen["n"] == 60 and abs(seen["prior"] - 18 / 90) < 1e-9
    assert toxicity.fit(docs.filter("doc_id % 5 <> 0"), labels, lambda c: F.lit(True)) is None
    assert language_id.fit(docs, lambda c: F.lit(True)) is not None


def test_copies_of_one_text_go_to_all_blocks(spark, tmp_path):
    """A text that fills the table, with and without ids: all blocks share it."""
    path = str(tmp_path / "t")
    spark.range(4000).selectExpr("if(id % 2 = 0, id, null) as doc_id", "repeat('some common text ', 20) as text").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    out = lm_scoring.lm_scores(docs, block_bytes=40_000, order=2)
    assert out.count() == 4000 and out.select("score").distinct().count() == 1
    dealt = docs.groupBy(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(34)).alias("block")).count()
    assert dealt.agg(F.max("count")).first()[0] < 2 * 4000 / 34
