"""Each operator against a plain version, on tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 7) for i, t, lang in rows], DOCS)


def near_copies(seed=1, bases=4, copies=40, words=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(bases):
        base = [rnd.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((len(rows) * 3 + 5, " ".join(w), "en"))
    edge = [None, "", "  \n", "A b", "a B", "one", "x " * 4000, "x " * 4001, rows[0][1].upper()]
    rows += [(10_000 + k, t, None) for k, t in enumerate(edge)]
    return [*rows, rows[3], rows[3], (None, rows[5][1], "en"), (None, None, None)]


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def classes(ids, linked):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            for x in (a, b):
                if low[x] != m:
                    low[x], changed = m, True
    return low


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, n, percent):
    from siftlake.llm.ngram_join import ngram_join

    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(table(spark, rows), n=n, percent=percent).collect()}
    sets = {i: shingles(t, n) for i, t, _ in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low = classes(ids, links)
    assert {i: got[i] for i in ids} == {i: (len(sets[i]), low[i]) for i in ids}
    assert got[None][1] in (None, low[5 * 3 + 5])
    assert ngram_join(table(spark, []), n=n, percent=percent).count() == 0


def test_ngram_join_through_texts_without_id(spark):
    """Two near copies of a text that only stands without an id link, and no row without an id links others."""
    from siftlake.llm.ngram_join import ngram_join

    rnd = random.Random(4)
    rows = []
    for k in range(24):
        base = [f"v{rnd.randrange(5000)}" for _ in range(100)]
        one, other, far = list(base), list(base), list(base)
        one[0] = other[99] = "changed"
        far[10] = far[30] = far[50] = far[70] = "changed"
        rows += [(None, " ".join(base), "en"), (10 * k, " ".join(one), "en"), (10 * k + 1, " ".join(other), "en"), (10 * k + 2, " ".join(far), "en")]
    got = {r.doc_id: r.component_id for r in ngram_join(table(spark, rows), n=3, percent=90).filter("doc_id is not null").collect()}
    assert got == {10 * k + j: 10 * k + (2 if j == 2 else 0) for k in range(24) for j in range(3)}


def test_ngram_join_of_an_id_with_two_texts(spark):
    from siftlake.llm.ngram_join import ngram_join

    rnd = random.Random(6)
    rows, want = [], {}
    for k in range(24):
        a, b = ([f"v{rnd.randrange(5000)}" for _ in range(100)] for _ in range(2))
        rows += [(10 * k, " ".join(a), "en"), (10 * k, " ".join(b), "en"), (10 * k + 1, " ".join(["changed", *a[1:]]), "en"), (10 * k + 2, " ".join([*b[:-1], "changed"]), "en")]
        want |= {10 * k + j: 10 * k for j in range(3)}
    assert {r.doc_id: r.component_id for r in ngram_join(table(spark, rows), n=3, percent=90).collect()} == want


def test_suffix_dedup(spark, monkeypatch):
    from siftlake.llm import suffix_dedup as module
    from siftlake.llm.suffix_dedup import remove_repeats, suffix_dedup

    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgé ") for _ in range(rnd.randrange(3, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = [(k, " ".join(word() for _ in range(50)) + (passage[k : 300 + k] if k % 2 else "") + " ".join(word() for _ in range(40)), "en") for k in range(20)]
    rows += [(50, rows[0][1], "en"), (51, None, None), (52, "", None), (53, "ab" * 400, "en"), (54, "short", "en"), (55, "short", "en"), (None, rows[2][1], "en"), rows[4], rows[4]]
    span = 60
    counts = collections.Counter(b[i : i + span] for _, t, _ in rows for b in [(t or "").encode()] for i in range(len(b) - span + 1))
    want = collections.Counter()
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - span + 1):
            if counts[b[k : k + span]] > 1:
                gone[k : k + span] = True
        runs = int((gone[:-1] & ~np.concatenate(([False], gone[:-1]))[:-1]).sum()) if len(b) else 0
        want[(i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=False) if not g)).hexdigest())] += 1
    got = collections.Counter(tuple(r) for r in suffix_dedup(table(spark, rows), span=span).collect())
    assert got == want
    cut = remove_repeats(table(spark, rows), span=span)
    assert cut.columns == [c.split()[0] for c in DOCS.split(", ")] and cut.count() == len(rows)
    assert suffix_dedup(table(spark, []), span=span).count() == 0
    monkeypatch.setattr(module, "BUCKET", 1)  # by fingerprints
    assert collections.Counter(tuple(r) for r in suffix_dedup(table(spark, rows), span=span).collect()) == want


def test_remove_repeats_keeps_columns_of_any_name(spark):
    from siftlake.llm.suffix_dedup import remove_repeats

    rnd = random.Random(3)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(90))
    rows = [(k, k + 5, f"only {k} " * 3 + passage, [k, None], f"p{k}") for k in range(3)] + [(7, None, None, None, None), (8, 1, "", [], "")]
    docs = spark.createDataFrame(rows, "t long, spans int, text string, trigger array<long>, block string")
    out = remove_repeats(docs, span=60)
    assert out.schema == docs.schema
    assert sorted(((r.t, r.spans, r.trigger, r.block) for r in out.collect()), key=str) == sorted(((a, b, d, e) for a, b, _, d, e in rows), key=str)
    text = {r.t: r.text for r in out.collect()}
    assert all(text[k] is not None and passage not in text[k] and text[k].startswith(f"only {k} ") for k in range(3)) and text[7] is None and text[8] == ""
    assert remove_repeats(docs.filter("t > 100"), span=60).count() == 0


def test_a_long_text_is_parsed_in_parts(monkeypatch):
    from siftlake.llm import suffix_dedup as module

    data = np.random.default_rng(5).integers(97, 123, 30_000).astype(np.uint8)
    at = np.array([0, len(data)])
    whole = module.parse(data, at, 40)
    monkeypatch.setattr(module, "SLICE_BYTES", 1000)
    parts = module.parse(data, at, 40)
    windows = lambda x: sorted((s, int(t), int(k)) for s0, s1, t, k in zip(*x[1:5], strict=True) for s in range(s0, s1 + 1))
    assert windows(whole) == windows(parts) and len(windows(parts)) == len(data) - 39


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from siftlake.llm.packing import pack

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(3)
    odd = ["", None, " ", "  a  b ", "\n a\n\n b", "it's <|endoftext|> x  y　z \x1c a", "<|endoftext|><|endoftext|>  <|endoftext|>  a  <|endoftext|> ", "  <|endoftext", "a <|endoftext|>", "a" * 3000, "x " * 5000, "é ñ « 日本"]
    rows = [(k, " ".join(rnd.choice(["alpha", "beta,", "Gamma", "12", "!!"]) for _ in range(rnd.randrange(1, 900))), "en") for k in range(60)] + [(100 + k, t, None) for k, t in enumerate(odd)]
    got = pack(table(spark, rows).repartition(3), path).collect()
    t = Tokenizer.from_file(path)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x, _ in rows}
    sequences = collections.defaultdict(list)
    for i, pieces in collections.defaultdict(list, {i: sorted((r for r in got if r.doc_id == i), key=lambda r: r.start) for i in ids}).items():
        at = 0
        for r in pieces:
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
            sequences[r.sequence_id].append(r)
        assert at == len(ids[i])
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    assert pack(table(spark, []), path).count() == 0


def plain_windows(docs, size, most):
    """Bounded-space best fit on lists: the windows in the order they are closed, each a list of (doc_id, start, length)."""
    closed, open_ = [], []
    used = lambda w: sum(n for _, _, n in w)
    for doc, total in docs:
        start = 0
        while total - start >= size:
            closed.append([(doc, start, size)])
            start += size
        while start < total:
            n = total - start
            fitting = sorted((size - used(w), k) for k, w in enumerate(open_) if used(w) + n <= size)
            if fitting:
                window = open_[fitting[0][1]]
            elif len(open_) < most:
                open_.append(window := [])
            else:
                window = open_[min(range(len(open_)), key=lambda k: (-used(open_[k]), k))]
                n = size - used(window)
            window.append((doc, start, n))
            start += n
            if used(window) == size:
                closed.append(window)
                open_ = [w for w in open_ if w is not window]
    left = [(doc, start + k) for w in open_ for doc, start, n in w for k in range(n)]  # token by token
    while left:
        n = size if len(left) >= size else 1 << (len(left).bit_length() - 1)
        window = []
        for doc, at in left[:n]:
            if window and window[-1][0] == doc and window[-1][1] + window[-1][2] == at:
                window[-1] = (doc, window[-1][1], window[-1][2] + 1)
            else:
                window.append((doc, at, 1))
        closed.append(window)
        left = left[n:]
    return closed


@pytest.mark.parametrize(("size", "most", "partitions"), [(1024, 32, 1), (64, 3, 1), (128, 1, 4), (32, 8, 3)])
def test_packing_is_bounded_best_fit(spark, size, most, partitions):
    """The whole result, placement by placement, is that of a plain best fit in each partition, and nothing is padded."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from siftlake.llm.packing import pack

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(size)
    rows = [(k, rnd.choice([None, "", "a", "a b c", " ".join(rnd.choice(["alpha", "beta,", "12"]) for _ in range(rnd.randrange(1, 3 * size // 2)))]), "en") for k in range(150)]
    docs = table(spark, rows).repartition(partitions).persist()
    placed = docs.select("doc_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")).collect()
    got = pack(docs, path, size=size, open_windows=most).collect()
    tokens = {r.doc_id: r.doc_tokens for r in got}
    assert set(tokens) == {i for i, _, _ in rows}
    windows = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        windows[r.sequence_id].append((r.doc_id, r.start, r.length))
    for p in range(partitions):
        want = plain_windows([(r.doc_id, tokens[r.doc_id]) for r in sorted(placed, key=lambda r: r.at) if r.p == p], size, most)
        assert [windows[k] for k in sorted(windows) if k >> 36 == p] == want
    filled = [sum(n for _, _, n in w) for w in windows.values()]
    assert sum(filled) == sum(tokens.values()) and sum(size - n for n in filled if n & (n - 1)) == 0
    docs.unpersist()


def test_sentence_pieces(spark, tmp_path):
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    from siftlake.llm.sentence_pieces import Pieces, decode_ids, encode_documents, encode_ids

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    p = Pieces(path)
    texts = ["Hello world, this is a test.", "", " lead", "a  b   c ", "日本語 €uro 🙂", "\t\nx", "é" * 30, "aaaa" * 60, "123 456", None, "ends "]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(None, "x", None), (0, texts[0], "en")]

    def best(text):
        chars = "▁" + text.replace(" ", "▁") if text else ""
        score, path_to = [0.0] + [-math.inf] * len(chars), [[] for _ in range(len(chars) + 1)]
        known = {b.decode(): i for i, b in enumerate(p.bytes_of) if b and i not in set(p.byte_id.tolist())}
        for i in range(len(chars)):
            for j in range(i + 1, min(len(chars), i + 20) + 1):
                k = known.get(chars[i:j])
                s = score[i] + (p.score[k] if k is not None else p.least)
                if (k is not None or j == i + 1) and s > score[j]:
                    score[j], path_to[j] = s, path_to[i] + ([k] if k is not None else [int(p.byte_id[b]) for b in chars[i:j].encode()])
        return score[-1], path_to[-1]

    got = {r.doc_id: r.ids for r in encode_ids(table(spark, rows), path).collect()}
    for k, t in enumerate(texts):
        assert got[k] == best(t or "")[1]
    assert [p.bytes_of[i].decode() for i in got[0]][:2] == ["▁Hello", "▁world"]
    # the library with the same pieces and scores as a unigram model
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(path, "rb").read())
    proto.trainer_spec.model_type = 1
    for i, piece in enumerate(proto.pieces):
        if piece.type == 1:
            piece.score = float(p.score[i])
    (tmp_path / "unigram.model").write_bytes(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    more = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [(k, t, "en") for k, t in enumerate(texts + more)]
    own, same = ({r.doc_id: r.ids for r in encode_ids(table(spark, rows), x).collect()} for x in (path, str(tmp_path / "unigram.model")))
    assert own == same
    odd = [(own[k], other) for k, t, _ in rows if own[k] != (other := library.encode(t or ""))]
    gain = [math.fsum(p.score[a]) - math.fsum(p.score[b]) for a, b in odd]
    assert len(odd) < len(rows) / 10 and all(-1e-6 < g < 0.05 for g in gain), gain  # ties, but for single precision
    assert {r.doc_id: r.text for r in decode_ids(encode_ids(table(spark, rows), path), path).collect()} == {i: t or "" for i, t, _ in rows}
    out = encode_documents(table(spark, rows), path).collect()
    assert len(out) == len(rows) and all(r.restored for r in out)


def test_exact_topk(spark):
    from siftlake.llm.exact_topk import exact_topk

    rnd = np.random.default_rng(4)
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.round(rnd.normal(size=(90, 6)), 1))]
    vectors += [(200, [1.0] * 6), (201, [1.0] * 6), (202, [1.0] * 6), (203, None), (204, [float("nan")] * 6), (205, [None] + [1.0] * 5), (None, [2.0] * 6), (220, [3.0, 1.0]), (240, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, score int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_topk(df, lambda c: c % 20 == 0, k=5).collect()}
    good = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, x in good:
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:5]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert exact_topk(df.limit(0), lambda c: c % 20 == 0).count() == 0


def test_few_entries_are_resolved():
    from siftlake.llm.exact_topk import over_threshold

    rnd = np.random.default_rng(9)
    lists = [rnd.integers(-900, 900, (20, 3000)).astype(np.float64) for _ in range(4)]
    total = sum(lists)
    cutoff = np.sort(total, 1)[:, -10].astype(np.int64)
    row, column, score = over_threshold(lists, cutoff)
    want = {(i, j) for i in range(20) for j in np.flatnonzero(total[i] >= cutoff[i]).tolist()}
    assert set(zip(row.tolist(), column.tolist(), strict=True)) == want and (score == total[row, column]).all()
    taken = np.any([x >= cutoff[:, None] / 4 for x in lists], 0)
    assert taken.mean() < 0.6
    low = over_threshold([x - 5000 for x in lists], np.full(20, -(1 << 62)))  # no cutoff: all are taken
    assert len(low[0]) == total.size


def test_exact_topk_over_many_blocks(spark, monkeypatch):
    from siftlake.llm import exact_topk as module

    monkeypatch.setattr(module, "BLOCK", 7)
    monkeypatch.setattr(module, "QUERY_BLOCK", 2)
    x = np.random.default_rng(2).integers(-3, 4, (150, 5)) / 4
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in module.exact_topk(df, lambda c: c % 20 == 0, k=6).collect()}
    s = np.floor(64 * x).astype(int) @ np.floor(64 * x).astype(int).T
    want = {(q, r + 1): (j, int(s[q, j])) for q in range(0, 150, 20) for r, j in enumerate(sorted((j for j in range(150) if j != q), key=lambda j: (-s[q, j], j))[:6])}
    assert got == want


def test_embedding_dedup(spark, monkeypatch):
    from siftlake.llm import embedding_dedup as E

    monkeypatch.setattr(E, "TILE", 16)
    rnd = np.random.default_rng(5)
    centers = rnd.normal(size=(6, 12))
    rows = [(int(k), [float(x) for x in centers[k % 6] + rnd.normal(size=12) * rnd.choice([0.02, 0.2, 0.35])], int(k % 6 // 2)) for k in range(150)]
    rows += [(300, rows[0][1], rows[0][2]), (301, rows[0][1], 2), (302, None, 1), (303, [0.0] * 12, 1), (304, rows[1][1], None), (305, [float("nan")] * 12, 0), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0), rows[5]]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    ok = [(i, np.array(v), lab) for i, v, lab in rows if v and lab is not None and np.isfinite(v).all() and np.any(v)]
    link = lambda a, b: len(a[1]) == len(b[1]) and a[2] == b[2] and a[1] @ b[1] / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) >= 0.93
    n = collections.Counter()
    pairs = []
    for x in range(len(ok)):
        for y in range(len(ok)):
            if x != y and link(ok[x], ok[y]):
                n[x] += 1
                pairs.append((ok[x][0], ok[y][0]))
    low = classes([r[0] for r in rows], pairs)
    count = {ok[x][0]: n[x] for x in range(len(ok))}
    assert got == sorted((i, count.get(i, 0), low[i], low[i] == i) for i, _, _ in rows)
    clash = spark.createDataFrame([(1, [1.0, 0.0], 1, "x", [3]), (2, [1.0, 0.1], 1, "y", None), (None, [1.0, 0.0], 1, None, None)], "vec_id long, embedding array<float>, label int, node string, sizes array<int>")
    assert sorted(map(tuple, E.embedding_dedup(clash).collect()), key=str) == sorted([(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)], key=str)
    assert E.embedding_dedup(clash.filter("vec_id > 5")).count() == 0


def plain_kneser_ney(seqs, learn, order):
    """Log10 probabilities of the token lists seqs, learnt from those that learn marks; the training counts."""
    from siftlake.llm.lm_scoring import discounts

    c = [collections.Counter() for _ in range(order + 1)]
    for t, train in zip(seqs, learn, strict=True):
        if train:
            h = ["<s>"] * (order - 1) + t
            c[order].update(tuple(h[k : k + order]) for k in range(len(t)))
    for k in range(order - 1, 0, -1):
        for g in c[k + 1]:
            c[k][g[1:]] += 1
    raw = collections.Counter(w for t, train in zip(seqs, learn, strict=True) if train for w in t)
    cuts, context = [None], [None]
    for k in range(1, order + 1):
        m = collections.Counter(c[k].values())
        cuts.append(discounts([m[1], m[2], m[3], m[4]]))
        x = collections.defaultdict(lambda: [0, 0, 0, 0])
        for g, v in c[k].items():
            x[g[:-1]][min(v, 3) - 1] += 1
            x[g[:-1]][3] += v
        context.append(x)
    out = []
    for t in seqs:
        h, score = ["<s>"] * (order - 1) + t, 0.0
        for k in range(len(t)):
            p = 1 / (len(raw) + 1)
            for level in range(1, order + 1):
                g = tuple(h[k + order - level : k + order])
                if x := context[level].get(g[:-1]):
                    v, d = c[level][g], cuts[level]
                    p = (max(v - d[min(v, 3)], 0) + (d[1] * x[0] + d[2] * x[1] + d[3] * x[2]) * p) / x[3]
            score += math.log10(p)
        out.append(score)
    return out, raw


def test_language_model(spark):
    from siftlake.llm.lm_scoring import score_documents

    rnd = random.Random(6)
    rows = [(k, " ".join(rnd.choice("the a Of to in x y z u v w q".split()) for _ in range(rnd.randrange(0, 60))), "en") for k in range(80)] + [(900, None, None), (901, "", None), (902, "unseen", None), (3, "the the", "en")]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows}
    seqs = [(t or "").lower().split() + ["</s>"] for _, t, _ in rows]
    for order in (1, 2, 3):
        scores, raw = plain_kneser_ney(seqs, [not held[i] for i, _, _ in rows], order)
        total, want = sum(raw.values()), collections.Counter()
        for (i, _, _), t, score in zip(rows, seqs, scores, strict=True):
            base = sum(math.log10((raw[w] + 0.1) / (total + 0.1 * (len(raw) + 1))) for w in t)
            want[(i, held[i], len(t), sum(raw[w] > 0 for w in t), total, round(base, 6), round(score, 6))] += 1
        got = score_documents(table(spark, rows), order=order, block_bytes=2000).collect()
        assert collections.Counter((*list(r)[:5], round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert score_documents(table(spark, [])).count() == 0


def test_quality(spark):
    from siftlake.llm.quality import quality

    rnd = random.Random(7)
    rows = [(k, " ".join(rnd.choice("some plain words of good text here".split()) for _ in range(30)) if k % 5 else "".join(rnd.choice("#$%@!?*~") for _ in range(90)), "en") for k in range(60)] + [(99, None, None), (None, "plain", "en")]
    trusted = spark.createDataFrame([(k,) for k in range(60) if k % 5 and k % 2], "doc_id long")
    rows = [(i, t, "en" if k % 3 else "fr") for k, (i, t, _) in enumerate(rows)] + [(7, "one more text of id seven", "en"), (70, "ohne Freunde", None), (71, "ohne", None)]
    got = quality(table(spark, rows), trusted, order=4, block_bytes=500).collect()
    good = {k for k in range(60) if k % 5 and k % 2}
    learn = [i in good and zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows]
    scores, _ = plain_kneser_ney([[*(t or ""), "</s>"] for _, t, _ in rows], learn, 4)
    seen = [(i, lang, i in good, len(t or ""), round(10 ** (-s / (len(t or "") + 1)), 3), not train) for (i, t, lang), s, train in zip(rows, scores, learn, strict=True)]
    limit = {}
    for lang in ("en", "fr", None):
        own = [r for r in seen if r[1] == lang]
        of = [r[4] for r in own if r[2] and r[5]] or [r[4] for r in own if r[2]] or [r[4] for r in own]
        limit[lang] = sorted(of)[math.ceil(0.95 * len(of)) - 1]
    want = collections.Counter((*r[:4], r[4], limit[r[1]], r[4] <= limit[r[1]]) for r in seen)
    have = collections.Counter(tuple(r) for r in got)
    assert not (have - want or want - have), (list(have - want)[:3], list(want - have)[:3])
    assert not any(r.kept for r in got if r.doc_id in range(0, 60, 5)) and sum(r.kept for r in got if r.doc_id in good) > 15
    none = spark.createDataFrame([], "doc_id long")
    assert all(r.perplexity == 1 and r.kept for r in quality(table(spark, rows), none).collect())
    assert quality(table(spark, []), trusted).count() == 0


def test_toxicity(spark):
    from siftlake.llm.toxicity import toxicity

    rnd = random.Random(8)
    bad, plain = ["vilewordx", "nastyterm", "grimslur"], [f"plain{c}" for c in "abcdefghijklmnopqrst"]
    rows, labels = [], []
    for k in range(300):
        toxic = k % 4 == 0
        w = [rnd.choice(plain) for _ in range(40)] + ([rnd.choice(bad) for _ in range(3)] if toxic else [])
        rnd.shuffle(w)
        rows.append((k, " ".join(w), "en"))
        labels.append((k, int(toxic)))
    rows += [(900, None, None), (901, "", None), (None, "nastyterm nastyterm vilewordx", None)]
    labels += [(None, 1), (5, None), (0, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(table(spark, rows), lab).collect()}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in set(held)) for k in range(300))
    assert sum(got[k].predicted == (k % 4 == 0) for k in held) >= 0.95 * len(held)
    assert got[900].predicted == 0 and got[901].predicted == 0 and 0 <= got[None].score <= 1
    assert all(r.score == 0 for r in toxicity(table(spark, rows[:5]), lab.limit(0)).collect())


def test_toxicity_keeps_the_share_of_toxic_rows(spark):
    """The prior and the scores are those of all labelled rows, also where the sample cuts the classes."""
    from pyspark.sql import functions as F

    from siftlake.llm import toxicity as T

    rnd = random.Random(9)
    bad, plain = [f"vileword{c}" for c in "abcdef"], [f"plain{c}" for c in "abcdefghijklmnopqrst"]
    rows, labels = [], []
    for k in range(2000):
        toxic = k % 20 == 0
        weak = int(rnd.random() < (0.5 if toxic else 0.12))
        w = [rnd.choice(plain) for _ in range(40)] + [rnd.choice(bad) for _ in range(weak + 2 * (toxic and rnd.random() < 0.8))]
        rnd.shuffle(w)
        rows.append((k, " ".join(w), "en"))
        labels.append((k, int(toxic)))
    docs, lab = table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {}
    for cap in (4000, 80):
        model = T.fit(docs, lab, lambda c: F.lit(True), per_class=cap)
        assert abs(model.label_model.prior - 0.05) < 1e-9
        found[cap] = sum(r[1] for r in T.predict(docs, model).collect()) / len(rows)
    assert abs(found[80] - found[4000]) < 0.05


def test_language_id(spark):
    from siftlake.llm.language_id import identify

    rnd = random.Random(9)
    words = {"en": "the of and shall with this thing", "de": "der und nicht schule über das mädchen", "fr": "le que été dans une vous être", "es": "el que niño para una señor está", "zz": "xq zk qx vvz kzx zzq"}
    rows = [(k, " ".join(rnd.choice(words[lang].split()) for _ in range(20)), lang) for k, lang in enumerate(list(words) * 40)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 34 !!", "en"), (903, "€ × ÷", "en"), (None, "the of and", "en"), (904, "the of", None)]
    got = {r.doc_id: r for r in identify(table(spark, rows)).collect()}
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(got[k].lang_pred == rows[k][2] for k in held) >= 0.97 * len(held)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (900, 901, 902, 903))
    assert got[904].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in identify(table(spark, [(1, "x", None)])).collect()} == {"und"}


def test_language_id_learns_every_language(spark):
    from pyspark.sql import functions as F

    from siftlake.llm import language_id as L

    rnd = random.Random(12)
    names = [f"x{k:03}" for k in range(120)]
    words = {x: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3)] for x in names}
    rows = [(k, " ".join(rnd.choice(words[x]) for _ in range(12)), x) for k, x in enumerate(names * 4)]
    docs = table(spark, rows)
    model = L.fit(docs, lambda c: F.lit(True), most_rows=240)
    assert model.names == names
    got = {r.doc_id: r["__lang"] for r in L.predict(docs, model).collect()}
    assert sum(got[i] == x for i, _, x in rows) >= 0.95 * len(rows)


def test_components(spark):
    from siftlake.llm.common import Scratch, components

    rnd = random.Random(10)
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000 + rnd.randrange(200), 1000 + rnd.randrange(200)) for _ in range(120)] + [(5, 5)]
    low = classes({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert {k: got.get(k, k) for k in low} == low


@pytest.mark.parametrize("words_", [3, 500])
def test_long_texts_part_by_part(monkeypatch, words_):
    from siftlake.llm import common, lm_scoring, ngram_join

    rnd = random.Random(words_)
    text = " ".join(("x" * rnd.choice([1, 3, 900]) if words_ == 3 else f"W{rnd.randrange(90)}") + rnd.choice(["", "  ", "\n"]) for _ in range(words_)).encode()
    data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = [ngram_join._sets(data, at, n)[0] for n in (1, 3, 5)]
    tokens = lm_scoring.tokens(pa.array([text, b"a b", text], pa.binary()))
    for module in (common, lm_scoring, ngram_join):
        monkeypatch.setattr(module, "SLICE_BYTES", 200)
    monkeypatch.setattr(ngram_join, "long_cuts", lambda d, a, b: common.long_cuts(d, a, b, 200))
    monkeypatch.setattr(lm_scoring, "long_cuts", lambda d, a, b: common.long_cuts(d, a, b, 200))
    monkeypatch.setattr(lm_scoring, "slices", lambda o: common.slices(o, 200))
    for n, s in zip((1, 3, 5), whole, strict=True):
        assert (ngram_join.shingle_sets(data, at, n)[0] == s).all()
    again = lm_scoring.tokens(pa.array([text, b"a b", text], pa.binary()))
    assert (again[0] == tokens[0]).all() and (again[1] == tokens[1]).all()


def test_sorted_numbers_survive_packing():
    from siftlake.llm.common import pack_sorted, unpack_sorted

    rnd = np.random.default_rng(3)
    for x in ([], [7], [5, 5, 6], [0, 1 << 63, (1 << 64) - 1], np.sort(rnd.integers(0, 1 << 40, 5000)), np.append(np.arange(3000), [1 << 30, 1 << 60])):
        x = np.array(x, np.uint64)
        assert (unpack_sorted(pack_sorted(x)) == x).all()


def test_kernels_agree_on_slices():
    from siftlake.llm.common import text_bytes
    from siftlake.llm.ngram_join import shingle_sets

    texts = ["a b c d", "", None, "x", "A b C d e f", "a b c d"]
    data, offsets = text_bytes(pa.array(texts))
    s, o = shingle_sets(data, offsets, 3)
    for k, t in enumerate(texts):
        d, f = text_bytes(pa.array([t]))
        assert (shingle_sets(d, f, 3)[0] == s[o[k] : o[k + 1]]).all()
