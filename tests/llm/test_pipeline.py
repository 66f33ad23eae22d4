"""The pipeline on a small table: each stage's rows against a plain version of its decision."""

from __future__ import annotations

import random

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rnd = random.Random(11)
    plain = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randrange(3, 8))) for _ in range(400)]
    bad = ["vilewordx", "nastyterm", "grimslur"]
    passage = " ".join(rnd.choice(plain) for _ in range(60))
    rows, labels = [], []
    for k in range(120):
        toxic = k % 6 == 0
        w = [rnd.choice(plain) for _ in range(80)] + ([rnd.choice(bad) for _ in range(4)] if toxic else [])
        rnd.shuffle(w)
        rows.append((k, " ".join(w) + (" " + passage if k in (1, 2) else ""), "en", "s", 0))
        labels.append((k, int(not toxic), int(toxic)))
    rows += [(200 + k, rows[7][1].replace(" ", "  ") + (" tail" if k else ""), "en", "s", 0) for k in range(5)] + [(300, "123 !!", "en", "s", 0), (301, None, "en", "s", 0), (302, "", None, "s", 0), (None, rows[8][1], "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/sf/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/sf/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/sf/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, f"{tmp_path}/sf").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
        if k < len(P.STAGES) - 1:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    ids = [{r.doc_id for r in d.select("doc_id").distinct().collect()} for d in seen]
    assert ids[0] == {r[0] for r in rows} - set(range(0, 120, 6))
    assert ids[1] == ids[0] - {300, 301, 302}
    assert ids[2] == ids[1] - set(range(200, 205))
    text = {r.doc_id: r for r in seen[3].collect()}
    assert passage not in text[1].text and passage not in text[2].text and text[1].n_chars == len(text[1].text)
    assert text[9].text == rows[9][1]
    assert ids[4] == ids[3] == ids[2]
    assert P.run(spark, f"{tmp_path}/sf").count() == seen[4].count()


def test_near_copies_by_five_words(spark, tmp_path):
    """Two words of 100 replaced: 5-gram Jaccard 86 / 106, 3-gram Jaccard 92 / 104."""
    base = [f"w{k}" for k in range(100)]
    near, far = list(base), list(base)
    near[30] = near[60] = "changed"
    for k in (20, 40, 60, 80):
        far[k] = "changed"
    docs = spark.createDataFrame([(k, " ".join(w), "en", "s", 0) for k, w in enumerate((base, near, far))], SCHEMA)
    assert sorted(r.doc_id for r in P.one_of_each_group(spark, docs, str(tmp_path)).collect()) == [0, 2]


def test_rows_of_one_id_and_empty_tables(spark, tmp_path):
    rows = [(5, "b one text", "en", "s", 1), (5, "a another one", "en", "s", 2), (None, "a another one", "en", "s", 3), (7, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, P.one_of_each_group(spark, docs, str(tmp_path)).collect()), key=str) == sorted(rows[1:], key=str)
    none = docs.limit(0)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_of_any_name(spark, tmp_path):
    """Columns that stages use themselves, need quotes, or differ by case only; other columns pass through every stage."""
    extra = ["__score", "__lang", "__text", "__id", "__rows", "__row", "a.b", "c0", "Text", "row", "block", "`odd`"]
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghilm") for _ in range(5)) for _ in range(300)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(40)), "en", "s", 1, *[f"{c}{k}" for c in extra]) for k in range(30)]
    rows.append((40, rows[3][1], "en", "s", 1, *[f"{c}40" for c in extra]))
    kinds = ["long", "string", "string", "string", "long", *["string"] * len(extra)]
    names = ["doc_id", "text", "lang", "source", "n_chars", *extra]
    docs = spark.createDataFrame(rows, ", ".join(f"x{k} {t}" for k, t in enumerate(kinds))).toDF(*names)
    spark.createDataFrame([(k, 1, int(k % 2)) for k in range(0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == names
        got = {r[0]: tuple(r)[5:] for r in out.collect()}
        assert got == {r[0]: r[5:] for r in rows if k < 2 or r[0] != 40 or stage is P.cut_repeats}
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 31
