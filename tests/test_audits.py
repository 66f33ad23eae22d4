"""Parsers, spans, sources, versions, audits and block kernels against literal cases and plain versions."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import audits as A
from siftlake.operators import corpus as C
from siftlake.operators import parsing as P
from siftlake.operators import lexical_index as X
from siftlake.operators import retrieval as R
from siftlake.operators import spans as D
from siftlake.operators import suite as U
from siftlake.sources import tables as S


def test_spans_against_a_character_by_character_version(spark):
    lexicon = {"material": ["titanium alloy", "titanium", "알루미늄"], "use": ["alloy wheel", "wheel", "a b"], "code": ["10"]}
    rnd = random.Random(4)
    words = ["titanium", "alloy", "wheel", "10", "5.5 mm", "3kg", "Titanium  Alloy", "알루미늄", "x", "a", "b", "12 ", "7 GHz,", "titaniums"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 25))) for _ in range(60)] + [None, "", "10 items", "알루미늄10mm"]

    def plain(text):
        taken, out = [False] * len(text), []
        rules = [(D.NUMBERS, "<numeric>", re.compile(r"\d+(?:[.,]\d+)?\s*(?:" + "|".join(re.escape(u) for u in sorted(D.UNITS, key=len, reverse=True)) + ")?", re.I))]
        for c, terms in lexicon.items():
            for t in sorted(terms, key=len, reverse=True):
                body = r"\s+".join(map(re.escape, t.split()))
                rules.append((c, t, re.compile(rf"\b{body}\b", re.I) if t.isascii() else re.compile(body)))
        for c, t, p in rules:
            for m in p.finditer(text):
                s = m.group().rstrip() if c == D.NUMBERS else m.group()
                span = range(m.start(), m.start() + len(s))
                if s and not any(taken[i] for i in span):
                    for i in span:
                        taken[i] = True
                    out.append((c, t, s, m.start()))
        return sorted(out, key=lambda x: x[3])

    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: [tuple(s) for s in r.s] for r in rows.select("id", D.annotate(F.col("text"), lexicon).alias("s")).collect()}
    assert got == {k: plain(t or "") for k, t in enumerate(texts)}
    m = {r.id: r for r in D.measure(rows, "id", "text", lexicon, ["material", D.NUMBERS]).collect()}
    for k, t in enumerate(texts):
        spans = plain(t or "")
        width = lambda s: max(1, len(re.findall("[A-Za-z0-9가-힣]+", s[2])))
        own = [s for s in spans if s[0] in ("material", D.NUMBERS)]
        assert m[k].fields == ",".join(sorted({s[0] for s in own})) and m[k].tokens == sum(map(width, own)) and m[k].spans == len(own) and m[k].chars == len(t or "")
    assert [s[2] for s in got[62]] == ["10"]


def test_lines_that_begin_entries_and_lines_that_do_not(spark):
    fake = ["2. In the form of uncomminuted flakes; and", "3. In a liquid state at 273 K (0°C); and", "1. It is restricted for use in systems", "5. At the output of the amplifier;", "3.A.1.a.10. and 3.A.1.a.12., based upon", "8.E.2.a. & 8.E.2.b.", "plain text"]
    real = {"1. A. 3. Manufactures of aromatic polyimides": "1.A.3", "1. A. 4. a. 1. Agents;": "1.A.4.a.1", "3. A. 2. d. 4. A Single Sideband": "3.A.2.d.4", "2. E. TECHNOLOGY": "2.E", "6. A. 1. a. 1. a. 2. Equipment": "6.A.1.a.1.a.2"}
    rows = spark.createDataFrame([(x,) for x in [*fake, *real]], "line string")
    got = {r.line: r.r for r in rows.select("line", P.repair_code(F.col("line")).alias("r")).collect()}
    assert all(got[x].code is None and got[x].text == x for x in fake)
    assert {x: got[x].code for x in real} == real
    drop = ["_____", "WA-LIST (25) 1 Corr.", "- 40 - 15-01-2026", "15-01-2026 - 95 -", "DUAL-USE LIST - CATEGORY 2", "MUNITIONS LIST", "* The note", "  "]
    keep = {"Wassenaar Arrangement Participating States; and": "Wassenaar Arrangement Participating States; and", "Note 2.d.*": "Note 2.d.", "  a. A thickness; or ": "a. A thickness; or"}
    rows = spark.createDataFrame([(x,) for x in [*drop, *keep]], "line string")
    got = {r.line: r.c for r in rows.select("line", P.clean_line(F.col("line")).alias("c")).collect()}
    assert all(got[x].line is None for x in drop) and {x: got[x].line for x in keep} == keep and got["Note 2.d.*"].marked


def test_list_parser_against_a_line_by_line_version(spark):
    rnd = random.Random(8)
    heads = ["Appendix 3 - SCOMET List", "ANNEXURE - I", "Annexure to Notification 5", "other", "____\nAPPENDIX-3"]
    lines = ["8A301 Alpha beta", "8A302. gamma;", "8A3 ELECTRONICS", "8B1 or 8C.", "more words here.", "Item column", "", "(Reserved)", "0A301 (Reserved)", "8A301 again and again"]
    books = {b: [(k + 1, rnd.choice(heads[:1] * 4 + heads) + "\n" + "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(0, 8)))) for k in range(12)] for b in "xyz"}

    def plain(pages):
        entries, current, inside = [], None, False
        for page, text in pages:
            rows = [x.strip() for x in text.split("\n")]
            header = next((x for x in rows if x and not re.match(P.RULE, x)), "")
            if re.match(P.LIST_COVER, header):
                current = None
                continue
            if re.match(P.LIST_ANNEX, header):
                current, inside = None, False
                continue
            inside = inside or bool(re.match(P.LIST_HEADER, header))
            if not inside:
                current = None
                continue
            for x in rows:
                if not x or re.match(P.LIST_HEADER, x) or x.startswith(P.LIST_SKIP):
                    continue
                m = re.match(P.LIST_ENTRY, x)
                if re.match(P.LIST_HEADING, x) and not m:
                    current = None
                elif m and (current is None or current["code"] != "".join(m.groups()[:4])):
                    entries.append(current := {"code": "".join(m.groups()[:4]), "text": [m[5].strip()], "pages": {page}, "flags": set()})
                elif current is not None:
                    current["text"].append(m[5].strip() if m else x)
                    current["pages"].add(page)
                    if m:
                        current["flags"].add("table_row_merged")
        best, flags, seen = {}, {}, {}
        for e in entries:
            text = " ".join(" ".join(e["text"]).split())
            stub = not text or re.match(T.STUB_TEXT, text)
            if len(text) < P.SHORTEST and not stub:
                continue
            f = e["flags"] | ({"page_continuation"} if len(e["pages"]) > 1 else set())
            flags[e["code"]] = flags.get(e["code"], set()) | f
            seen[e["code"]] = seen.get(e["code"], 0) + 1
            if e["code"] not in best or len(text) > len(best[e["code"]][0]):
                best[e["code"]] = (text, sorted(e["pages"]))
        out = {}
        for code, (text, pages_) in best.items():
            f = flags[code] | ({"duplicate_occurrences"} if seen[code] > 1 else set()) | (set() if re.search(P.TERMINATOR, text) else {"unterminated_text"}) | ({"spans_many_pages"} if len(pages_) > 3 else set())
            out[code] = (text, pages_, sorted(f), "stub" if not text or re.match(T.STUB_TEXT, text) else "full", seen[code] - 1)
        return out

    rows = spark.createDataFrame([(b, k, t) for b, pages in books.items() for k, t in pages], "book string, page int, text string")
    got = {}
    for r in P.parse_list(rows).collect():
        got.setdefault(r.book, {})[r.code] = (r.text, r.pages, r.parse_flags, r.text_completeness, r.duplicate_occurrences)
    assert got == {b: p for b, pages in books.items() if (p := plain(pages))}


XML = """<DIV9><HEAD>x</HEAD><HD1>Category 3—Electronics</HD1><HD1>A. Items</HD1><P>lost</P>
<FP-2><B>3A090 Circuits (see <I>List</I>).</B></FP-2><FP-1><E>License Requirements</E></FP-1><FP-1><I>Reason for Control:</I> RS, AT</FP-1>
<DIV><TABLE><TR><TD>RS applies</TD><TD>Column 1.</TD></TR><TR><TD>AT</TD></TR></TABLE></DIV>
<HD1>List Based License Exceptions (See Part 740)</HD1><FP-1><I>LVS:</I> N/A</FP-1><HD1>List of Items Controlled</HD1>
<FP-1><I>Related Controls:</I> See 3D001.</FP-1><FP><I>Items</I></FP><HD2>Optics</HD2><P>a. Circuits.</P><NOTE><HED>Note 1:</HED><P>Small ones.</P></NOTE>
<FP-1><B>5A001 Radio</B> systems.</FP-1><FP-1><I>List of Items Controlled</I></FP-1><FP-1><I>Related Controls:</I> none</FP-1><P>b. Any radio.</P><HD1>Part 2—Other</HD1><P>lost</P>
<FP-2><B>9A007 Rockets.</B></FP-2><FP-1><E>License Requirements</E></FP-1></DIV9>"""


def test_xml_appendix(spark):
    rows = spark.createDataFrame([(1, XML), (2, "no xml"), (3, None)], "id long, xml string")
    got = {r.code: r for r in P.appendix_entries(rows, "xml", "id").collect()}
    assert set(got) == {"ECCN-3A090", "ECCN-5A001", "ECCN-9A007"}
    a, b, c = got["ECCN-3A090"], got["ECCN-5A001"], got["ECCN-9A007"]
    assert (a.category_title, a.product_group, a.heading, a.items_source, a.related_controls, a.reason_for_control) == ("Electronics", "A", "Circuits (see List).", "items_marker", "See 3D001.", "RS, AT")
    assert a.items == "Optics a. Circuits. Note 1: Small ones." and a.text == f"{a.heading} {a.items}"
    assert a.sections["License Requirements"] == "Reason for Control: RS, AT RS applies | Column 1. ;; AT" and "List Based License Exceptions" in a.sections
    assert (b.heading, b.items, b.items_source, b.related_controls) == ("Radio systems.", "b. Any radio.", "loic_body_fallback", "none")
    assert c.heading_only and c.items_source == "none" and c.text == "Rockets."
    assert {r.text for r in P.appendix_entries(rows, "xml", "id", text_field="heading").collect()} == {a.heading, b.heading, c.heading}
    nodes = spark.createDataFrame([('{"a": [{"label": "x", "children": [{"label": "y"}]}]}',), ('{"label": "z"}',), ("no",), (None,)], "j string")
    assert [r.x for r in nodes.select(P.has_node(F.col("j"), "label", "y").alias("x")).collect()] == [True, False, False, False]


def test_structural_codes_and_successors(spark):
    entries = spark.createDataFrame([("3.A.3", "wassenaar_2025"), ("8A303", "india_scomet_2024"), ("8.B.1", "wassenaar_2025"), ("8B801", "india_scomet_2024"), ("1.A.101", "wassenaar_2025")], "code string, source string")
    codes = spark.createDataFrame([("ECCN-3A003",), ("ECCN-8B001",), ("ECCN-1A101",), ("ECCN-5A991",), ("ECCN-8A620",)], "code string")
    got = sorted((r.code, r.counterpart) for r in A.structural_codes(codes, entries).collect())
    assert got == [("ECCN-3A003", "3.A.3"), ("ECCN-3A003", "8A303"), ("ECCN-8B001", "8.B.1"), ("ECCN-8B001", "8B801")]
    present = spark.createDataFrame([("1.A.2.a",), ("1.A.2.b",), ("1.A.3",), ("1.A.2",), ("2.B",)], "code string")
    gone = spark.createDataFrame([("1.A.2.c",), ("2.C.1",), ("9.Z",)], "code string")
    got = sorted((r.code, r.successor) for r in A.successors(gone, present).collect())
    assert got == [("1.A.2.c", "1.A.2"), ("1.A.2.c", "1.A.2.a"), ("1.A.2.c", "1.A.2.b"), ("2.C.1", "2.B")]


def test_twins_against_all_pairs(spark):
    rnd = random.Random(2)
    sets = [[f"w{rnd.randrange(25)}" for _ in range(rnd.randrange(0, 12))] for _ in range(80)]
    left = spark.createDataFrame([(k, s) for k, s in enumerate(sets[:30])], "left_id long, toks array<string>")
    right = spark.createDataFrame([(k, s) for k, s in enumerate(sets[30:])], "right_id long, toks array<string>")
    for least in (0.3, 0.5, 1.0):
        want = {}
        for i, a in enumerate(sets[:30]):
            for j, b in enumerate(sets[30:]):
                if a and b and (x := round(len(set(a) & set(b)) / len(set(a) | set(b)), 9)) >= least:
                    want[i] = max(want.get(i, (0, 0)), (x, j))
        assert {r.left_id: (r.jaccard, r.right_id) for r in A.twins(left, right, least).collect()} == want


def test_curated_set_refuses_what_it_does_not_know(spark):
    q, e = spark.createDataFrame([(1, "one")], "query_id long, text string"), spark.createDataFrame([("A",)], "code string")
    make = lambda rows: A.curated_set(spark.createDataFrame(rows, "query_id long, label string"), q, e)
    assert [tuple(r) for r in make([(1, "A")]).collect()] == [(1, "A", "one")]
    for rows in ([(2, "A")], [(1, "B")]):
        with pytest.raises(Exception, match="unknown"):
            make(rows).collect()


def test_versions_files_and_reports(spark, tmp_path):
    v = S.Versions(spark, f"{tmp_path}/corpus")
    assert v.active() is None
    v.adopt(spark.range(3), "v1")
    v.adopt(spark.range(5), "v2")
    assert v.active() == "v2" and v.read().count() == 5
    assert v.revert() == "v1" and v.read().count() == 3 and v.read("v2").count() == 5
    with pytest.raises(ValueError):
        S.Versions(spark, f"{tmp_path}/none").revert()
    path = f"{tmp_path}/files/a.txt"
    (tmp_path / "files").mkdir()
    good = hashlib.sha256(b"abc").hexdigest()
    assert S.guarded_copy(spark, b"abc", path, good) and not S.guarded_copy(spark, b"abd", path, good)
    assert (tmp_path / "files/a.txt").read_bytes() == b"abc"
    (tmp_path / "files/b.txt").write_bytes(b"x\fy")
    found = {r.path.rsplit("/", 1)[1]: r.path for r in S.file_hashes(spark, f"{tmp_path}/files/*.txt").collect()}
    manifest = spark.createDataFrame([(found["a.txt"], good), ("file:/nowhere", good)], "path string, sha256 string")
    assert sorted(r.status for r in S.verified(spark, f"{tmp_path}/files/*.txt", manifest).collect()) == ["missing", "ok", "unregistered"]
    split = lambda b: b.decode().split("\f")
    pages = S.pages(spark, f"{tmp_path}/files/b.txt", split, f"{tmp_path}/cache")
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(1, "x"), (2, "y")]
    (tmp_path / "files/b.txt").unlink()
    assert S.pages(spark, f"{tmp_path}/files/b.txt", split, f"{tmp_path}/cache").count() == 2  # from the cache
    rows = spark.createDataFrame([("a|b", 0.12345, None)], "name string, x double, y int")
    assert S.markdown(rows, "Report").splitlines()[2:] == ["| name | x | y |", "|-|-|-|", "| a\\|b | 0.123 | - |"]
    S.write_json(rows, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").first().name == "a|b"
    assert S.environment(spark, seed=7).first().seed == "7"
    dates = spark.createDataFrame([(15, "2026-01-01"), (15, "2026-07-23"), (16, "2027-01-01"), (15, None)], "title int, date string")
    assert S.latest_date(dates, 15).first().latest == "2026-07-23"


def test_shards_merge_only_if_they_agree(spark):
    rows = [(m, r, q, h) for m in ("a", "b") for r, h in (("BM25", 1), ("dense", 0)) for q in (1, 2)]
    schema = "model string, retriever string, query_id long, hit int"
    assert S.merged_shards(spark.createDataFrame(rows, schema)).count() == 8
    odd = spark.createDataFrame([*rows[:-4], ("b", "BM25", 1, 0), ("b", "BM25", 2, 1), *rows[-2:]], schema)
    with pytest.raises(ValueError, match="BM25"):
        S.merged_shards(odd)
    assert S.merged_shards(odd, override=True).count() == 8
    with pytest.raises(ValueError, match="ids"):
        S.merged_shards(spark.createDataFrame([*rows, ("a", "BM25", 3, 1)], schema))


def test_block_kernels_agree_with_the_join_plans(spark, monkeypatch):
    rnd = random.Random(5)
    docs = spark.createDataFrame([(k, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 9)))) for k in range(60)], "corpus_idx long, text string")
    q = spark.createDataFrame([(1, "a a b"), (2, "zz"), (3, "h"), (4, "")], "query_id long, text string")
    index = R.bm25_index(docs)
    scores = R.bm25_scores(index, R.query_tokens(q))
    want = sorted((r.query_id, r["rank"], r.corpus_idx, round(r.score, 8)) for r in R.top_k(scores, docs, 25).collect())
    for queries, first in ((512, 2), (512, 1), (2, 1)):
        monkeypatch.setattr(X, "QUERIES", queries)
        monkeypatch.setattr(X, "FIRST", first)
        assert sorted((r.query_id, r["rank"], r.corpus_idx, round(r.score, 8)) for r in R.bm25_topk(docs, q, 25).collect()) == want
    left = docs.filter("corpus_idx < 9").select(F.col("corpus_idx").alias("left_id"), "text")
    right = docs.select(F.col("corpus_idx").alias("right_id"), "text")
    rows = lambda: sorted((r.left_id, r["rank"], r.right_id, r.jaccard) for r in C.jaccard_candidates(left, right, 7).collect())
    whole = rows()
    own = {r.corpus_idx: set(r.text.split()) for r in docs.collect()}
    plain = [(a, n + 1, b, round(j, 9)) for a in range(9) for n, (j, b) in enumerate(sorted(((len(own[a] & own[b]) / len(own[a] | own[b]), b) for b in own if own[a] & own[b]), reverse=True)[:7])]
    assert whole == plain and len(plain) > 30
    monkeypatch.setattr(C, "LEFT_ROWS", 2)
    monkeypatch.setattr(C, "RIGHT_ROWS", 9)
    assert rows() == whole
    loose = R.permissive(scores, q, docs, 3).filter("query_id in (2, 4)").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.corpus_idx) for r in loose] == [(2, 0), (2, 1), (2, 2), (4, 0), (4, 1), (4, 2)]
    x = np.round(np.random.default_rng(1).normal(size=(70, 6)), 1)
    v = spark.createDataFrame([(k, [float(c) for c in r]) for k, r in enumerate(x)] + [(99, None)], "corpus_idx long, v array<double>").repartition(3)
    asked = spark.createDataFrame([(k, [float(c) for c in x[k]]) for k in (0, 7, 9)], "query_id long, q array<double>")
    got = sorted((r.view, r.query_id, r["rank"], r.corpus_idx) for r in R.dense_topk(asked, v, 5, {"two": 2, "six": 6}, others_only=True).collect())
    want = []
    for name, n in (("two", 2), ("six", 6)):
        for k in (0, 7, 9):
            s = np.round(x[:, :n] @ x[k, :n], 9)
            order = [j for j in sorted(range(70), key=lambda j: (-s[j], j)) if j != k][:5]
            want += [(name, k, i + 1, j) for i, j in enumerate(order)]
    assert got == sorted(want)


def test_evidence_and_inflection(spark):
    rows = [("r", 1, -0.01, False, True, False), ("r", 2, -0.02, False, False, False), ("r", 3, -0.06, False, True, False), ("r", 4, 0.0, False, True, True), ("s", 1, 0.1, True, False, False), ("s", 2, -0.04, True, True, False)]
    levels = spark.createDataFrame(rows, "retriever string, level int, mean double, significant boolean, equivalent boolean, confounded boolean")
    got = {(r.retriever, r.level): (r.tier, r.recommended) for r in U.evidence(levels, "retriever").collect()}
    assert got == {("r", 1): ("A", 2), ("r", 2): ("B", 2), ("r", 3): ("C", 2), ("r", 4): ("D", 2), ("s", 1): ("B", 1), ("s", 2): ("C", 1)}
    assert {r.retriever: (r.first_drop, r.deepest_safe) for r in U.inflection(levels, "retriever").collect()} == {"r": (None, 4), "s": (2, 1)}


def test_jobs_write_what_queries_give(spark, tmp_path):
    from siftlake import jobs

    folder = "/root/testdata/sf0.001"
    done = jobs.run(spark, folder, str(tmp_path), ["g1_gate_independence", "a9_label_space"], report=True)
    assert done == ["g1_gate_independence", "a9_label_space"] and spark.read.parquet(f"{tmp_path}/a9_label_space").count() == 1
    assert spark.read.text(f"{tmp_path}/a9_label_space.md").count() > 2
    assert jobs.assembled(spark, str(tmp_path), done).groupBy("query").count().count() == 2
    assert set(jobs.names(["all"])) >= set(jobs.GROUPS["gates"])
    with pytest.raises(ValueError):
        jobs.names(["nothing"])
    said = jobs.run_models(spark, folder, f"{tmp_path}/models", ["d16", "d999"])
    assert said["d16"] is None and "LookupError" in said["d999"] and spark.read.parquet(f"{tmp_path}/models").select("model").distinct().count() == 1


def test_sources_that_are_there_and_sources_that_are_not(spark, tmp_path):
    (tmp_path / "full.json").write_text('[{"id": 1, "text": "한글"}, {"id": 2}]', encoding="utf-8")
    schema = "id long, text string"
    assert [tuple(r) for r in S.json_table(spark, f"{tmp_path}/full.json", schema).orderBy("id").collect()] == [(1, "한글"), (2, None)]
    none = S.json_table(spark, f"{tmp_path}/none.json", schema)
    assert none.count() == 0 and none.columns == ["id", "text"]
    for full, smoked in (("full", False), ("none", True)):
        rows = S.first_present(spark, f"{tmp_path}/{full}.json", f"{tmp_path}/full.json", schema).collect()
        assert len(rows) == 2 and all(r.is_smoke == smoked for r in rows)
    (tmp_path / "shard_a.json").write_text('[{"id": 3}]')
    got = S.shards(spark, f"{tmp_path}/shard_*.json", schema).collect()
    assert [r.id for r in got] == [3] and got[0].shard.endswith("shard_a.json")
