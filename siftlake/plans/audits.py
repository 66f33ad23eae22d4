"""Queries of the audits: labels, spans, ladders, slices, sets of queries, parsers, sources, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import audits as A
from siftlake.operators import corpus as C
from siftlake.operators import integrity as I
from siftlake.operators import parsing as P
from siftlake.operators import spans as D
from siftlake.plans.queries import CLEAN, CODE, CORPUS, GOLD, KEYS, NORM, _benchmark, _gold, first, query, tok
from siftlake.sources import tables as S
from siftlake.sources.tables import corpus, table

GENERIC = ["that", "this", "with", "from"]
GOLD_CODES = f"{GOLD}, gc AS (SELECT DISTINCT query_id, code FROM gold JOIN c USING (corpus_idx))"
STUB = r"regexp_matches(text, '(?i)\(\s*see\s+(?:the\s+)?list\s+of\s+items\s+cont(?:r)?ol')"


def _gold_codes(spark, d) -> DataFrame:
    return _gold(spark, d).join(corpus(spark, d).select("corpus_idx", "code"), "corpus_idx").select("query_id", "code").distinct()


# ---------------------------------------------------------------- text and codes

GRAMMARS = f"""CASE source WHEN 'ecfr_part774' THEN regexp_matches(code, '{T.CODE_GRAMMAR["ecfr_part774"]}') WHEN 'india_scomet_2024' THEN regexp_matches(code, '{T.CODE_GRAMMAR["india_scomet_2024"]}') WHEN 'wassenaar_2025' THEN regexp_matches(code, '{T.CODE_GRAMMAR["wassenaar_2025"]}') ELSE false END"""
FRAGMENT = "regexp_matches(t, '(?i)^\\s*(?:or|and|&)\\b') AND length(t) < 80"
DROPPED = f"""CASE WHEN trim(code) = '' OR t = '' THEN 'empty_code_or_text' WHEN NOT code_ok THEN 'invalid_code_format'"""
MIXED = """m AS (SELECT corpus_idx, source, CASE WHEN corpus_idx % 19 = 0 THEN code || '-x' WHEN corpus_idx % 23 = 0 THEN '' WHEN source = 'wassenaar_2025' AND corpus_idx % 7 = 0 THEN substr(code, 1, 3) ELSE code END AS code,
CASE corpus_idx % 29 WHEN 0 THEN '[Reserved]' WHEN 1 THEN 'Not used since 2017' WHEN 2 THEN 'Software' WHEN 3 THEN ' or parts of it ' WHEN 4 THEN '' WHEN 5 THEN 'Widgets (see List of Items Controlled).' ELSE text END AS text FROM c)"""


def _mixed(spark, d) -> DataFrame:
    """The corpus with some odd codes, headings, stubs and fragments in it."""
    i = F.col("corpus_idx")
    code = F.when(i % 19 == 0, F.concat("code", F.lit("-x"))).when(i % 23 == 0, "").when((F.col("source") == "wassenaar_2025") & (i % 7 == 0), F.substring("code", 1, 3)).otherwise(F.col("code"))
    text = F.col("text")
    for k, t in reversed(list(enumerate(("[Reserved]", "Not used since 2017", "Software", " or parts of it ", "", "Widgets (see List of Items Controlled).")))):
        text = F.when(i % 29 == k, t).otherwise(text)
    return corpus(spark, d).withColumns({"code": code, "text": text})


@query(f"""WITH {CORPUS}, {MIXED}, x AS (SELECT *, {CLEAN} AS t, {GRAMMARS} AS code_ok FROM m)
SELECT corpus_idx, md5(t) AS clean_md5, code_ok,
array_to_string(list_filter([CASE WHEN length(text) < 40 THEN 'short_text' END, CASE WHEN regexp_matches(text, '(?i)^\\s*(?:or|and|&)\\b') THEN 'possible_fragment' END, CASE WHEN regexp_matches(text, '{CODE}') THEN 'contains_cross_reference' END, CASE WHEN {KEYS} THEN 'possible_national_core_technology_review' END], lambda z: z IS NOT NULL), ',') AS flags,
{DROPPED} WHEN regexp_matches(t, '{T.DROP_TEXT}') THEN 'non_control_or_reserved_heading' WHEN {FRAGMENT} THEN 'short_fragment' END AS drop_reason, {DROPPED} END AS drop_reason_v2,
CASE WHEN trim(text) = '' OR regexp_matches(trim(text), '{T.STUB_TEXT}') THEN 'stub' WHEN regexp_matches(code, '{T.CATEGORY_CODE}') THEN 'heading_only' ELSE 'full' END AS completeness FROM x""")
def p9_p14_clean_flags_drop(spark, d):
    return _mixed(spark, d).select("corpus_idx", F.md5(T.clean_text("text")).alias("clean_md5"), T.valid_code("source", "code").alias("code_ok"), F.array_join(T.quality_flags("text"), ",").alias("flags"), T.drop_reason("source", "code", "text").alias("drop_reason"), T.drop_reason("source", "code", "text", 2).alias("drop_reason_v2"), T.completeness("code", "text").alias("completeness"))


META = [("ecfr_part774", "US", "list one"), ("india_scomet_2024", "IN", "list two"), ("wassenaar_2025", "WA", "list three")]


@query(f"""WITH {CORPUS}, {MIXED}, x AS (SELECT *, {CLEAN} AS t, {GRAMMARS} AS code_ok FROM m), mt AS (SELECT * FROM (VALUES ('ecfr_part774', 'US', 'list one'), ('india_scomet_2024', 'IN', 'list two'), ('wassenaar_2025', 'WA', 'list three')) v(source, system, route))
SELECT corpus_idx, trim(code) AS code, md5(t) AS text_md5, system, route, CAST(length(t) AS BIGINT) AS n_chars FROM x JOIN mt USING (source) WHERE ({DROPPED} END) IS NULL""")
def p13_normalised_entries(spark, d):
    meta = spark.createDataFrame(META, "source string, system string, route string")
    return C.normalised(_mixed(spark, d), meta).select("corpus_idx", "code", F.md5("text").alias("text_md5"), "system", "route", F.length("text").cast("long").alias("n_chars"))


@query(f"""WITH {CORPUS}, {MIXED} SELECT source, CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE {STUB}) AS marked, count(*) FILTER (WHERE {STUB} OR length(trim(text)) < 150) AS content_stub, count(*) FILTER (WHERE length(text) >= 150 AND corpus_idx % 2 = 0) AS with_items FROM m GROUP BY 1""")
def p24_stub_predicates(spark, d):
    m = _mixed(spark, d)
    items = F.when((F.length("text") >= 150) & (F.col("corpus_idx") % 2 == 0), F.col("text"))
    return m.groupBy("source").agg(F.count("*").alias("n"), F.count_if(T.is_stub_marker("text")).alias("marked"), F.count_if(T.is_stub_content("text")).alias("content_stub"), F.count_if(~T.is_stub_content("text", items=items) & (F.coalesce(items, F.lit("")) != "")).alias("with_items"))


LEAK_TEXT = "CASE item_id % 4 WHEN 0 THEN text || ' see eccn 3a001.b and 5.D.2' WHEN 1 THEN text || ' 3 A 1 or 7e104' WHEN 2 THEN 'Item ' || (item_id % 10) || 'B' || lpad(CAST(item_id AS VARCHAR), 3, '0') ELSE text END"


@query(f"""WITH x AS (SELECT item_id, {LEAK_TEXT} AS q, ['ECCN-3A001', '3.A.1', 'ECCN-' || (item_id % 10) || 'B' || lpad(CAST(item_id AS VARCHAR), 3, '0')] AS codes FROM benchmark),
y AS (SELECT item_id, q, list_filter(codes, lambda c: contains(lower(q), lower(c)) OR contains(lower(q), lower(replace(c, 'ECCN-', ''))) OR contains(lower(q), lower(replace(replace(c, 'ECCN-', ''), '.', ' '))) OR contains(lower(q), lower(replace(c, '-', ' ')))) AS named, regexp_extract(q, '{CODE}') AS shaped FROM x)
SELECT item_id, array_to_string(list_concat(list_transform(named, lambda c: 'label:' || c), CASE WHEN shaped <> '' THEN ['control_code_re:' || shaped] ELSE [] END), ';') AS hits,
array_to_string(list_filter(['(?i)\\beccn\\b', '\\d\\.[A-E]\\.\\d', '(?i)item'], lambda p: regexp_matches(q, p)), ';') AS patterns FROM y""")
def p20_p21_leak_hits(spark, d):
    i = F.col("item_id")
    named = F.concat((i % 10).cast("string"), F.lit("B"), F.lpad(i.cast("string"), 3, "0"))
    q = F.when(i % 4 == 0, F.concat("text", F.lit(" see eccn 3a001.b and 5.D.2"))).when(i % 4 == 1, F.concat("text", F.lit(" 3 A 1 or 7e104"))).when(i % 4 == 2, F.concat(F.lit("Item "), named)).otherwise(F.col("text"))
    b = table(spark, d, "benchmark").select("item_id", q.alias("q"), F.array(F.lit("ECCN-3A001"), F.lit("3.A.1"), F.concat(F.lit("ECCN-"), named)).alias("codes"))
    return b.select("item_id", F.array_join(T.leak_hits("q", F.col("codes")), ";").alias("hits"), F.array_join(T.pattern_hits("q", [r"(?i)\beccn\b", r"\d\.[A-E]\.\d", "(?i)item"]), ";").alias("patterns"))


@query("""SELECT vec_id, array_to_string(list_transform(embedding[1:8], lambda x: CAST(round(CAST(x AS DOUBLE), 4) * 10000 AS INTEGER)), ',') AS rounded, CASE vec_id % 5 WHEN 0 THEN 'BM25' WHEN 1 THEN 'dense' WHEN 2 THEN 'hybrid_0.3' WHEN 3 THEN 'hybrid_0.5' ELSE 'hybrid_0.7' END AS name FROM embeddings""")
def p31_p33_rounding_and_names(spark, d):
    alpha = F.element_at(F.array(*map(F.lit, (1.0, 0.0, 0.3, 0.5, 0.7))), (F.col("vec_id") % 5 + 1).cast("int"))
    whole = F.transform(T.rounded(F.slice("embedding", 1, 8)), lambda x: F.round(x * 10000).cast("int").cast("string"))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(whole, ",").alias("rounded"), T.alpha_name(alpha).alias("name"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.a.b') AS missing, coalesce(json_extract_string(props, '$.k') = '7', false) AS found FROM events")
def p32_s9_paths_and_nodes(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", T.dig("props", "k").cast("long").alias("k"), T.dig("props", "a", "b").alias("missing"), P.has_node(F.col("props"), "k", "7").alias("found"))


@query(f"SELECT item_id AS query_id, md5(CASE WHEN item_id % 3 = 0 THEN {first('text')} ELSE text END) AS with_md5, md5(text) AS without_md5 FROM benchmark")
def p23_query_text(spark, d):
    b = table(spark, d, "benchmark").withColumn("en", F.when(F.col("item_id") % 3 == 0, T.first_sentence("text")).when(F.col("item_id") % 3 == 1, F.lit("  ")))
    return b.select(F.col("item_id").alias("query_id"), F.md5(T.query_text("text", "en", True)).alias("with_md5"), F.md5(T.query_text("text", "en", False)).alias("without_md5"))


# ---------------------------------------------------------------- labels


@query(f"WITH {CORPUS} SELECT code, arg_max(corpus_idx, corpus_idx) AS corpus_idx, arg_max(source, corpus_idx) AS source, count(*) AS n FROM c GROUP BY 1")
def j5_code_lookup(spark, d):
    return A.lookup(corpus(spark, d).select("code", "corpus_idx", "source")).select("code", "corpus_idx", "source", "n")


@query(f"WITH {CORPUS} SELECT count(*) AS n, count(*) FILTER (WHERE source = 'ecfr_part774') AS reachable, count(*) FILTER (WHERE source <> 'ecfr_part774') AS unreachable, round(count(*) FILTER (WHERE source <> 'ecfr_part774') / count(*), 4) AS share FROM c")
def a9_label_space(spark, d):
    return A.label_space(corpus(spark, d), "ecfr_part774")


@query(f"""WITH {CORPUS}, {MIXED}, {GOLD}, gc AS (SELECT DISTINCT query_id, m.code FROM gold JOIN m USING (corpus_idx)),
fl AS (SELECT query_id, bool_and(st) AS every, bool_or(st) AS sev FROM gc JOIN (SELECT code, {STUB} OR length(text) < 150 AS st FROM m) USING (code) GROUP BY 1), cd AS (SELECT code, bool_or(st) AS st FROM (SELECT DISTINCT code FROM gc) JOIN (SELECT code, {STUB} OR length(text) < 150 AS st FROM m) USING (code) GROUP BY 1)
SELECT (SELECT count(*) FROM m WHERE source = 'ecfr_part774') AS entries, (SELECT count(*) FROM m WHERE source = 'ecfr_part774' AND {STUB}) AS stubs, (SELECT count(*) FROM m WHERE source = 'ecfr_part774' AND length(text) < 150) AS short, (SELECT count(*) FROM fl) AS queries, (SELECT count(*) FROM fl WHERE every) AS all_gold_stub, (SELECT count(*) FROM fl WHERE sev) AS any_gold_stub, (SELECT count(*) FROM cd) AS gold_codes, (SELECT count(*) FROM cd WHERE st) AS gold_stub_codes""")
def a11_stub_audit(spark, d):
    m = _mixed(spark, d)
    gold = _gold(spark, d).join(m.select("corpus_idx", "code"), "corpus_idx").select("query_id", "code").distinct()
    return A.stub_audit(m, gold, "ecfr_part774")


@query(f"""WITH {CORPUS}, {GOLD_CODES}, df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT corpus_idx, {NORM} AS term FROM (SELECT corpus_idx, unnest({tok('text')}) AS w FROM c)) GROUP BY 1),
hv AS (SELECT DISTINCT query_id, {NORM} AS term FROM (SELECT query_id, unnest({tok('text')}) AS w FROM gc JOIN c USING (code))),
tr AS (SELECT item_id AS query_id, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS term FROM (SELECT item_id, list_sort(list_distinct(list_transform(list_filter({tok('text')}, lambda w: length(w) >= 4 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ('that', 'this', 'with', 'from')), lambda w: {NORM}))) AS l FROM benchmark)),
x AS (SELECT tr.query_id, tr.term, hv.term IS NOT NULL AS have, df FROM tr LEFT JOIN hv USING (query_id, term) LEFT JOIN df ON df.term = tr.term),
y AS (SELECT query_id, count(term) AS n_terms, count(*) FILTER (WHERE have) AS n_present, coalesce(string_agg(term, ',' ORDER BY term) FILTER (WHERE term IS NOT NULL AND NOT have AND df BETWEEN 1 AND 20), '') AS rare_missing FROM x GROUP BY 1)
SELECT query_id, n_terms, n_present, CASE WHEN n_terms > 0 THEN round(n_present / n_terms, 3) END AS coverage, coalesce(n_terms > 0 AND n_present / n_terms < 0.25, false) AS warn, rare_missing FROM y""")
def a12_term_coverage(spark, d):
    return A.term_coverage(_benchmark(spark, d).withColumn("lang", F.lit("en")), _gold_codes(spark, d), corpus(spark, d), GENERIC)


@query(f"""WITH {CORPUS}, x AS (SELECT DISTINCT code, regexp_extract(code, '^ECCN-(\\d)([A-EY])0(\\d{{2}})$', 1) AS a, regexp_extract(code, '^ECCN-(\\d)([A-EY])0(\\d{{2}})$', 2) AS t, regexp_extract(code, '^ECCN-(\\d)([A-EY])0(\\d{{2}})$', 3) AS n FROM c WHERE regexp_matches(code, '^ECCN-(\\d)([A-EY])0(\\d{{2}})$')),
y AS (SELECT code, a || '.' || t || '.' || CAST(n AS INTEGER) AS counterpart, 'wassenaar_2025' AS source FROM x UNION ALL SELECT code, '8' || t || a || n, 'india_scomet_2024' FROM x)
SELECT y.* FROM y SEMI JOIN c ON c.code = y.counterpart AND c.source = y.source""")
def p28_structural_codes(spark, d):
    c = corpus(spark, d)
    return A.structural_codes(c.select("code"), c)


@query(f"""WITH {CORPUS}, g AS (SELECT DISTINCT code || '.z' AS code, code || '.z' AS p, 4 AS depth FROM c WHERE source = 'wassenaar_2025' AND corpus_idx % 7 = 2), pr AS (SELECT DISTINCT code FROM c WHERE source = 'wassenaar_2025' AND corpus_idx % 7 <> 2),
cut AS (SELECT code, unnest(list_transform(range(1, len(string_split(code, '.')) + 1), lambda k: array_to_string(string_split(code, '.')[1:k], '.'))) AS p FROM g),
h AS (SELECT cut.code, pr.code AS successor, max(len(string_split(p, '.'))) AS depth FROM cut JOIN pr ON pr.code = p OR starts_with(pr.code, p || '.') GROUP BY 1, 2),
r AS (SELECT code, successor, row_number() OVER (PARTITION BY code ORDER BY successor) AS rank FROM h WHERE depth = (SELECT max(depth) FROM h z WHERE z.code = h.code))
SELECT code, successor, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def p29_successor_codes(spark, d):
    w = corpus(spark, d).filter("source = 'wassenaar_2025'")
    gone = w.filter("corpus_idx % 7 = 2").select(F.concat("code", F.lit(".z")).alias("code")).distinct()
    return A.successors(gone, w.filter("corpus_idx % 7 <> 2").select("code").distinct()).withColumn("rank", F.col("rank").cast("int"))


@query(f"""WITH {CORPUS}, a AS (SELECT corpus_idx AS left_id, list_distinct({tok(first('text'))}) AS s FROM c WHERE source = 'ecfr_part774'), b AS (SELECT corpus_idx AS right_id, list_distinct({tok(first('text'))}) AS s FROM c WHERE source <> 'ecfr_part774'),
x AS (SELECT left_id, right_id, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 9) AS jaccard FROM a JOIN b ON len(list_intersect(a.s, b.s)) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY jaccard DESC, right_id DESC) AS k FROM x WHERE jaccard >= 0.4)
SELECT left_id, right_id, jaccard FROM r WHERE k = 1""")
def j7_cross_source_twins(spark, d):
    c = corpus(spark, d).withColumn("toks", T.tokens(T.first_sentence("text")))
    own = F.col("source") == "ecfr_part774"
    return A.twins(c.filter(own).select(F.col("corpus_idx").alias("left_id"), "toks"), c.filter(~own).select(F.col("corpus_idx").alias("right_id"), "toks"), 0.4)


@query(f"""WITH {CORPUS}, {GOLD_CODES}, dr AS (SELECT query_id, min(code) AS code, 'imprecise' AS issue FROM gc GROUP BY 1), lk AS (SELECT code, arg_max(length(text), corpus_idx) AS n_chars FROM c GROUP BY 1),
kp AS (SELECT query_id, string_agg(code, ',' ORDER BY code) AS kept FROM (SELECT * FROM gc ANTI JOIN dr USING (query_id, code)) GROUP BY 1)
SELECT query_id, code, issue, CAST(n_chars AS BIGINT) AS n_chars, coalesce(kept, '') AS kept FROM dr LEFT JOIN lk USING (code) LEFT JOIN kp USING (query_id)""")
def g11_label_defects(spark, d):
    gold = _gold_codes(spark, d)
    drops = gold.groupBy("query_id").agg(F.min("code").alias("code")).withColumn("issue", F.lit("imprecise"))
    return A.label_defects(drops, gold, corpus(spark, d))


EDGES = "ed AS (SELECT 'c' || doc_id AS code, 'c' || (doc_id + 1) AS other, CASE WHEN quality = 1 THEN 'equivalent' ELSE 'broader' END AS relation, CASE doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence FROM labels UNION ALL SELECT 'c' || doc_id, 'c' || (doc_id + 2), 'broader', 'high' FROM labels WHERE toxic = 1)"


def _edges(spark, d) -> DataFrame:
    lab = table(spark, d, "labels")
    i = F.col("doc_id")
    name = lambda k: F.concat(F.lit("c"), (i + k).cast("string"))
    one = lab.select(name(0).alias("code"), name(1).alias("other"), F.when(F.col("quality") == 1, "equivalent").otherwise("broader").alias("relation"), F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), (i % 3 + 1).cast("int")).alias("confidence"))
    return one.union(lab.filter("toxic = 1").select(name(0), name(2), F.lit("broader"), F.lit("high")))


@query(f"""WITH {EDGES}, k AS (SELECT v.allow, e.code, e.other FROM ed e, (SELECT unnest([true, false]) AS allow) v WHERE (relation = 'equivalent' OR allow) AND confidence IN ('medium', 'high') UNION SELECT allow, code, code FROM ed, (SELECT unnest([true, false]) AS allow))
SELECT allow, code, string_agg(other, ',' ORDER BY other) AS labels FROM k GROUP BY 1, 2""")
def j9_t5_equivalent_labels(spark, d):
    e = _edges(spark, d)
    return A.equivalent_labels(e, True, "medium").select(F.lit(True).alias("allow"), "code", "labels").union(A.equivalent_labels(e, False, "medium").select(F.lit(False), "code", "labels"))


@query(f"WITH {EDGES} SELECT code, count(*) AS n, string_agg(other || ':' || relation || ':' || confidence, ',' ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, other, relation) AS doc FROM ed GROUP BY 1")
def g12_equivalence_doc(spark, d):
    x = A.equivalence_doc(_edges(spark, d))
    return x.select("code", F.size("equivalents").cast("long").alias("n"), F.array_join(F.transform("equivalents", lambda e: F.concat_ws(":", e["code"], e["relation"], e["confidence"])), ",").alias("doc"))


@query(f"""WITH {CORPUS}, {GOLD_CODES}, dr AS (SELECT query_id, max(code) AS code, 'imprecise' AS issue FROM gc GROUP BY 1 HAVING count(*) > 1), eq AS (SELECT code, min(code) || '+' AS labels FROM gc GROUP BY 1),
wh AS (SELECT code, bool_or(NOT (trim(text) = '' OR regexp_matches(trim(text), '{T.STUB_TEXT}')) AND NOT regexp_matches(code, '{T.CATEGORY_CODE}')) AS f FROM c GROUP BY 1), x AS (SELECT gc.query_id, gc.code, issue, labels, f FROM gc LEFT JOIN dr USING (query_id, code) LEFT JOIN eq USING (code) LEFT JOIN wh USING (code))
SELECT query_id, min(code) FILTER (WHERE issue IS NULL) AS primary_label, coalesce(string_agg(DISTINCT code, ',' ORDER BY code) FILTER (WHERE issue IS NULL), '') AS validated_labels, coalesce(string_agg(DISTINCT code || ':' || issue, ',' ORDER BY code || ':' || issue) FILTER (WHERE issue IS NOT NULL), '') AS removed_labels, coalesce(string_agg(DISTINCT labels, ',' ORDER BY labels) FILTER (WHERE issue IS NULL), '') AS equivalent_labels, bool_and(coalesce(f, false)) AS full_text FROM x GROUP BY 1""")
def g12_queries_v2(spark, d):
    gold = _gold_codes(spark, d)
    drops = gold.groupBy("query_id").agg(F.max("code").alias("code"), F.count("*").alias("n")).filter("n > 1").select("query_id", "code", F.lit("imprecise").alias("issue"))
    equivalents = gold.select("code").distinct().withColumn("labels", F.concat("code", F.lit("+")))
    return A.queries_v2(gold, drops, equivalents, corpus(spark, d))


@query("""WITH RECURSIVE r AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'a' ELSE 'b' END AS origin, item_id AS seq, ['k' || (item_id * 7 % 31), 'k' || (item_id * 11 % 37)] AS labels, row_number() OVER (ORDER BY CASE WHEN item_id % 3 = 0 THEN 'a' ELSE 'b' END, item_id) AS pos FROM benchmark),
g AS (SELECT 0::BIGINT AS pos, []::VARCHAR[] AS seen, false AS kept UNION ALL SELECT r.pos, CASE WHEN len(list_intersect(r.labels, g.seen)) = 0 THEN list_concat(g.seen, r.labels) ELSE g.seen END, len(list_intersect(r.labels, g.seen)) = 0 FROM g JOIN r ON r.pos = g.pos + 1)
SELECT r.origin, r.seq, r.item_id AS query_id FROM g JOIN r USING (pos) WHERE g.kept""")
def s17_merge_slices(spark, d):
    i = F.col("item_id")
    key = lambda a, b: F.concat(F.lit("k"), (i * a % b).cast("string"))
    rows = table(spark, d, "benchmark").select(F.when(i % 3 == 0, "a").otherwise("b").alias("origin"), i.alias("seq"), i.alias("query_id"), F.array(key(7, 31), key(11, 37)).alias("labels"))
    return A.merge_slices(rows)


@query(f"""WITH {CORPUS}, cu AS (SELECT item_id AS query_id, (SELECT min(code) FROM c) AS label FROM benchmark WHERE item_id % 2 = 0) SELECT query_id, label, md5(text) AS text_md5 FROM cu JOIN benchmark ON item_id = query_id""")
def g14_curated_set(spark, d):
    c = corpus(spark, d)
    curated = _benchmark(spark, d).filter("query_id % 2 = 0").select("query_id").join(F.broadcast(c.agg(F.min("code").alias("label"))))
    return A.curated_set(curated, _benchmark(spark, d), c).select("query_id", "label", F.md5("text").alias("text_md5"))


SLICE = f"""{CORPUS}, {GOLD}, gr AS (SELECT item_id AS query_id, CASE item_id % 6 WHEN 0 THEN 'fr' WHEN 1 THEN 'ko' ELSE 'en' END AS lang, CASE WHEN item_id % 9 = 4 THEN text || ' 3A001' WHEN item_id % 9 = 5 THEN ' ' ELSE text END AS text FROM benchmark), gc AS (SELECT DISTINCT query_id, code FROM gold JOIN c USING (corpus_idx)), one AS (SELECT DISTINCT code, source FROM c)"""


@query(f"""WITH {SLICE}, an AS (SELECT gr.query_id, gr.text, gc.code FROM gr JOIN gc USING (query_id)), fs AS (SELECT query_id, min(code) AS code FROM an GROUP BY 1)
SELECT 'schema' AS rule, CAST(query_id AS VARCHAR) AS key FROM gr WHERE trim(text) = ''
UNION ALL SELECT 'language', CAST(query_id AS VARCHAR) FROM gr WHERE lang NOT IN ('ko', 'en')
UNION ALL (SELECT DISTINCT 'label', CAST(query_id AS VARCHAR) FROM gc JOIN one USING (code) WHERE source <> 'ecfr_part774')
UNION ALL SELECT 'no_label', CAST(query_id AS VARCHAR) FROM gr ANTI JOIN gc USING (query_id)
UNION ALL (SELECT DISTINCT 'leak', CAST(query_id AS VARCHAR) FROM an WHERE regexp_matches(text, '{CODE}') OR contains(lower(text), lower(code)))
UNION ALL SELECT 'reused_code', code FROM gc GROUP BY code HAVING count(DISTINCT query_id) > 1""")
def g7_slice_failures(spark, d):
    i = F.col("query_id")
    rows = _benchmark(spark, d).select("query_id", F.when(i % 6 == 0, "fr").when(i % 6 == 1, "ko").otherwise("en").alias("lang"), F.when(i % 9 == 4, F.concat("text", F.lit(" 3A001"))).when(i % 9 == 5, " ").otherwise(F.col("text")).alias("text"))
    return A.slice_failures(rows, _gold_codes(spark, d), corpus(spark, d), "ecfr_part774", most_jaccard=1.01)


# ---------------------------------------------------------------- counts and reports


@query(f"""WITH {CORPUS}, x AS (SELECT *, list_filter([CASE WHEN length(text) < 40 THEN 'short_text' END, CASE WHEN regexp_matches(text, '(?i)^\\s*(?:or|and|&)\\b') THEN 'possible_fragment' END, CASE WHEN regexp_matches(text, '{CODE}') THEN 'contains_cross_reference' END, CASE WHEN {KEYS} THEN 'possible_national_core_technology_review' END], lambda z: z IS NOT NULL) AS flags FROM c)
SELECT 'route' AS kind, official_route AS name, count(*) AS n, array_to_string(list(corpus_idx ORDER BY corpus_idx)[1:50], ',') AS examples FROM x GROUP BY 2
UNION ALL SELECT 'source', source, count(*), array_to_string(list(corpus_idx ORDER BY corpus_idx)[1:50], ',') FROM x GROUP BY 2
UNION ALL SELECT 'flag', f, count(*), array_to_string(list(corpus_idx ORDER BY corpus_idx)[1:50], ',') FROM (SELECT corpus_idx, unnest(flags) AS f FROM x) GROUP BY 2""")
def a15_a22_counts_with_examples(spark, d):
    c = corpus(spark, d).select("corpus_idx", "official_route", "source", T.quality_flags("text").alias("flags"))
    kinds = F.concat(F.array(F.struct(F.lit("route").alias("kind"), F.col("official_route").alias("name")), F.struct(F.lit("source").alias("kind"), F.col("source").alias("name"))), F.transform("flags", lambda f: F.struct(F.lit("flag").alias("kind"), f.alias("name"))))
    return C.counts_with_examples(c.select("corpus_idx", F.explode(kinds).alias("k")).select("corpus_idx", "k.*"), ["kind", "name"], "corpus_idx", 50)


# ---------------------------------------------------------------- spans and ladders

LEXICON = {"licence": ["rights reserved", "license", "licence"], "contact": ["token", "phone", "email"], "place": ["street", "avenue"]}


@query(None)
def d1_d3_spans(spark, d):
    """Spans of every text; a test compares them with a character-by-character version."""
    return D.measure(table(spark, d, "documents"), "doc_id", "text", LEXICON, ["licence", "contact", D.NUMBERS])


COMMON = {"english": ["the", "and"], "french": ["dans", "les"], "german": ["der", "und"]}


def _has(*words: str) -> str:
    return f"regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(words)})($|[^\\p{{L}}\\p{{N}}_])')"


@query(f"""WITH x AS (SELECT turn, unnest(list_filter([{', '.join(f"CASE WHEN {_has(*w)} THEN '{c}' END" for c, w in COMMON.items())}, CASE WHEN regexp_matches(text, '[0-9]') THEN 'quantitative_spec' END], lambda z: z IS NOT NULL)) AS category FROM conversations WHERE turn < 5)
SELECT turn, category, count(*) AS n FROM x GROUP BY 1, 2""")
def a13_field_frequency(spark, d):
    c = table(spark, d, "conversations")
    return D.field_frequency(c.filter("turn < 5"), "turn", D.annotate(F.col("text"), COMMON))


@query(f"""WITH w AS (SELECT conv_id, turn, unnest({tok('text')}) AS surface FROM conversations WHERE turn < 2), x AS (SELECT conv_id, surface FROM w WHERE turn = 0 EXCEPT ALL SELECT conv_id, surface FROM w WHERE turn = 1) SELECT conv_id, surface, count(*) AS n FROM x GROUP BY 1, 2""")
def t2_d5_removed_words(spark, d):
    """What the second turn no longer has of the first, repeats counted."""
    w = table(spark, d, "conversations").filter("turn < 2").select("conv_id", "turn", F.explode(T.tokens("text")).alias("surface"))
    part = lambda k: w.filter(f"turn = {k}").select("conv_id", "surface")
    return D.removed(part(0), part(1)).groupBy("conv_id", "surface").agg(F.count("*").alias("n"))


@query("SELECT doc_id, regexp_matches(text, '[가-힣]') AS hangul, CAST(printf('%.5e', n_chars / 7.0) AS DOUBLE) AS six, CAST(printf('%.2e', n_chars * 1e-9 / 3) AS DOUBLE) AS three FROM documents")
def p27_p30_hangul_and_figures(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", T.has_hangul("text").alias("hangul"), T.significant(n / F.lit(7.0)).alias("six"), T.significant(n * F.lit(1e-9) / 3, 3).alias("three"))


WORDS = ["control", "design", "test", "tion"]
LAD = "ld AS (SELECT conv_id AS query_id, turn AS level, text, len(regexp_extract_all(text, '[0-9]+')) AS tokens, CAST(contains(lower(text), 'e') AS INTEGER) AS fields FROM conversations WHERE turn < 5)"


def _ladder(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").filter("turn < 5")
    return c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("level"), "text", F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("tokens"), F.contains(F.lower("text"), F.lit("e")).cast("int").alias("fields"))


@query("SELECT conv_id AS query_id, turn AS level, CASE WHEN turn < 4 OR contains(lower(text), 'control') OR contains(lower(text), 'design') OR contains(lower(text), 'test') OR contains(lower(text), 'tion') THEN 'function,item_category' ELSE 'item_category' END AS fields FROM conversations WHERE turn < 5")
def d4_residual_fields(spark, d):
    c = _ladder(spark, d)
    return c.select("query_id", "level", F.array_join(A.residual_fields(F.concat(F.lit("L"), F.col("level").cast("string")), F.col("text"), WORDS), ",").alias("fields"))


@query(f"""WITH {LAD}, x AS (SELECT *, lag(tokens) OVER w AS pt, lag(fields) OVER w AS pf FROM ld WINDOW w AS (PARTITION BY query_id ORDER BY level)),
y AS (SELECT query_id, unnest(list_filter([CASE WHEN tokens > pt THEN 'tokens_rise@L' || level END, CASE WHEN fields > pf THEN 'fields_rise@L' || level END, CASE WHEN level >= 1 AND regexp_matches(text, '[0-9]') THEN 'digits@L' || level END, CASE WHEN level >= 3 AND tokens > 0 THEN 'counted@L' || level END, CASE WHEN level = 4 AND len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) NOT BETWEEN 2 AND 5 THEN 'words@L' || level END, CASE WHEN regexp_matches(text, '{CODE}') THEN 'code@L' || level END], lambda v: v IS NOT NULL)) AS v FROM x)
SELECT i.query_id, coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM y WHERE y.query_id = i.query_id), '') AS violations, NOT EXISTS (SELECT 1 FROM y WHERE y.query_id = i.query_id) AS compliant FROM (SELECT DISTINCT query_id FROM ld) i""")
def d7_ladder_violations(spark, d):
    v = A.ladder_violations(_ladder(spark, d), "(?i)" + T.CONTROL_CODE)
    return v.select("query_id", F.array_join("violations", ",").alias("violations"), "compliant")


@query("""WITH t AS (SELECT conv_id AS query_id, list(text ORDER BY turn) AS l, count(*) AS n FROM conversations GROUP BY 1), x AS (SELECT query_id, CASE WHEN query_id % 7 = 0 THEN 'changed' ELSE l[1] END AS q, l, n FROM t)
SELECT query_id, CASE WHEN query_id % 5 = 0 THEN 'fixed' WHEN n = 4 AND trim(l[1]) = trim(q) AND len(list_filter(l, lambda z: trim(z) = '')) = 0 THEN 'carried' ELSE 'none' END AS origin,
CASE WHEN query_id % 5 = 0 THEN 'fixed' WHEN n = 4 AND trim(l[1]) = trim(q) AND len(list_filter(l, lambda z: trim(z) = '')) = 0 THEN md5(array_to_string(l[2:], '|')) END AS digest FROM x""")
def d6_ladder_sources(spark, d):
    c = table(spark, d, "conversations")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    carried = c.groupBy(F.col("conv_id").alias("query_id")).agg(texts.alias("texts"))
    i = F.col("query_id")
    queries = carried.select("query_id", F.when(i % 7 == 0, "changed").otherwise(F.get("texts", F.lit(0))).alias("text"))
    fixed = queries.filter(i % 5 == 0).select("query_id", F.array(F.lit("fixed")).alias("texts"))
    out = A.ladder_source(queries, fixed, carried, levels=4)
    return out.select("query_id", "origin", F.when(F.col("origin") == "fixed", "fixed").otherwise(F.md5(F.array_join("texts", "|"))).alias("digest"))


# ---------------------------------------------------------------- parsers
# A page of a book is a document; every seventh line begins with a code printed apart, some lines are headers or notes.

PAGES = """pg AS (SELECT doc_id, source AS book, doc_id AS page, list_filter(string_split(regexp_replace(text, '([.;:,]) ', '\\1' || chr(10), 'g'), chr(10)), lambda z: true) AS l FROM documents),
ln AS (SELECT book, page, unnest(l) AS t0, generate_subscripts(l, 1) AS k FROM pg)"""


def _pages(spark, d, header: str, entry) -> DataFrame:
    """(book, page, text): lines of the documents, some made into headers, entries, notes and boundaries."""
    lines = F.split(F.regexp_replace("text", "([.;:,]) ", "$1\n"), "\n")
    made = F.transform(lines, lambda t, k: entry(t, k, F.col("doc_id")))
    head = F.when(F.col("doc_id") % 5 == 0, F.lit("PREFACE")).otherwise(F.lit(header))
    return table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.concat(head, F.lit("\n"), F.array_join(made, "\n")).alias("text"))


def _dual_use_line(t, k, doc):
    n = k + doc
    code = F.concat((n % 10).cast("string"), F.lit(". "), F.substring(F.lit("ABCDE"), (n % 5 + 1).cast("int"), F.lit(1)), F.lit(". "), (n % 40).cast("string"), F.lit(". "), F.when(n % 2 == 0, F.lit("a. ")).otherwise(F.lit("")), F.when(n % 6 == 0, F.lit("3. b. ")).otherwise(F.lit("")))
    return F.when(n % 7 == 0, F.concat(code, t)).when(n % 31 == 1, F.lit("* a note")).when(n % 37 == 2, F.lit("ANNEX one")).when(n % 11 == 3, F.lit("WA-LIST (25) 1")).when(n % 13 == 4, F.concat(F.lit("x"), t, F.lit(".*"))).otherwise(t)


SQL_LINES = f"""{PAGES}, l2 AS (SELECT book, page, k, k - 1 + page AS n, t0 FROM ln),
l3 AS (SELECT book, page, k, CASE WHEN n % 7 = 0 THEN (n % 10) || '. ' || substr('ABCDE', CAST(n % 5 + 1 AS INTEGER), 1) || '. ' || (n % 40) || '. ' || CASE WHEN n % 2 = 0 THEN 'a. ' ELSE '' END || CASE WHEN n % 6 = 0 THEN '3. b. ' ELSE '' END || t0 WHEN n % 31 = 1 THEN '* a note' WHEN n % 37 = 2 THEN 'ANNEX one' WHEN n % 11 = 3 THEN 'WA-LIST (25) 1' WHEN n % 13 = 4 THEN 'x' || t0 || '.*' ELSE t0 END AS raw FROM l2),
l4 AS (SELECT book, page, 0 AS k, CASE WHEN page % 5 = 0 THEN 'PREFACE' ELSE 'DUAL-USE LIST' END AS raw FROM (SELECT DISTINCT book, page FROM ln) UNION ALL SELECT book, page, k, unnest(string_split(raw, chr(10))) FROM l3),
l5 AS (SELECT book, page, k, trim(raw) AS t, page % 5 <> 0 AS inside, min(CASE WHEN regexp_matches(trim(raw), '{P.FOOTNOTE}') THEN k END) OVER (PARTITION BY book, page) AS note FROM l4),
l6 AS (SELECT *, NOT inside OR regexp_matches(t, '{P.ANNEX}') AS stop FROM l5 WHERE (inside AND (note IS NULL OR k < note)) OR (NOT inside AND k = 0)),
l7 AS (SELECT *, trim(regexp_replace(t, '([.\\w])\\*\\s*$', '\\1')) AS line FROM l6 WHERE stop OR (t <> '' AND NOT regexp_matches(t, '{P.RULE}') AND NOT regexp_matches(t, '{P.FOOTER}') AND NOT regexp_matches(t, '{P.SECTION_HEADER}') AND NOT regexp_matches(t, '{P.FOOTNOTE}'))),
l8 AS (SELECT *, NOT stop AND regexp_matches(line, '{P.ENTRY}') AS shaped, list_filter(list_transform([1, 2, 3, 4, 5, 6, 7], lambda g: CASE g WHEN 1 THEN regexp_extract(line, '{P.ENTRY}', 1) WHEN 2 THEN regexp_extract(line, '{P.ENTRY}', 2) WHEN 3 THEN regexp_extract(line, '{P.ENTRY}', 3) WHEN 4 THEN regexp_extract(line, '{P.ENTRY}', 4) WHEN 5 THEN regexp_extract(line, '{P.ENTRY}', 5) WHEN 6 THEN regexp_extract(line, '{P.ENTRY}', 6) ELSE regexp_extract(line, '{P.ENTRY}', 7) END), lambda z: z <> '') AS p, regexp_extract(line, '{P.ENTRY}', 8) AS body FROM l7 WHERE stop OR line <> ''),
l9 AS (SELECT *, shaped AND regexp_matches(array_to_string(p, '.'), '{T.CODE_GRAMMAR["wassenaar_2025"]}') AS sound, shaped AND len(p) >= 4 AND length(p[-1]) = 1 AND regexp_matches(array_to_string(p[:-2], '.'), '{T.CODE_GRAMMAR["wassenaar_2025"]}') AS mend FROM l8),
la AS (SELECT *, CASE WHEN sound THEN array_to_string(p, '.') WHEN mend THEN array_to_string(p[:-2], '.') END AS code, CASE WHEN sound THEN trim(body) WHEN mend THEN trim(p[-1] || ' ' || trim(body)) ELSE line END AS text FROM l9),
lb AS (SELECT *, sum(CASE WHEN stop OR code IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY page, k ROWS UNBOUNDED PRECEDING) AS grp FROM la),
en AS (SELECT book, grp, max(code) AS code, trim(regexp_replace(string_agg(text, ' ' ORDER BY page, k), '\\s+', ' ', 'g')) AS text, count(DISTINCT page) AS pages, list_distinct(list_concat(CASE WHEN bool_or(NOT sound AND mend) THEN ['code_repaired'] ELSE [] END, CASE WHEN bool_or(t <> line) THEN ['footnote_marker_stripped'] ELSE [] END, CASE WHEN count(DISTINCT page) > 1 THEN ['page_continuation'] ELSE [] END)) AS flags FROM lb WHERE NOT stop GROUP BY 1, 2 HAVING max(code) IS NOT NULL),
fi AS (SELECT *, row_number() OVER (PARTITION BY book, code ORDER BY length(text) DESC, grp) AS pick, count(*) OVER (PARTITION BY book, code) AS c FROM en WHERE length(text) >= 10 OR regexp_matches(text, '{T.STUB_TEXT}') OR trim(text) = ''),
fa AS (SELECT book, code, list_distinct(flatten(list(flags))) AS f FROM fi GROUP BY 1, 2)"""


@query(f"""WITH {SQL_LINES} SELECT book, code, md5(text) AS text_md5, CAST(pages AS BIGINT) AS n_pages, array_to_string(list_sort(list_distinct(list_concat(f, CASE WHEN c > 1 THEN ['duplicate_occurrences'] ELSE [] END, CASE WHEN NOT regexp_matches(text, '{P.TERMINATOR.replace("'", "''")}') THEN ['unterminated_text'] ELSE [] END, CASE WHEN pages > 3 THEN ['spans_many_pages'] ELSE [] END))), ',') AS flags,
CASE WHEN trim(text) = '' OR regexp_matches(trim(text), '{T.STUB_TEXT}') THEN 'stub' WHEN regexp_matches(code, '{T.CATEGORY_CODE}') THEN 'heading_only' ELSE 'full' END AS completeness, c - 1 AS duplicates FROM fi JOIN fa USING (book, code) WHERE pick = 1""")
def s6_p15_p16_dual_use_parser(spark, d):
    e = P.parse_dual_use(_pages(spark, d, "DUAL-USE LIST", _dual_use_line))
    return e.select("book", "code", F.md5("text").alias("text_md5"), F.size("pages").cast("long").alias("n_pages"), F.array_join("parse_flags", ",").alias("flags"), F.col("text_completeness").alias("completeness"), F.col("duplicate_occurrences").alias("duplicates"))


def _list_line(t, k, doc):
    n = k + doc
    code = F.concat((n % 10).cast("string"), F.substring(F.lit("ABCDE"), (n % 5 + 1).cast("int"), F.lit(1)), F.lpad((n % 7).cast("string"), 3, "3"), F.lit(" "))
    return F.when((n % 7 == 0) | (n % 7 == 1), F.concat(F.when(n % 7 == 1, F.lit("8A301 ")).otherwise(code), t)).when(n % 31 == 3, F.lit("8A3 ELECTRONICS")).when(n % 11 == 3, F.lit("Item column")).otherwise(t)


@query(None)
def s7_list_parser(spark, d):
    """The list parser over the documents as pages; a test compares it with a line-by-line version."""
    head = lambda t, k, doc: F.when((k == 0) & (doc % 50 == 49), F.lit("ANNEXURE - I")).otherwise(_list_line(t, k, doc))
    e = P.parse_list(_pages(spark, d, "Appendix 3 - SCOMET List", head))
    return e.select("book", "code", F.md5("text").alias("text_md5"), F.size("pages").cast("long").alias("n_pages"), F.array_join("parse_flags", ",").alias("flags"), F.col("text_completeness").alias("completeness"), F.col("duplicate_occurrences").alias("duplicates"))


XTEXT = "trim(regexp_replace(regexp_replace(text, '[<>&]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH x AS (SELECT doc_id, {XTEXT} AS t, {first('text')} AS f FROM documents WHERE doc_id % 2 = 0), y AS (SELECT doc_id, t, trim(regexp_replace(regexp_replace(f, '[<>&]', ' ', 'g'), '\\s+', ' ', 'g')) AS f FROM x)
SELECT doc_id, 'ECCN-' || (doc_id % 10) || 'A' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS code, 'Things' AS category_title, 'A' AS product_group, md5(f) AS heading_md5, md5(CASE WHEN doc_id % 4 = 0 THEN trim('a. ' || t) ELSE trim('b. ' || t) END) AS items_md5, CASE WHEN doc_id % 4 = 0 THEN 'items_marker' ELSE 'loic_body_fallback' END AS items_source, 'NS, AT' AS reason_for_control, 'one | two' AS license, false AS heading_only, md5(trim(f || ' ' || CASE WHEN doc_id % 4 = 0 THEN 'a. ' || t ELSE 'b. ' || t END)) AS text_md5 FROM y""")
def s10_s13_xml_appendix(spark, d):
    """Every second document as an appendix of one entry, built as XML and parsed back."""
    i = F.col("doc_id")
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "[<>&]", " "), r"\s+", " "))
    code = F.concat((i % 10).cast("string"), F.lit("A"), F.lpad((i % 1000).cast("string"), 3, "0"))
    items = F.when(i % 4 == 0, F.concat(F.lit("<FP><I>Items:</I> a. "), plain(F.col("text")), F.lit("</FP>"))).otherwise(F.concat(F.lit("<P>b. "), plain(F.col("text")), F.lit("</P>")))
    xml = F.concat(F.lit("<DIV9><HEAD>x</HEAD><HD1>Category 3—Things</HD1><HD1>A. Parts</HD1><FP-2><B>"), code, F.lit(" "), plain(T.first_sentence("text")), F.lit("</B></FP-2><FP-1><E>License Requirements</E></FP-1><FP-1><I>Reason for Control:</I> NS, AT</FP-1><DIV><TABLE><TR><TD>one</TD><TD>two</TD></TR></TABLE></DIV><FP-1><E>List of Items Controlled (x)</E></FP-1><FP-1><I>Related Controls:</I> none</FP-1>"), items, F.lit("</DIV9>"))
    e = P.appendix_entries(table(spark, d, "documents").filter("doc_id % 2 = 0").select("doc_id", xml.alias("xml")), "xml", "doc_id")
    licence = F.trim(F.replace(e["sections"]["License Requirements"], F.lit("Reason for Control: NS, AT"), F.lit("")))
    return e.select("doc_id", "code", "category_title", "product_group", F.md5("heading").alias("heading_md5"), F.md5("items").alias("items_md5"), "items_source", "reason_for_control", licence.alias("license"), "heading_only", F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------- sources


@query(f"WITH {CORPUS} SELECT source, code, corpus_idx, md5(text) AS text_md5 FROM c")
def s16_merged_sources(spark, d):
    c = corpus(spark, d)
    parts = {s: c.filter(F.col("source") == s).drop("source") for s in T.CODE_GRAMMAR}
    return S.union_sources(parts).select("source", "code", "corpus_idx", F.md5("text").alias("text_md5"))


@query("SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(bit_xor(hash_n) AS BIGINT) AS digest FROM (SELECT lang, text, CAST('0x' || substr(md5(doc_id || ':' || text), 1, 8) AS BIGINT) AS hash_n FROM documents) GROUP BY 1")
def s23_describe_version(spark, d):
    """What a version manifest records of each part: rows, characters and a digest that no order changes."""
    return S.describe(table(spark, d, "documents"), "lang", "doc_id", "text")


@query("SELECT code, expected, actual, status FROM (SELECT source AS code, CASE WHEN source < 'src15' THEN 50.0::DOUBLE WHEN source < 'src3' THEN NULL ELSE 49.0::DOUBLE END AS expected, CAST(n AS DOUBLE) AS actual, CASE WHEN source < 'src15' THEN CASE WHEN abs(n - 50) <= 0.5 THEN 'OK' ELSE 'MISMATCH' END WHEN source < 'src3' THEN 'SKIP' ELSE CASE WHEN abs(n - 49) <= 0.5 THEN 'OK' ELSE 'MISMATCH' END END AS status FROM (SELECT source, count(*) AS n FROM documents WHERE source <> 'src7' GROUP BY 1)) UNION ALL SELECT 'src7', CASE WHEN 'src7' < 'src15' THEN 50.0::DOUBLE WHEN 'src7' < 'src3' THEN NULL ELSE 49.0::DOUBLE END, NULL, 'MISSING' UNION ALL SELECT 'extra', NULL, 1.0::DOUBLE, 'NEW'")
def g13_claims(spark, d):
    counts = table(spark, d, "documents").groupBy(F.col("source").alias("claim")).agg(F.count("*").cast("double").alias("value"))
    s = F.col("claim")
    expected = counts.select("claim").union(spark.createDataFrame([("src7",)], "claim string")).distinct().withColumn("value", F.when(s < "src15", 50.0).when(s < "src3", F.lit(None)).otherwise(49.0))
    actual = counts.filter(s != "src7").union(spark.createDataFrame([("extra", 1.0)], "claim string, value double"))
    return I.check_claims(expected, actual, 0.5).withColumnRenamed("claim", "code")
