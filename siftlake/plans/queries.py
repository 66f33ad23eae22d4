"""Queries over the test tables, one per operator or small family, each with its SQL for DuckDB.

Names begin with the operator's id.  All run over whole tables; the only
limits are top-k reports and sampling operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import corpus as C
from siftlake.operators import integrity as I
from siftlake.operators import lexical_index
from siftlake.operators import metrics as M
from siftlake.operators import resampling as RS
from siftlake.operators import retrieval as R
from siftlake.operators import stats as S
from siftlake.operators import suite as U
from siftlake.operators.blocks import Grid
from siftlake.operators.passages import held_passages
from siftlake.sources.store import kept, state_of
from siftlake.sources.tables import corpus, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- SQL pieces (DuckDB)


def tok(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '[A-Za-z0-9가-힣]+'), lambda w: lower(w))"


def col(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def first(x: str) -> str:
    p = f"string_split(regexp_replace({col(x)}, '([.;])\\s+', '\\1␞', 'g'), '␞')"
    return f"trim(substr(CASE WHEN length({p}[1]) < 80 AND len({p}) > 1 THEN {p}[1] || ' ' || {p}[2] ELSE {p}[1] END, 1, 260))"


CODE = "(?i)(?:" + T.CONTROL_CODE + ")"
CLEAN = f"regexp_replace({col('text')}, '\\s+([,.;:])', '\\1', 'g')"
CORPUS = """
c AS (SELECT doc_id AS corpus_idx, CASE doc_id % 3 WHEN 0 THEN 'ECCN-' || (doc_id % 10) || substr('ABCDE', CAST(doc_id % 5 + 1 AS INTEGER), 1) || lpad(CAST(doc_id % 400 AS VARCHAR), 3, '0')
  WHEN 1 THEN '8' || substr('ABCDE', CAST(doc_id % 5 + 1 AS INTEGER), 1) || (doc_id % 10) || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') ELSE (doc_id % 10) || '.' || substr('ABCDE', CAST(doc_id % 5 + 1 AS INTEGER), 1) || '.' || (doc_id % 100) END AS code, text,
  CASE doc_id % 3 WHEN 0 THEN 'ecfr_part774' WHEN 1 THEN 'india_scomet_2024' ELSE 'wassenaar_2025' END AS source, source AS control_system, lang AS official_route FROM documents)"""
BM25 = f"""
d AS (SELECT doc_id, {tok('text')} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT doc_id, tok, any_value(dl) AS dl, count(*) AS f FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS tok FROM d) GROUP BY 1, 2),
idf AS (SELECT tok, count(*) AS df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf, s GROUP BY 1),
q AS (SELECT item_id AS query_id, tok, count(*) AS m FROM (SELECT item_id, unnest({tok('text')}) AS tok FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT query_id, doc_id AS corpus_idx, round(sum(m * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM q JOIN idf USING (tok) JOIN tf USING (tok), s GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_idx) AS rank FROM sc)"""
GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id AS corpus_idx FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
DENSE = """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
dn AS (SELECT q.vec_id AS query_id, c.vec_id AS corpus_idx, round(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 9) AS score FROM v q, v c WHERE q.vec_id % 100 = 0)"""


def _benchmark(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark, d):
    docs = corpus(spark, d)
    index, q = R.bm25_index(docs), R.query_tokens(_benchmark(spark, d))
    return docs, index, q, R.bm25_scores(index, q)


def _gold(spark, d) -> DataFrame:
    """Documents that hold a benchmark passage word for word; looked for once."""
    state = state_of(spark, f"{d}/benchmark.parquet", f"{d}/documents.parquet")
    return kept(spark, "gold", state, lambda: held_passages(corpus(spark, d), _benchmark(spark, d).withColumnRenamed("text", "passage")))


def _grid(spark, d, index=None, asked=None) -> Grid:
    """Vectors whose id divides by 100 as queries against all."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("corpus_idx"), F.col("embedding").alias("v"), "label")
    q = v.filter("corpus_idx % 100 = 0").select(F.col("corpus_idx").alias("query_id"), F.col("v").alias("q"), "label")
    return Grid(v, q, index, asked)


# ---------------------------------------------------------------- projections and text


@query(f"SELECT doc_id, CAST(len({tok('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({tok('text')})) AS BIGINT) AS n_distinct, md5(array_to_string({tok('text')}, ' ')) AS tokens_md5 FROM documents")
def p1_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens("text")
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query(f"SELECT doc_id, {first('text')} AS first_sentence FROM documents")
def p2_first_sentence(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_sentence("text").alias("first_sentence"))


ROUTE = "control_system || ' | ' || official_route || ' | flags=none'"


@query(f"""WITH {CORPUS}, m AS (SELECT unnest(['full_text', 'minimal_text', 'minimal_no_code', 'route_only']) AS mode),
x AS (SELECT corpus_idx, mode, CASE mode WHEN 'full_text' THEN code || ' ' || text WHEN 'minimal_text' THEN code || ' ' || {first('text')} WHEN 'minimal_no_code' THEN {first('text')} ELSE {ROUTE} END AS t,
CASE mode WHEN 'full_text' THEN length(text) WHEN 'route_only' THEN length({ROUTE}) ELSE length({first('text')}) END AS legacy FROM c, m)
SELECT corpus_idx, mode, CAST(length(t) AS BIGINT) AS exposure, CAST(legacy AS BIGINT) AS legacy_exposure, md5(t) AS text_md5 FROM x""")
def p3_p8_index_and_returned_text(spark, d):
    c = corpus(spark, d).withColumn("flags", F.array().cast("array<string>")).withColumn("mode", F.explode(F.array(*map(F.lit, T.MODES))))
    m, route = F.col("mode"), T.route_text("control_system", "official_route", "flags")
    t = T.returned_text(m, route=route)
    return c.select("corpus_idx", "mode", F.length(t).cast("long").alias("exposure"), T.legacy_exposure_chars(m, route=route).cast("long").alias("legacy_exposure"), F.md5(t).alias("text_md5"))


KEYS = " OR ".join(f"contains(lower(text), '{k}')" for k in T.KEYWORDS)


STRIPPED = f"""trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{CODE}', ' ', 'g'), '(?i)\\b(?:ECCN|SCOMET|Wassenaar)\\b', ' ', 'g'), '\\s+', ' ', 'g'), ' ;,.-')"""


@query(f"""WITH x AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace({STRIPPED}, '(?i)\\([^)]*(?:see|controlled by|specified in)[^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents),
y AS (SELECT *, substr(t, 1, 360) AS cut, greatest(CASE WHEN contains(substr(t, 1, 360), '.') THEN least(360, length(t)) - strpos(reverse(substr(t, 1, 360)), '.') ELSE -1 END, CASE WHEN contains(substr(t, 1, 360), ';') THEN least(360, length(t)) - strpos(reverse(substr(t, 1, 360)), ';') ELSE -1 END, CASE WHEN contains(substr(t, 1, 360), ',') THEN least(360, length(t)) - strpos(reverse(substr(t, 1, 360)), ',') ELSE -1 END) AS e FROM x)
SELECT doc_id, CASE WHEN length(t) <= 360 THEN t WHEN e > 160 THEN trim(substr(cut, 1, e), ' ;,.') || '.' ELSE trim(cut, ' ;,.') || '...' END AS description FROM y""")
def p17_p18_description(spark, d):
    return table(spark, d, "documents").select("doc_id", T.compact_description("text").alias("description"))


@query(f"""WITH {CORPUS}, x AS (SELECT corpus_idx, code, CASE corpus_idx % 4 WHEN 0 THEN 'part ' || code || ' of it' WHEN 1 THEN 'see ' || replace(code, 'ECCN-', '') WHEN 2 THEN {first('text')} ELSE 'nothing here' END AS q FROM c)
SELECT corpus_idx, contains(lower(q), lower(code)) OR contains(lower(q), lower(replace(code, 'ECCN-', ''))) OR contains(lower(q), lower(replace(code, '-', ' '))) OR regexp_matches(q, '{CODE}') AS leak FROM x""")
def p19_p21_code_leak(spark, d):
    i = F.col("corpus_idx") % 4
    q = F.when(i == 0, F.concat(F.lit("part "), "code", F.lit(" of it"))).when(i == 1, F.concat(F.lit("see "), F.replace("code", F.lit("ECCN-"), F.lit("")))).when(i == 2, T.first_sentence("text")).otherwise("nothing here")
    return corpus(spark, d).withColumn("q", q).select("corpus_idx", T.code_leak("q", "code").alias("leak"))


@query(f"""WITH {CORPUS} SELECT regexp_replace(replace(replace(upper(trim(code)), 'ECCN-', ''), 'ECCN', ''), '[^A-Z0-9]', '', 'g') AS normal, count(*) AS n, count(DISTINCT source) AS n_sources, count(*) > 1 AS collision, min(corpus_idx) AS first_idx FROM c GROUP BY 1""")
def p22_j6_code_collisions(spark, d):
    c = corpus(spark, d).withColumn("normal", T.normalize_code("code"))
    return c.groupBy("normal").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), (F.count("*") > 1).alias("collision"), F.min("corpus_idx").alias("first_idx"))


NORM = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN regexp_replace(w, 'ies$', 'y') WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(?:ss|us|is|os)$') THEN regexp_replace(w, 's$', '') ELSE w END"


@query(f"SELECT tok, count(*) AS df FROM (SELECT DISTINCT doc_id, {NORM} AS tok FROM (SELECT doc_id, unnest({tok('text')}) AS w FROM documents)) GROUP BY 1")
def a8_p25_document_frequency(spark, d):
    t = table(spark, d, "documents").select(F.explode(F.array_distinct(F.transform(T.tokens("text"), T.singular))).alias("tok"))
    return t.groupBy("tok").agg(F.count("*").alias("df"))


@query(f"""WITH q AS (SELECT item_id, list_sort(list_distinct(list_transform(list_filter({tok('text')}, lambda w: length(w) >= CASE WHEN item_id % 2 = 0 THEN 4 ELSE 2 END AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ('that', 'this', 'with', 'from') AND (item_id % 2 = 0 OR regexp_matches(w, '^[a-z0-9]+$'))), lambda w: {NORM}))) AS terms FROM benchmark),
df AS (SELECT tok, count(*) AS df FROM (SELECT DISTINCT doc_id, {NORM} AS tok FROM (SELECT doc_id, unnest({tok('text')}) AS w FROM documents)) GROUP BY 1),
x AS (SELECT item_id, unnest(terms) AS tok FROM q)
SELECT item_id, count(*) AS n_terms, count(df.df) AS n_known, count(*) FILTER (WHERE df.df BETWEEN 1 AND 20) AS n_discriminative FROM x LEFT JOIN df USING (tok) GROUP BY 1""")
def p26_a12_item_terms(spark, d):
    """Every second query counts as Korean, where only Latin words are terms."""
    q = _benchmark(spark, d).withColumn("lang", F.when(F.col("query_id") % 2 == 0, "en").otherwise("ko")).select(F.col("query_id").alias("item_id"), F.explode(T.item_terms("text", "lang", ["that", "this", "with", "from"])).alias("tok"))
    return q.join(a8_p25_document_frequency(spark, d), "tok", "left").groupBy("item_id").agg(F.count("*").alias("n_terms"), F.count("df").alias("n_known"), F.count_if(F.col("df").between(1, 20)).alias("n_discriminative"))


# ---------------------------------------------------------------- retrieval


@query(f"WITH {BM25} SELECT tok, df, round(idf, 9) AS idf FROM idf")
def r1_bm25_index(spark, d):
    return R.bm25_index(corpus(spark, d)).idf.select("tok", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {BM25} SELECT query_id, count(idf.tok) AS known FROM q LEFT JOIN idf USING (tok) GROUP BY 1")
def r3_vocabulary_overlap(spark, d):
    _, index, q, _ = _bm25(spark, d)
    return R.vocabulary_overlap(index, q)


@query(f"WITH {BM25} SELECT query_id, corpus_idx, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 10")
def r7_bm25_topk(spark, d):
    return R.bm25_topk(corpus(spark, d), _benchmark(spark, d), 10).select("query_id", "corpus_idx", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(f"""WITH {BM25}, n AS (SELECT query_id, max(score) AS hi, CASE WHEN count(*) < any_value(s.n) THEN least(0, min(score)) ELSE min(score) END AS lo FROM sc, s GROUP BY 1)
SELECT query_id, corpus_idx, round(CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (score - lo) / (hi - lo) END, 6) AS unit FROM sc JOIN n USING (query_id)""")
def r8_minmax(spark, d):
    docs = corpus(spark, d)
    units = lexical_index.minmax_scores(R.bm25_index(docs), R.query_tokens(_benchmark(spark, d)), docs.count())
    return units.select("query_id", "corpus_idx", F.round("unit", 6).alias("unit"))


@query(f"WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_idx) AS rank FROM dn) SELECT query_id, corpus_idx, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def r12_dense_topk(spark, d):
    v = table(spark, d, "embeddings")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    best = R.dense_topk(q, v.select(F.col("vec_id").alias("corpus_idx"), F.col("embedding").alias("v")), 10)
    return best.select("query_id", "corpus_idx", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


HYBRID = f"""{DENSE}, qd AS (SELECT doc_id AS query_id, {first('text')} AS text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0)),
d AS (SELECT doc_id, {tok('text')} AS t FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT doc_id, tok, any_value(dl) AS dl, count(*) AS f FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS tok FROM d) GROUP BY 1, 2),
idf AS (SELECT tok, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf, s GROUP BY 1),
q AS (SELECT query_id, tok, count(*) AS m FROM (SELECT query_id, unnest({tok('text')}) AS tok FROM qd) GROUP BY 1, 2),
sc AS (SELECT query_id, doc_id AS corpus_idx, round(sum(m * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM q JOIN idf USING (tok) JOIN tf USING (tok), s GROUP BY 1, 2),
bn AS (SELECT query_id, max(score) AS hi, CASE WHEN count(*) < any_value(s.n) THEN least(0, min(score)) ELSE min(score) END AS lo FROM sc, s GROUP BY 1),
bu AS (SELECT query_id, corpus_idx, CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (score - lo) / (hi - lo) END AS unit FROM sc JOIN bn USING (query_id)),
dr AS (SELECT query_id, max(score) AS hi, min(score) AS lo FROM dn GROUP BY 1),
du AS (SELECT query_id, corpus_idx, CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (score - lo) / (hi - lo) END AS unit FROM dn JOIN dr USING (query_id)),
g AS (SELECT alpha, du.query_id, du.corpus_idx, round(alpha * coalesce(bu.unit, 0) + (1 - alpha) * du.unit, 9) AS score FROM du LEFT JOIN bu USING (query_id, corpus_idx), (SELECT unnest([1.0, 0.7, 0.5, 0.3, 0.0]::DOUBLE[]) AS alpha)),
hr AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, corpus_idx) AS rank FROM g),
hits AS (SELECT h.alpha, h.query_id, max(CASE WHEN h.rank <= 10 AND a.label = b.label AND a.vec_id <> b.vec_id THEN 1 ELSE 0 END) AS hit FROM hr h JOIN v a ON a.vec_id = h.query_id JOIN v b ON b.vec_id = h.corpus_idx WHERE h.rank <= 10 GROUP BY 1, 2)"""


ALPHAS = [1.0, 0.7, 0.5, 0.3, 0.0]


def _both(spark, d) -> Grid:
    """Documents that have a vector, with their index; queries: those whose id divides by 100."""
    v = table(spark, d, "embeddings")
    docs = corpus(spark, d).join(v.select(F.col("vec_id").alias("corpus_idx")), "corpus_idx", "left_semi")
    q = docs.filter("corpus_idx % 100 = 0").select(F.col("corpus_idx").alias("query_id"), T.first_sentence("text").alias("text"))
    return _grid(spark, d, R.bm25_index(docs), R.query_tokens(q))


def _hybrid(spark, d) -> DataFrame:
    """(alpha, query_id, corpus_idx, score, rank): ten of each blend and query; ranked once."""
    state = state_of(spark, f"{d}/embeddings.parquet", f"{d}/documents.parquet")
    return kept(spark, "hybrid", state, lambda: _both(spark, d).blended_topk(ALPHAS, 10).drop("view"))


def _hits(spark, d) -> DataFrame:
    """(alpha, query_id, hit): whether another vector of the query's label is among its ten best."""
    v = table(spark, d, "embeddings")
    a, b = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("la")), v.select(F.col("vec_id").alias("corpus_idx"), F.col("label").alias("lb"))
    return _hybrid(spark, d).join(a, "query_id").join(b, "corpus_idx").groupBy("alpha", "query_id").agg(F.max(((F.col("la") == F.col("lb")) & (F.col("query_id") != F.col("corpus_idx"))).cast("int")).alias("hit"))


@query(f"WITH {HYBRID} SELECT alpha, query_id, corpus_idx, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hr WHERE rank <= 10")
def r9_r13_hybrid_topk(spark, d):
    return _hybrid(spark, d).select("alpha", "query_id", "corpus_idx", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("WITH d AS (SELECT item_id AS query_id, CAST('0x' || substr(md5('s:' || item_id || ':' || j), 1, 8) AS BIGINT) % (SELECT count(*) FROM documents) AS corpus_idx, min(j) AS j FROM benchmark, range(30) r(j) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY j) AS rank FROM d) SELECT query_id, corpus_idx, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def r14_random_baseline(spark, d):
    """Ten documents a query, drawn by position (ids run from 0 without gaps)."""
    return R.sampled(_benchmark(spark, d), corpus(spark, d).count(), 10).select("query_id", "corpus_idx", F.col("rank").cast("int").alias("rank"))


# ---------------------------------------------------------------- metrics


@query(f"""WITH {BM25}, {GOLD}, h AS (SELECT b.item_id AS query_id, r.hit_rank FROM benchmark b LEFT JOIN (SELECT query_id, min(rank) AS hit_rank FROM rk JOIN gold USING (query_id, corpus_idx) WHERE rank <= 100 GROUP BY 1) r ON r.query_id = b.item_id)
SELECT count(*) AS n, round(avg(CASE WHEN hit_rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN hit_rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN hit_rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(CASE WHEN hit_rank <= 20 THEN 1.0 ELSE 0 END), 6) AS recall_20,
round(avg(coalesce(1.0 / hit_rank, 0)), 6) AS mrr, round(avg(CASE WHEN hit_rank <= 10 THEN 1.0 / log2(hit_rank + 1.0) ELSE 0 END), 6) AS ndcg_10 FROM h""")
def a1_rank_metrics(spark, d):
    q = _benchmark(spark, d)
    return M.rank_metrics(M.first_hit(R.bm25_topk(corpus(spark, d), q, 100), _gold(spark, d), q))


@query("SELECT source, lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())")
def a3_a16_describe(spark, d):
    docs = table(spark, d, "documents").withColumn("chars", F.length("text"))
    return docs.groupingSets([["source", "lang"], ["source"], ["lang"], []], "source", "lang").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query(f"""WITH {DENSE}, g0 AS (SELECT dn.*, a.label = b.label AS gold FROM dn JOIN v a ON a.vec_id = query_id JOIN v b ON b.vec_id = corpus_idx WHERE query_id <> corpus_idx), g AS (SELECT *, max(CASE WHEN gold THEN score END) OVER (PARTITION BY query_id) AS best FROM g0)
SELECT query_id, round(100.0 * count(*) FILTER (WHERE NOT gold AND score < best) / count(*) FILTER (WHERE NOT gold), 2) AS percentile, round(max(score) FILTER (WHERE gold), 6) AS gold_sim, round((max(score) FILTER (WHERE gold) - avg(score) FILTER (WHERE NOT gold)) / stddev_samp(score) FILTER (WHERE NOT gold), 5) AS z FROM g GROUP BY 1""")
def w10_g4_gold_similarity(spark, d):
    g = _grid(spark, d).gold_place()
    mean = F.col("total") / F.col("n")
    sd = F.sqrt((F.col("squares") - F.col("n") * mean * mean) / (F.col("n") - 1))
    return g.select("query_id", F.round(100.0 * F.col("below") / F.col("n"), 2).alias("percentile"), F.round("best", 6).alias("gold_sim"), F.round((F.col("best") - mean) / sd, 5).alias("z"))


@query("""SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS sd, CAST(min(n_chars) AS DOUBLE) AS least, round(quantile_cont(n_chars, 0.5), 6) AS median, CAST(max(n_chars) AS DOUBLE) AS most, bool_and(n_chars = 0) AS all_zero FROM documents GROUP BY 1""")
def a5_group_stats(spark, d):
    return M.group_stats(table(spark, d, "documents").withColumn("n_chars", F.col("n_chars").cast("double")), "n_chars", "lang")


@query("""SELECT CAST(b.bin AS INTEGER) AS bin, count(x.bin) AS n FROM range(20) b(bin) LEFT JOIN (SELECT least(floor(n_chars / 500.0), 19) AS bin FROM documents WHERE n_chars BETWEEN 0 AND 10000) x ON x.bin = b.bin GROUP BY 1""")
def a6_histogram(spark, d):
    return M.histogram(table(spark, d, "documents").withColumn("x", F.col("n_chars").cast("double")), "x", 0.0, 10000.0, 20)


@query(f"WITH {DENSE} SELECT floor(round(quantile_cont(score, 0.1) * 100, 6)) / 100 AS p10, floor(round(quantile_cont(score, 0.9) * 100, 6)) / 100 AS p90 FROM dn")
def a7_percentile_floor(spark, d):
    floor = lambda x: F.lit(x).cast("double") if x is None else F.floor(F.round(F.lit(x) * 100, 6)) / 100
    p10, p90 = _grid(spark, d).quantiles([0.1, 0.9])
    return spark.range(1).select(floor(p10).alias("p10"), floor(p90).alias("p90"))


@query("SELECT code, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id)[1:50], ',') AS examples FROM (SELECT doc_id, md5(text) AS code FROM documents) GROUP BY 1 HAVING count(*) > 1")
def a10_reused_codes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("code"))
    return C.counts_with_examples(docs, ["code"], "doc_id", 50).filter("n > 1")


CELLS = f"""m AS (SELECT unnest(['full_text', 'minimal_text', 'minimal_no_code']) AS mode), e AS (SELECT corpus_idx, mode, length(CASE mode WHEN 'full_text' THEN code || ' ' || text WHEN 'minimal_text' THEN code || ' ' || {first('text')} ELSE {first('text')} END) AS chars FROM c, m),
cell AS (SELECT mode AS return_mode, rank AS depth, round(avg(chars), 4) AS exposure FROM rk JOIN e USING (corpus_idx) WHERE rank <= 10 GROUP BY 1, 2)"""


@query(f"WITH {BM25}, {CORPUS}, {CELLS} SELECT return_mode, CAST(depth AS INTEGER) AS depth, exposure FROM cell")
def a17_exposure_cells(spark, d):
    return _cells(spark, d)


def _cells(spark, d) -> DataFrame:
    docs = corpus(spark, d)
    best = R.bm25_topk(docs, _benchmark(spark, d), 10)
    e = docs.join(best.select("corpus_idx").distinct(), "corpus_idx", "left_semi").withColumn("return_mode", F.explode(F.array(*map(F.lit, T.MODES[:3])))).select("corpus_idx", "return_mode", T.exposure_chars(F.col("return_mode")).alias("chars"))
    return best.join(e, "corpus_idx").groupBy("return_mode", F.col("rank").cast("int").alias("depth")).agg(F.round(F.avg("chars"), 4).alias("exposure"))


@query(f"""WITH {BM25}, {CORPUS}, {CELLS} SELECT return_mode, CAST(depth AS INTEGER) AS depth, exposure FROM cell a WHERE NOT EXISTS (SELECT 1 FROM cell b WHERE b.depth >= a.depth AND b.exposure <= a.exposure AND (b.depth > a.depth OR b.exposure < a.exposure))""")
def j15_pareto(spark, d):
    return M.pareto(_cells(spark, d), "depth", "exposure")


# ---------------------------------------------------------------- joins, sets, corpus building


@query(f"""WITH a AS (SELECT DISTINCT item_id AS left_id, unnest({tok('text')}) AS tok FROM benchmark), b AS (SELECT DISTINCT doc_id AS right_id, unnest({tok('text')}) AS tok FROM documents),
na AS (SELECT left_id, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT right_id, count(*) AS nb FROM b GROUP BY 1),
x AS (SELECT left_id, right_id, round(count(*) / (any_value(na) + any_value(nb) - count(*)), 9) AS jaccard FROM a JOIN b USING (tok) JOIN na USING (left_id) JOIN nb USING (right_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY jaccard DESC, right_id DESC) AS rank FROM x)
SELECT left_id, right_id, jaccard, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def j7_j8_jaccard_candidates(spark, d):
    left = _benchmark(spark, d).withColumnRenamed("query_id", "left_id")
    return C.jaccard_candidates(left, table(spark, d, "documents").select(F.col("doc_id").alias("right_id"), "text"), 3).withColumn("rank", F.col("rank").cast("int"))


@query(f"WITH {CORPUS}, r AS (SELECT *, row_number() OVER (PARTITION BY source, code ORDER BY length(text) DESC, corpus_idx) AS k, count(*) OVER (PARTITION BY source, code) AS n FROM c) SELECT source, code, corpus_idx, CAST(length(text) AS INTEGER) AS n_chars, n - 1 AS duplicates FROM r WHERE k = 1")
def w7_keep_longest(spark, d):
    return C.keep_longest(corpus(spark, d), "source", "code")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
e AS (SELECT *, sum(CASE WHEN length(line) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS entry FROM l)
SELECT doc_id, CAST(entry AS BIGINT) AS entry, count(*) AS n_lines, md5(string_agg(line, ' ' ORDER BY k)) AS text_md5 FROM e GROUP BY 1, 2""")
def s5_w8_assemble_lines(spark, d):
    return C.assemble_lines(table(spark, d, "documents"), "doc_id", "text", F.length("line") < 60).select("doc_id", "entry", "n_lines", F.md5("text").alias("text_md5"))


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS pos FROM documents)
SELECT doc_id, source, CAST(pos AS INTEGER) AS pos, CASE WHEN pos % 2 = 1 THEN 'ko' ELSE 'en' END AS lang, CAST(CAST('0x' || substr(md5('t:' || doc_id), 1, 8) AS BIGINT) % 5 AS INTEGER) AS template FROM r WHERE pos <= 260""")
def o3_generated_queries(spark, d):
    """At most 260 rows a source in a seeded order, Korean and English in turn, each with one of five templates."""
    out = C.sample_per_group(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 260, "42")
    template = S.draw(F.lit(5), F.lit("t"), F.col("doc_id").cast("string")).cast("int")
    return out.select("doc_id", "source", F.col("pos").cast("int").alias("pos"), F.when(F.col("pos") % 2 == 1, "ko").otherwise("en").alias("lang"), template.alias("template"))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN pos <= floor(n * 0.1) THEN 'train' WHEN pos <= 2 * floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r")
def o4_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"))
    return C.split_by_position(docs, ["h", "doc_id"]).select("doc_id", "split")


@query(f"""WITH o AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), n AS (SELECT doc_id, {CLEAN} AS text FROM documents WHERE lang <> 'es')
SELECT doc_id, CASE WHEN n.text IS NULL THEN 'only_old' WHEN o.text IS NULL THEN 'only_new' WHEN o.text = n.text THEN 'same' ELSE 'changed' END AS status FROM o FULL JOIN n USING (doc_id)""")
def j13_t1_version_diff(spark, d):
    docs = table(spark, d, "documents")
    old = docs.join(table(spark, d, "labels"), "doc_id", "left_semi")
    return C.version_diff(old, docs.filter("lang <> 'es'").select("doc_id", T.clean_text("text").alias("text")), "doc_id", "text")


@query("SELECT d.doc_id, sha256(text) AS sha256 FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 0")
def s15_j10_hash_and_anti_join(spark, d):
    bad = table(spark, d, "labels").filter("quality = 0")
    return table(spark, d, "documents").join(bad, "doc_id", "left_anti").select("doc_id", F.sha2("text", 256).alias("sha256"))


# ---------------------------------------------------------------- statistics


@query(f"""WITH {HYBRID}, p AS (SELECT a.alpha, a.query_id, a.hit AS a, b.hit AS b FROM hits a JOIN hits b ON b.query_id = a.query_id AND b.alpha = 0.0 WHERE a.alpha > 0),
w AS (SELECT alpha, sum(CASE WHEN a > b THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN b > a THEN 1 ELSE 0 END) AS losses, sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS ties FROM p GROUP BY 1)
SELECT alpha, CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, CAST(ties AS BIGINT) AS ties, CASE WHEN wins + losses = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) + (wins + losses) * ln(0.5))) FROM range(CAST(greatest(wins, losses) AS BIGINT), CAST(wins + losses + 1 AS BIGINT)) t(i))), 6) END AS p_two_sided FROM w""")
def u3_mcnemar(spark, d):
    h = _hits(spark, d)
    pairs = h.filter("alpha > 0").withColumnRenamed("hit", "a").join(h.filter("alpha = 0").select("query_id", F.col("hit").alias("b")), "query_id")
    return S.mcnemar(pairs, "alpha").select("alpha", "wins", "losses", "ties", F.round("p_two_sided", 6).alias("p_two_sided"))


@query("""WITH p AS (SELECT source AS name, lang AS family, (abs(hash_n) % 997 + 1) / 20000.0 AS p FROM (SELECT source, lang, count(*) * 37 AS hash_n FROM documents GROUP BY 1, 2)),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, name) AS i, count(*) OVER (PARTITION BY family) AS k FROM p),
a AS (SELECT *, max(least(1.0, p * (k - i + 1))) OVER (PARTITION BY family ORDER BY i) AS adj FROM r)
SELECT family, name, round(p, 8) AS p, CAST(k AS BIGINT) AS family_size, round(adj, 8) AS p_adjusted, min(CASE WHEN adj < 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY family ORDER BY i) = 1 AS significant FROM a""")
def u7_w4_holm(spark, d):
    p = table(spark, d, "documents").groupBy(F.col("source").alias("name"), F.col("lang").alias("family")).agg(((F.count("*") * 37 % 997 + 1) / 20000.0).alias("p"))
    return S.holm(p, "family", "p", "name").select("family", "name", F.round("p", 8).alias("p"), "family_size", F.round("p_adjusted", 8).alias("p_adjusted"), "significant")


def uniform_sql(seed: str, iters: int) -> str:
    return f"(SELECT it, (CAST('0x' || substr(md5('{seed}:' || it), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u FROM range({iters}) r(it))"


def interval_draws_sql(counts: str, iters: int, seed: str = "20260626") -> str:
    """bd: (n, w, l, lo, hi) of the rows (n, w, l) of ``counts``: percentile interval of resampled (wins - losses) / n."""
    part = lambda k, c: f"CASE WHEN {k} = 0 THEN 0 ELSE {k} * ln(CAST({c} AS DOUBLE) / n) END"
    return f"""bk AS (SELECT DISTINCT CAST(n AS BIGINT) AS n, CAST(w AS BIGINT) AS w, CAST(l AS BIGINT) AS l FROM {counts}),
bi_ AS (SELECT *, unnest(range(0, CASE WHEN w > 0 THEN n ELSE 0 END + 1)) AS i FROM bk), bj AS (SELECT *, unnest(range(0, CASE WHEN l > 0 THEN n - i ELSE 0 END + 1)) AS j FROM bi_),
bp AS (SELECT n, w, l, i - j AS dd, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(j + 1) - lgamma(n - i - j + 1) + {part('i', 'w')} + {part('j', 'l')} + {part('(n - i - j)', '(n - w - l)')})) AS p FROM bj WHERE n - w - l > 0 OR i + j = n GROUP BY ALL),
bc AS (SELECT *, sum(p) OVER (PARTITION BY n, w, l ORDER BY dd) AS upto FROM bp), bx AS (SELECT n, w, l, max(dd) AS top FROM bp GROUP BY ALL),
bu_ AS (SELECT bk.*, it, u FROM bk, {uniform_sql(seed, iters)}),
bd AS (SELECT n, w, l, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM (SELECT x.n, x.w, x.l, CAST(coalesce(c.dd, bx.top) AS DOUBLE) / x.n AS m FROM bu_ x ASOF LEFT JOIN bc c ON c.n = x.n AND c.w = x.w AND c.l = x.l AND x.u <= c.upto JOIN bx ON bx.n = x.n AND bx.w = x.w AND bx.l = x.l) GROUP BY ALL)"""


@query(f"""WITH {HYBRID}, bq AS (SELECT count(*) AS n, sum(hit) AS w, 0 AS l FROM hits WHERE alpha = 0.5), {interval_draws_sql('bq', 20000)} SELECT 20000 AS iters, lo, hi FROM bd""")
def u1_o5_hash_bootstrap(spark, d):
    h = _hits(spark, d).filter("alpha = 0.5").select("query_id", F.col("hit").alias("d"))
    return U.bootstrap(h, iters=20_000).select(F.lit(20_000).alias("iters"), "lo", "hi")


# ---------------------------------------------------------------- ablation and ladders


@query("""WITH a AS (SELECT item_id, text, replace(text, 'tion', '<1>') AS t1 FROM benchmark), b AS (SELECT *, CASE WHEN item_id < 20 THEN replace(t1, 'ing', '<5>') ELSE t1 END AS t2 FROM a),
r AS (SELECT item_id, t2, replace(t2, 'the', '<2>') AS t3, [CASE WHEN contains(text, 'tion') THEN 'tion' END, CASE WHEN item_id < 20 AND contains(t1, 'ing') THEN 'ing' END, CASE WHEN contains(t2, 'the') THEN 'the' END] AS l,
  [CASE WHEN NOT contains(text, 'tion') THEN 'tion' END, CASE WHEN item_id < 20 AND NOT contains(t1, 'ing') THEN 'ing' END, CASE WHEN NOT contains(t2, 'the') THEN 'the' END] AS k FROM b)
SELECT item_id AS query_id, trim(regexp_replace(t3, '\\s+', ' ', 'g')) AS text, CAST(len(list_filter(l, lambda z: z IS NOT NULL)) AS INTEGER) AS applied, array_to_string(list_filter(l, lambda z: z IS NOT NULL), ',') AS log, array_to_string(list_filter(k, lambda z: z IS NOT NULL), ',') AS skipped FROM r""")
def r25_substitution(spark, d):
    rules = [(1, None, "tion", "<1>", None), (1, "en", "the", "<2>", None), (1, "ko", "a", "<3>", None), (1, None, "ing", "<5>", list(range(20))), (2, None, "e", "<4>", None)]
    rules = spark.createDataFrame(rules, "tier int, lang string, phrase string, hypernym string, query_ids array<long>")
    out = C.substitute(_benchmark(spark, d).withColumn("lang", F.lit("en")), rules, 1)
    return out.select("query_id", T.collapse("text").alias("text"), "applied", F.array_join("log", ",").alias("log"), F.array_join("skipped", ",").alias("skipped"))


LADDER = "l AS (SELECT conv_id, turn, role, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) = text AS same FROM conversations)"


@query(f"WITH {LADDER} SELECT conv_id, count(*) AS levels, bool_and(coalesce(n <= p, true)) AS monotone, count(*) FILTER (WHERE same) AS repeats, CAST(min(turn) FILTER (WHERE n > p) AS BIGINT) AS first_rise FROM l GROUP BY 1")
def w3_d7_monotone_levels(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumns({"n": F.length("text"), "p": F.lag(F.length("text")).over(w), "same": F.lag("text").over(w) == F.col("text")})
    return c.groupBy("conv_id").agg(F.count("*").alias("levels"), F.bool_and(F.coalesce(F.col("n") <= F.col("p"), F.lit(True))).alias("monotone"), F.count_if("same").alias("repeats"), F.min(F.when(F.col("n") > F.col("p"), F.col("turn"))).cast("long").alias("first_rise"))


@query(f"WITH {LADDER} SELECT turn, count(*) AS n, round(avg(n), 6) AS mean_chars, count(*) FILTER (WHERE same) AS identical, count(DISTINCT role) AS roles FROM l GROUP BY 1")
def a14_level_summary(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("same", F.lag("text").over(w) == F.col("text"))
    return c.groupBy("turn").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.count_if("same").alias("identical"), F.count_distinct("role").alias("roles"))


@query(f"""WITH a AS (SELECT doc_id, lang, {tok(first('text'))} AS h, {tok('text')} AS b FROM documents), j AS (SELECT lang, CASE WHEN len(list_distinct(list_concat(h, b))) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(h), list_distinct(b))) / len(list_distinct(list_concat(h, b))) END AS j FROM a)
SELECT lang, count(*) AS n, round(avg(j), 6) AS mean_jaccard, round(max(j), 6) AS most, avg(CASE WHEN j = 0 THEN 1.0 ELSE 0 END) >= 0.9 AND max(j) < 0.1 AS void FROM j GROUP BY 1""")
def r29_t3_g2_anchor_jaccard(spark, d):
    j = T.jaccard(T.tokens(T.first_sentence("text")), T.tokens("text"))
    return table(spark, d, "documents").select("lang", j.alias("j")).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("j"), 6).alias("mean_jaccard"), F.round(F.max("j"), 6).alias("most"), ((F.avg(F.when(F.col("j") == 0, 1.0).otherwise(0.0)) >= 0.9) & (F.max("j") < 0.1)).alias("void"))


@query("""SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)""")
def s11_render_html(spark, d):
    t = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return table(spark, d, "pages").withColumn("t", T.collapse(t)).select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


# ---------------------------------------------------------------- audits and integrity


@query(f"""WITH {HYBRID}, h AS (SELECT 'm' || CAST(alpha AS VARCHAR) AS model, alpha, query_id, CASE WHEN query_id % 300 = 0 AND alpha = 0.5 THEN 2 ELSE hit END AS hit FROM hits WHERE NOT (alpha = 0.3 AND query_id % 200 = 0)),
n AS (SELECT count(DISTINCT query_id) AS n FROM hits)
SELECT 'domain' AS rule, model AS key, count(*) AS n FROM h WHERE hit NOT IN (0, 1) GROUP BY 2
UNION ALL SELECT 'missing', model, 1 FROM h, n GROUP BY model, alpha HAVING count(DISTINCT query_id) < max(n.n)""")
def g8_shard_checks(spark, d):
    hits = _hits(spark, d)
    q = hits.select("query_id").distinct()
    bad = F.when((F.col("query_id") % 300 == 0) & (F.col("alpha") == 0.5), 2).otherwise(F.col("hit"))
    shards = hits.filter("not (alpha = 0.3 and query_id % 200 = 0)").select(F.concat(F.lit("m"), F.col("alpha").cast("string")).alias("model"), "alpha", "query_id", bad.alias("hit"))
    return I.shard_violations(shards, q)


@query(f"""WITH {HYBRID}, p AS (SELECT a.hit - b.hit AS d FROM hits a JOIN hits b USING (query_id) WHERE a.alpha = 1.0 AND b.alpha = 0.0),
o AS (SELECT count(*) AS n, abs(avg(d)) AS o, CAST(count(*) FILTER (WHERE d <> 0) AS BIGINT) AS m FROM p),
k AS (SELECT n, o, m, h, sum(exp(lgamma(m + 1) - lgamma(h + 1) - lgamma(m - h + 1) - m * ln(2.0))) OVER (ORDER BY h) AS upto FROM (SELECT *, unnest(range(0, m + 1)) AS h FROM o)),
x AS (SELECT u.it, k.n, k.o, abs(2 * k.h - k.m) / k.n AS v FROM {uniform_sql('123', 2000)} u ASOF JOIN k ON u.u <= k.upto)
SELECT round(any_value(o), 6) AS observed, count(*) AS draws, round((count(*) FILTER (WHERE v >= o - 1e-12) + 1) / (count(*) + 1), 6) AS p FROM x""")
def u8_permutation(spark, d):
    h = _hits(spark, d)
    pairs = h.filter("alpha = 1.0").join(h.filter("alpha = 0").select("query_id", F.col("hit").alias("b")), "query_id")
    counts = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("hit") > F.col("b")).alias("wins"), F.count_if(F.col("hit") < F.col("b")).alias("losses"))
    return RS.sign_flips(counts, 2_000).select(F.round("observed", 6).alias("observed"), "draws", F.round("p", 6).alias("p"))


@query(f"""WITH {BM25}, {GOLD}, one AS (SELECT query_id, min(corpus_idx) AS corpus_idx FROM gold GROUP BY 1),
nx AS (SELECT query_id, corpus_idx + 1 AS corpus_idx FROM gold), tw AS (SELECT query_id, corpus_idx + 2 AS corpus_idx FROM gold),
g AS (SELECT 'original' AS view, * FROM gold UNION ALL SELECT 'primary_only', * FROM one UNION ALL SELECT 'with_equivalent_strict', * FROM (SELECT * FROM gold UNION SELECT * FROM nx) UNION ALL SELECT 'with_equivalent', * FROM (SELECT * FROM gold UNION SELECT * FROM nx UNION SELECT * FROM tw) UNION ALL SELECT 'equivalent_only', * FROM (SELECT * FROM nx EXCEPT SELECT * FROM gold)),
h AS (SELECT view, query_id, max(CASE WHEN rk.rank <= 10 THEN 1 ELSE 0 END) AS hit FROM g LEFT JOIN rk USING (query_id, corpus_idx) GROUP BY 1, 2)
SELECT view, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 6) AS recall FROM h GROUP BY 1""")
def u16_recall_by_label_view(spark, d):
    """Recall of one ranking under five definitions of gold; the next two documents stand for strict and other equivalents."""
    q, gold = _benchmark(spark, d), _gold(spark, d).distinct()
    top = R.bm25_topk(corpus(spark, d), q, 10)
    after = lambda k: gold.select("query_id", (F.col("corpus_idx") + k).alias("corpus_idx"))
    views = {
        "original": gold, "primary_only": gold.groupBy("query_id").agg(F.min("corpus_idx").alias("corpus_idx")), "with_equivalent_strict": gold.union(after(1)).distinct(),
        "with_equivalent": gold.union(after(1)).union(after(2)).distinct(), "equivalent_only": after(1).join(gold, ["query_id", "corpus_idx"], "left_anti"),
    }
    rows = None
    for name, v in views.items():
        part = v.withColumn("view", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    hit = rows.join(top.select("query_id", "corpus_idx", F.lit(1).alias("in_top")), ["query_id", "corpus_idx"], "left").groupBy("view", "query_id").agg(F.max(F.coalesce("in_top", F.lit(0))).alias("hit"))
    return hit.groupBy("view").agg(F.count("*").alias("n"), F.sum("hit").cast("long").alias("hits"), F.round(F.avg("hit"), 6).alias("recall"))


@query("""WITH g AS (SELECT doc_id, md5(text) AS code FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY code) AS first FROM g) SELECT doc_id, code FROM f WHERE first < doc_id""")
def w9_first_use(spark, d):
    return I.first_use(table(spark, d, "documents").select("doc_id", F.md5("text").alias("code")), "code", "doc_id")


@query("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(trim(text), '[.;:!?)]$')) AS unterminated, round(avg(CASE WHEN regexp_matches(trim(text), '[.;:!?)]$') THEN 0.0 ELSE 1.0 END), 6) AS ratio,
count(*) FILTER (WHERE length(text) < 150 OR regexp_matches(text, '(?i)\\b(?:reserved|not used)\\b')) AS stubs FROM documents GROUP BY 1""")
def p24_p36_stub_and_unterminated(spark, d):
    end = F.trim("text").rlike("[.;:!?)]$")
    stub = (F.length("text") < 150) | F.col("text").rlike(r"(?i)\b(?:reserved|not used)\b")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~end).alias("unterminated"), F.round(F.avg(F.when(end, 0.0).otherwise(1.0)), 6).alias("ratio"), F.count_if(stub).alias("stubs"))


@query(f"""WITH {CORPUS}, n AS (SELECT corpus_idx, {first('text')} AS body FROM c WHERE source = 'ecfr_part774' AND corpus_idx % 2 = 0)
SELECT c.corpus_idx, md5(coalesce(n.body, c.text)) AS body_md5, n.body IS NOT NULL AS replaced FROM c LEFT JOIN n USING (corpus_idx)""")
def j14_conditional_overwrite(spark, d):
    c = corpus(spark, d)
    new = c.filter("source = 'ecfr_part774' and corpus_idx % 2 = 0").select("corpus_idx", T.first_sentence("text").alias("body"))
    return c.join(new, "corpus_idx", "left").select("corpus_idx", F.md5(F.coalesce("body", "text")).alias("body_md5"), F.col("body").isNotNull().alias("replaced"))
