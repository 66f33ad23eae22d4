"""One query per operator over its whole table, and their SQL where it can be said in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sql
from .common import read_table
from .conversation_repair import damage, repaired_digests
from .embedding_dedup import embedding_dedup
from .exact_topk import exact_topk
from .fill_middle import fill_in_middle, restored
from .html_extraction import extract
from .language_id import identify
from .lm_scoring import score_documents
from .ngram_join import ngram_join
from .packing import pack
from .quality import quality
from .sentence_pieces import encode_documents
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Order of the query's language model of words.
LM_ORDER = 2


def op1_exact_topk(spark, sf_dir):
    return exact_topk(read_table(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0, k=20)


def op2_quality(spark, sf_dir):
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup(read_table(spark, sf_dir, "documents"), span=200)


def op4_sentence_pieces(spark, sf_dir):
    return encode_documents(read_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op5_toxicity(spark, sf_dir):
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark, sf_dir):
    out = score_documents(read_table(spark, sf_dir, "documents"), order=LM_ORDER)
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op7_ngram_join(spark, sf_dir):
    return ngram_join(read_table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_embedding_dedup(spark, sf_dir):
    return embedding_dedup(read_table(spark, sf_dir, "embeddings"), least=0.93)


def op9_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op10_language_id(spark, sf_dir):
    return identify(read_table(spark, sf_dir, "documents"))


def op11_html_extraction(spark, sf_dir):
    return extract(read_table(spark, sf_dir, "pages"))


def op12_fill_middle(spark, sf_dir):
    out = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


def op13_conversation_repair(spark, sf_dir):
    return repaired_digests(damage(read_table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_quality, op3_suffix_dedup, op4_sentence_pieces, op5_toxicity, op6_lm_scoring, op7_ngram_join, op8_embedding_dedup, op9_packing, op10_language_id, op11_html_extraction, op12_fill_middle, op13_conversation_repair)}

_COMPONENTS = """
reach AS (
  SELECT a AS node, a AS low FROM nodes
  UNION
  SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node WHERE r.low < l.b
)"""

ORACLE_SQL = {
    "op2_quality": sql.quality(4, 0.95, 5),
    "op3_suffix_dedup": sql.suffix_dedup(200),
    "op6_lm_scoring": sql.lm_scoring(LM_ORDER),
    "op12_fill_middle": sql.FILL_MIDDLE,
    "op13_conversation_repair": sql.conversation_repair(),
    "op1_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op8_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings
), u AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE ok),
nodes AS (SELECT vec_id AS a FROM v),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_sum(list_transform(list_zip(x.e, y.e), lambda p: p[1] * p[2])) / (x.n * y.n) >= 0.93
),""" + _COMPONENTS + """,
d AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, min(low) AS component_id, min(low) = v.vec_id AS kept
FROM v JOIN reach ON node = v.vec_id LEFT JOIN d ON d.a = v.vec_id GROUP BY v.vec_id, d.n
""",
    "op7_ngram_join": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t)
), n AS (SELECT t.doc_id, count(g) AS n FROM t LEFT JOIN s USING (doc_id) GROUP BY 1),
nodes AS (SELECT doc_id AS a FROM n),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY 1, 2, nx.n, ny.n HAVING 100 * count(*) >= 90 * (nx.n + ny.n - count(*))
),""" + _COMPONENTS + """
SELECT n.doc_id, n.n AS n_shingles, min(low) AS component_id FROM n JOIN reach ON node = n.doc_id GROUP BY 1, 2
""",
}
