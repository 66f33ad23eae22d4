"""Quality by perplexity under a model of trusted text.

An interpolated modified Kneser-Ney model of characters is counted over four
fifths of the trusted documents (by a hash of the id); every document gets its
perplexity per character by the sharded count joins of ``lm_scoring``: blocks of
documents send their distinct n-grams to shards of the counts and get the counts
back.  A document is kept if its perplexity is at most a quantile of the
perplexities of its language's trusted documents that the model was not trained
on (of all its trusted documents, if none was held out; of all its documents, if
none is trusted).  Perplexities are rounded to three decimals; the quantile is
exact: the least of them that the given share does not exceed.

Defined results: null text counts as empty (its end mark is scored); null
languages are one language; null ids are never trusted; labels that repeat an
id are trusted if any of them is; without trusted text every perplexity is 1
and everything is kept; rows that repeat an id are scored one by one; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_fold
from .lm_scoring import lm_scores

#: Blocks hold this many bytes of text (a token is a character), shards as much as this many bytes name.
BLOCK_BYTES, SHARD_BYTES = 2 << 20, 48 << 20


def quality(docs: DataFrame, trusted: DataFrame, *, order: int = 4, quantile: float = 0.95, folds: int = 5, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, lang, trusted, n_characters, perplexity, threshold, kept of every row."""
    scratch = Scratch(docs.sparkSession, "quality")
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("of")).filter("of is not null").distinct()
    learn = crc_fold(doc_id, folds) != 0
    scored = lm_scores(docs, learn, trusted=ids, order=order, unit="character", tag=F.col(lang), text=text, doc_id=doc_id, block_bytes=block_bytes, shard_bytes=SHARD_BYTES)
    perplexity = F.round(F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")), 3)
    scored = scored.select("doc_id", F.col("tag").alias("lang"), (F.col("n_tokens") - 1).alias("n_characters"), perplexity.alias("perplexity"), F.col("train"))
    scored = scratch.keep(scored.join(ids, F.col("doc_id") == F.col("of"), "left").select("doc_id", "lang", F.col("of").isNotNull().alias("trusted"), "train", "n_characters", "perplexity"))
    at = lambda which: F.expr(f"percentile_disc({quantile}) within group (order by case when {which} then perplexity end)")
    limits = scored.groupBy(F.col("lang").alias("of")).agg(F.coalesce(at("trusted and not train"), at("trusted"), at("true")).alias("threshold"))
    out = scored.join(limits, scored.lang.eqNullSafe(F.col("of")))
    return out.select("doc_id", "lang", "trusted", "n_characters", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("kept"))
