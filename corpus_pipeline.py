"""Corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import language_id, toxicity
from siftlake.llm.common import Scratch, crc_fold, read_table, stage_scratch
from siftlake.llm.ngram_join import ngram_join
from siftlake.llm.packing import pack
from siftlake.llm.suffix_dedup import remove_repeats

#: A document whose language is less sure than this is rejected.
LEAST_SURE = 0.5


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named by position, so that no name can clash or need quotes, and the new names of those that stages read."""
    at = {c: f"c{docs.columns.index(c)}" for c in ("doc_id", "text", "lang", "n_chars")}
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]), at


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go."""
    with stage_scratch(spark):
        own, at = _numbered(docs)
        labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias(at["doc_id"]), "toxic")
        model = toxicity.fit(own, labels, lambda c: crc_fold(c, 5) != 0, text=at["text"], doc_id=at["doc_id"])
        scored = toxicity.predict(own, model, text=at["text"], carry=tuple(own.columns))
        return scored.filter("__score < 0.5").select(*own.columns).toDF(*docs.columns)


def reject_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no sure language, go."""
    with stage_scratch(spark):
        own, at = _numbered(docs)
        model = language_id.fit(own, lambda c: crc_fold(c, 4) != 2, text=at["text"], doc_id=at["doc_id"], lang=at["lang"])
        named = language_id.predict(own, model, text=at["text"], carry=tuple(own.columns))
        return named.filter(F.col("__score") >= LEAST_SURE).filter("__lang <> 'und'").select(*own.columns).toDF(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their word 5-grams (Jaccard 0.8 or more) the one with the smallest id stays.

    Rows without an id stay; of rows that repeat an id, which are one document,
    the least by all columns does.
    """
    with stage_scratch(spark):
        own, at = _numbered(docs)
        texts = own.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"))
        kept = ngram_join(texts, n=5, percent=80).filter("doc_id = component_id").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__rows"))
        named = own.join(kept, F.col(at["doc_id"]) == F.col("__id"))
        several = named.filter("__rows > 1").groupBy("__id").agg(F.min(F.struct(*own.columns)).alias("__row")).select("__row.*")
        return named.filter("__rows = 1").select(*own.columns).union(several).union(own.filter(F.col(at["doc_id"]).isNull())).toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every 200-byte string that occurs more than once is cut out wherever it stands; n_chars follows (null text stays null)."""
    with stage_scratch(spark):
        own, at = _numbered(docs)
        out = remove_repeats(own, span=200, text=at["text"])
        return out.withColumn(at["n_chars"], F.length(at["text"]).cast(dict(own.dtypes)[at["n_chars"]])).select(*own.columns).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1,024 tokens."""
    with stage_scratch(spark):
        own, at = _numbered(docs)
        texts = own.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"))
        return pack(texts, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", reject_toxic),
    ("language", reject_language),
    ("near duplicates", one_of_each_group),
    ("repeated substrings", cut_repeats),
    ("packing", pack_sequences),
]

#: Trained models, tokenizers and byte-level cuts have no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again, those of the stage before go."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        between, before = Scratch(spark, f"pipeline-{k}"), between if k else None
        rows = between.keep(stage(spark, docs, sf_dir))
        if before:
            before.drop(docs)
        docs = rows
    return STAGES[-1][1](spark, docs, sf_dir)
