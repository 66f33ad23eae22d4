"""Which documents hold which passages, word for word: a search for many patterns at once, by fingerprints.

A passage of 31 bytes or more is known by winnowed fingerprints of 16 bytes: of
every 16 neighbouring windows the least is chosen, so a document that holds the
passage has chosen the same ones inside it.  Shorter passages are known by
windows of 8 bytes, or by the whole passage.  Documents give only fingerprints
that a filter of one megabyte over the passages' lets through; each passage is
then looked for by the one of its fingerprints that the fewest documents have,
an equi-join, and what is found is compared as text.  A passage one of whose
fingerprints no document has is in no document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.shipping import ship
from siftlake.sources.store import written

#: Bits of the filter, and those of a row of it.
BITS, ROW_BITS = 1 << 23, 1 << 15
#: Base of the hash of a window.
BASE = 0x100000001B3
#: Parts into which the documents of one fingerprint are dealt.
PARTS = 8
#: Tiers: number -> (bytes of a window, windows of which one is chosen).  Tiers 1 to 7 are passages of so many bytes.
TIERS = {**{n: (n, 1) for n in range(1, 8)}, 8: (8, 1), 16: (16, 16)}


def fingerprints(data: np.ndarray, tier: int, allowed: np.ndarray | None = None) -> np.ndarray:
    """The distinct chosen fingerprints of a text's bytes, those whose lower bits are ``allowed``."""
    width, of = TIERS[tier]
    n = len(data) - width + 1
    if n < of:
        return np.zeros(0, np.int64)
    power = lambda k: np.uint64(pow(BASE, k, 1 << 64))
    with np.errstate(over="ignore"):
        unit, part = 1, data
        while width % (2 * unit) == 0:  # windows of twice the bytes, each of two
            part = part[:-unit] * power(unit) + part[unit:]
            unit *= 2
        h = np.full(n, tier, np.uint64) if unit < width else part + np.uint64(tier) * power(width)
        for k in range(0, width if unit < width else 0, unit):
            h = h * power(unit) + part[k : k + n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    step = 1
    while step < of:  # the least of ``of`` neighbours, a power of two
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    if of > 1:
        h = h[np.concatenate(([True], h[1:] != h[:-1]))]
    if allowed is not None:
        h = h[allowed[(h & np.uint64(BITS - 1)).astype(np.int64)]]
    return np.unique(h).view(np.int64)


def tier_of(size):
    return F.when(size >= 31, 16).when(size >= 8, 8).otherwise(size)


def _marks(tiers: list[int] | None, filters: dict[int, bytes] | None):
    """Kernel over (key, bytes[, tier]): rows (key, fingerprint)."""

    def run(batches):
        allowed = None
        if filters is not None:
            bits = np.zeros(BITS // 8, np.uint8)
            for row, data in filters.items():
                bits[row * (ROW_BITS // 8) : row * (ROW_BITS // 8) + len(data)] = np.frombuffer(data, np.uint8)
            allowed = np.unpackbits(bits, bitorder="little").astype(bool)
        for b in batches:
            keys, found = [], []
            for k in range(b.num_rows):
                text = b.column(1)[k].as_buffer()
                if text is None:
                    continue
                data = np.frombuffer(text, np.uint8).astype(np.uint64)
                for tier in tiers or [b.column(2)[k].as_py()]:
                    own = fingerprints(data, tier, allowed)
                    if len(own):
                        found.append(own)
                        keys.append(np.full(len(own), k))
            rows = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["key", "fp"])

    return run


def held_passages(docs: DataFrame, passages: DataFrame, *, doc_id: str = "corpus_idx", text: str = "text", passage_id: str = "query_id", passage: str = "passage") -> DataFrame:
    """(passage_id, doc_id) of every row of docs whose text contains the passage of a row of passages.

    Null texts and passages take no part; an empty passage is in every text;
    repeated rows on either side give repeated rows, as a join on ``contains``
    would.
    """
    spark = docs.sparkSession
    ship(spark)
    asked = passages.select(F.col(passage_id).alias("pid"), F.col(passage).alias("passage")).filter("passage is not null")
    held = docs.select(F.col(doc_id).alias("did"), F.col(text).alias("text")).filter("text is not null")
    texts = asked.filter("passage <> ''").select("passage").distinct().select(F.sha2("passage", 256).alias("key"), "passage", tier_of(F.octet_length("passage")).alias("tier"))
    tiers = [r.tier for r in asked.select(tier_of(F.octet_length("passage")).alias("tier")).distinct().collect()]  # ten at most
    named = lambda pairs: pairs.select(F.col("pid").alias(passage_id), F.col("did").alias(doc_id))
    empty = asked.filter("passage = ''").select("pid").join(held.select("did"), F.lit(True)) if 0 in tiers else None
    tiers = [t for t in tiers if t]
    if not tiers:
        return named(empty if empty is not None else asked.select("pid").join(held.select("did"), F.lit(False)))
    own = texts.select("key", F.col("passage").cast("binary"), "tier").mapInArrow(_marks(None, None), "key string, fp long")
    place = F.col("fp").bitwiseAND(BITS - 1) + 1
    rows = own.groupBy(F.bitmap_bucket_number(place).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # 256 rows of 4 kB at most
    filters = {r["row"] - 1: bytes(r.bits) for r in rows}
    kind = dict(held.dtypes)["did"]
    marks = held.select("did", F.col("text").cast("binary")).mapInArrow(_marks(tiers, filters), f"key {kind}, fp long").withColumnRenamed("key", "did")
    marks = written(marks)  # counted and joined
    common = marks.groupBy("fp").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("key").orderBy("n", "fp")
    anchors = own.join(common, "fp", "left").withColumn("k", F.row_number().over(rarest)).filter("k = 1 and n is not null").select("key", "fp")
    anchors = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    pairs = marks.withColumn("part", F.pmod(F.xxhash64("did"), F.lit(PARTS)).cast("int")).join(anchors, ["fp", "part"]).select("did", "key").distinct()
    near = written(pairs.select(F.col("did").alias("near")).distinct())  # of known size: only their texts are shuffled to meet the pairs
    found = pairs.withColumnRenamed("did", "own").join(held.join(near, F.col("near").eqNullSafe(F.col("did")), "left_semi"), F.col("own").eqNullSafe(F.col("did"))).join(texts.select("key", "passage"), "key").filter(F.contains("text", "passage"))
    out = found.select("passage", "did").join(asked, "passage").select("pid", "did")
    return named(out if empty is None else out.union(empty))
