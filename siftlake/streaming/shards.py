"""Shards that arrive one by one: a stream of hit tables, checked and merged batch by batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftlake.shipping import ship

HITS = "model string, alpha double, query_id long, hit int"


SETTLED = f"{HITS}, shard string, status string"


def _settle(key, parts, state: GroupState):
    """The first hit of a (model, alpha, query) stays in the state; a row that disagrees is refused, one that agrees says nothing new."""
    rows = pd.concat(list(parts)).sort_values(["shard", "hit"])
    if not state.exists:
        state.update((int(rows["hit"].iloc[0]),))
        first = rows.iloc[:1].assign(status="merged")
    else:
        first = rows.iloc[:0].assign(status="merged")
    (anchor,) = state.get
    odd = rows[rows["hit"] != anchor].assign(status="refused")
    yield pd.concat([first, odd])[["model", "alpha", "query_id", "hit", "shard", "status"]]


def merge_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, queries: DataFrame):
    """Reads shards as they land in ``folder`` and adds what is new to ``out``; starts and returns the query.

    A row is sound if its id is known and its hit is 0 or 1.  The hits merged so
    far are the stream's state, so the output is never read again and a shard
    that comes twice adds nothing; the file sink's log makes a batch that is
    repeated after a failure write once.  Rows that disagree with a merged hit
    go to status=refused, with the file they came from.
    """
    ship(spark)
    known = queries.select("query_id").distinct()
    stream = spark.readStream.schema(HITS).parquet(folder).withColumn("shard", F.input_file_name())
    sound = stream.filter(F.col("hit").isin(0, 1)).join(known, "query_id", "left_semi")
    settled = sound.groupBy("model", "alpha", "query_id").applyInPandasWithState(_settle, SETTLED, "hit int", "append", GroupStateTimeout.NoTimeout)
    return settled.writeStream.format("parquet").partitionBy("status").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def merged_hits(spark: SparkSession, out: str) -> DataFrame:
    """The merged rows of ``merge_stream``."""
    return spark.read.schema(SETTLED).parquet(out).filter("status = 'merged'").select("model", "alpha", "query_id", "hit")


def refused_shards(spark: SparkSession, out: str) -> DataFrame:
    """(shard, rows) of the files that disagree with what was merged before."""
    return spark.read.schema(SETTLED).parquet(out).filter("status = 'refused'").groupBy("shard").agg(F.count("*").alias("rows"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window, with late rows beyond the watermark dropped; for streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
