"""Corpus building: deduplication, line assembly, sampling, splits, version differences, Jaccard candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.text import tokens
from siftlake.operators.retrieval import best_of_block, occurrences
from siftlake.shipping import ship

#: Rows of either side whose matrix is made at once.
LEFT_ROWS, RIGHT_ROWS = 256, 1024


def keep_longest(rows: DataFrame, *keys: str, text: str = "text", order: str = "corpus_idx") -> DataFrame:
    """One row per key: the longest text, the first of equal ones; duplicates: how many were dropped.

    Counts and the winner are one aggregation with map-side combining, so a hot
    key costs one row per task.
    """
    rank = F.struct(F.length(text).alias("n"), (-F.col(order)).alias("first"))
    best = rows.groupBy(*keys).agg(F.max(rank).alias("best"), (F.count("*") - 1).alias("duplicates"))
    return best.select(*keys, (-F.col("best.first")).alias(order), F.col("best.n").alias("n_chars"), "duplicates")


def assemble_lines(rows: DataFrame, key: str, text: str, is_start: Column) -> DataFrame:
    """(key, entry, n_lines, text): lines of a text grouped from each start line on; lines before the first start are entry 0."""
    lines = rows.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("entry", F.sum(is_start.cast("int")).over(w))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    return marked.groupBy(key, "entry").agg(F.count("*").alias("n_lines"), whole.alias("text"))


def sample_per_group(rows: DataFrame, group: str, id_col: str, most: int, seed: str) -> DataFrame:
    """At most ``most`` rows of each group, in the order of a hash of the id (a sampling operator)."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    w = Window.partitionBy(group).orderBy("h", id_col)
    return rows.withColumn("h", h).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= most)


def split_by_position(rows: DataFrame, order: list[str], train: float = 0.1, val: float = 0.1) -> DataFrame:
    """Adds ``split``: the first floor(n * train) rows in the order, then floor(n * val), then the test rows.

    order: the name of a hash (hexadecimal text) and further names that settle
    ties.  Rows are counted by the hash's first four digits; a row's position is
    what the lower digits hold plus its place among its own, so no task sorts
    more than one 65,536th of the rows.
    """
    n = rows.count()
    a, b = int(n * train), int(n * train) + int(n * val)
    placed = rows.withColumn("cell", F.substring(order[0], 1, 4))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    cells = placed.groupBy("cell").agg(F.count("*").alias("c")).select("cell", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    placed = placed.join(cells, "cell").withColumn("pos", F.col("base") + F.row_number().over(Window.partitionBy("cell").orderBy(*order)))
    return placed.withColumn("split", F.when(F.col("pos") <= a, "train").when(F.col("pos") <= b, "val").otherwise("test")).drop("cell", "base", "pos")


def version_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): only_old, only_new, changed or same."""
    o, n = old.select(key, F.col(value).alias("o"), F.lit(True).alias("in_o")), new.select(key, F.col(value).alias("n"), F.lit(True).alias("in_n"))
    status = F.when(F.col("in_n").isNull(), "only_old").when(F.col("in_o").isNull(), "only_new").when(F.col("o").eqNullSafe(F.col("n")), "same").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, status.alias("status"))


def jaccard_candidates(left: DataFrame, right: DataFrame, k: int, at: int = 9) -> DataFrame:
    """(left_id, right_id, jaccard, rank): the k most similar right rows of each left one, by token sets.

    left, right: (left_id, text), (right_id, text); pairs without a common token
    are none; ties go to the larger right_id.  Blocks of right rows meet parts
    of left ones under a common key, as two matrices of 0 and 1, and keep k rows
    for each.
    """
    ship(left.sparkSession)
    parts, blocks = (max(1, -(-d.count() // n)) for d, n in ((left, LEFT_ROWS), (right, RIGHT_ROWS)))
    sets = lambda d, key: d.select(F.col(key).cast("long").alias("id"), F.array_distinct(tokens("text")).alias("s"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = sets(left, "left_id").select(own(parts).alias("part"), every(blocks).alias("block"), F.lit(True).alias("asks"), "id", "s")
    held = sets(right, "right_id").select(every(parts).alias("part"), own(blocks).alias("block"), F.lit(False).alias("asks"), "id", "s")

    def run(table):
        asks = table.column("asks")
        a, b = table.filter(asks), table.filter(pa.compute.invert(asks))
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if a.num_rows and b.num_rows:
            x, y = a.column("id").to_numpy(), b.column("id").to_numpy()
            words = pa.compute.unique(a.column("s").combine_chunks().flatten())
            seen = [np.zeros((t.num_rows, len(words))) for t in (a, b)]
            for m, t in zip(seen, (a, b), strict=True):
                row, code, _ = occurrences(t.column("s").combine_chunks(), words)
                m[row, code] = 1
            shared = seen[0] @ seen[1].T
            size = [np.diff(t.column("s").combine_chunks().offsets.to_numpy()) for t in (a, b)]
            jaccard = np.round(shared / np.maximum(size[0][:, None] + size[1][None, :] - shared, 1), at)
            q, d = best_of_block(jaccard, y, k, falling=True)
            out = [x[q], y[d], jaccard[q, d]]
        return pa.table([pa.array(c) for c in out], ["left_id", "right_id", "jaccard"])

    w = Window.partitionBy("left_id").orderBy(F.desc("jaccard"), F.desc("right_id"))
    found = asked.union(held).groupBy("part", "block").applyInArrow(run, "left_id long, right_id long, jaccard double")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def drop_tokens(text: Column, dropped: Column) -> Column:
    """The text without the given words (whole, any case; longest first), white space collapsed."""
    ordered = F.array_sort(dropped, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    out = F.aggregate(ordered, F.coalesce(text, F.lit("")), lambda t, w: F.regexp_replace(t, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])"), w, F.lit(r"(?![A-Za-z0-9])")), F.lit("")))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def substitute(queries: DataFrame, rules: DataFrame, level: int) -> DataFrame:
    """(query_id, text, applied, log, skipped): rules of tiers up to the level, in the order (tier, -length, phrase), each replacing all its phrases.

    rules: (tier, lang, phrase, hypernym) and query_ids, if there is such a
    column; a null lang or null ids hold for all.  log: the phrases replaced, in
    order; skipped: those of rules that held but found nothing.  The rule table
    is one row a rule; it is folded over each query.
    """
    ids = F.col("query_ids").cast("array<long>") if "query_ids" in rules.columns else F.lit(None).cast("array<long>")
    ordered = rules.filter(F.col("tier") <= level).select(F.struct("tier", (-F.length("phrase")).alias("n"), "phrase", "hypernym", "lang", ids.alias("ids")).alias("r"))
    packed = ordered.agg(F.array_sort(F.collect_list("r")).alias("rules"))
    none = F.array().cast("array<string>")

    def step(s, r):
        hit = F.contains(s["text"], r["phrase"])
        more = lambda c, yes: F.concat(s[c], F.when(yes, F.array(r["phrase"])).otherwise(none)).alias(c)
        return F.struct(F.replace(s["text"], r["phrase"], r["hypernym"]).alias("text"), more("log", hit), more("skipped", ~hit))

    own = F.filter("rules", lambda r: (r["lang"].isNull() | (r["lang"] == F.col("lang"))) & (r["ids"].isNull() | F.array_contains(r["ids"], F.col("query_id").cast("long"))))
    done = F.aggregate(own, F.struct(F.coalesce("text", F.lit("")).alias("text"), none.alias("log"), none.alias("skipped")), step)
    out = queries.join(F.broadcast(packed)).select("query_id", done.alias("d"))
    return out.select("query_id", "d.text", F.size("d.log").alias("applied"), "d.log", "d.skipped")


def normalised(entries: DataFrame, meta: DataFrame, version: int = 2) -> DataFrame:
    """Entries that are kept, with trimmed codes, clean texts and their source's metadata; meta: one row a source."""
    from siftlake.functions.text import clean_text, drop_reason

    kept = entries.filter(drop_reason("source", "code", "text", version).isNull())
    return kept.withColumns({"code": F.trim("code"), "text": clean_text("text")}).join(meta, "source")


def counts_with_examples(rows: DataFrame, keys: list[str], id_col: str, most: int) -> DataFrame:
    """(keys, n, examples): how many rows, and the lowest ``most`` ids as text.

    Examples are taken part by part before they meet, so a hot key costs
    ``most`` ids for each of its parts.
    """
    part = F.pmod(F.xxhash64(id_col), F.lit(64))
    w = Window.partitionBy(*keys, "part").orderBy(id_col)
    some = rows.select(*keys, id_col, part.alias("part")).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)
    listed = some.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(id_col)), 1, most).alias("ids"))
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.join(listed, keys).select(*keys, "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("examples"))
