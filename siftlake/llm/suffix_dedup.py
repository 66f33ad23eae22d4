"""Repeated-substring removal by prefix-free parsing.

A byte is removed if a string of ``span`` bytes that covers it also starts
anywhere else in the corpus.  Texts are parsed by rolling-hash triggers: the
trigger of a window of ``span`` bytes is the leftmost of its (span / 2)-grams
with the least rolling hash, so it is a function of the window's bytes alone;
consecutive windows that share a trigger form a phrase.  Equal windows thus lie
in phrases with the same trigger gram, at the same distance from it.

1. Parse.  Blocks of texts ask fragments of the trigger order which of their
   trigger grams the corpus holds more than once; a phrase whose gram occurs
   once has no equal window.  (Most phrases end here.)
2. Dictionary.  Phrases that occur twice or more as a whole are equal to their
   copies over their whole length: all their windows are repeated.
3. Suffix arrays.  What is left are dictionary phrases that occur once but share
   their trigger gram with other phrases, at the borders of repeated passages.
   For every such gram the suffixes that start in its phrases are sorted by
   bytes, as far as ``span`` bytes, at equal distances from the trigger;
   neighbours that agree over ``span`` bytes are repeated.  A gram with more than
   ``BUCKET`` phrases would be too much for one task: its suffixes are dealt out
   by their fingerprints instead, which puts equal ones together all the same.

With the order by (trigger gram, distance, bytes) of the dictionary's suffixes
and the parse's occurrences of each phrase, every repeated string of the corpus
has been a neighbour of its like; the order is not that of the alphabet over
grams, which nothing here asks for.  Texts travel compressed, a block at a time;
results are exact up to collisions of 64-bit fingerprints.

Defined results: null text counts as empty (``remove_repeats`` leaves it null);
texts shorter than ``span`` bytes lose nothing; repeated rows are copies of each
other; a null doc_id is kept; extra columns are ignored by ``suffix_dedup`` and
returned as they are by ``remove_repeats``, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, U64, Scratch, i64, mix, over_batches, over_cogroup, over_group, pack_sorted, prefix_hash, release_shuffles, scattered, slices, span_hash, squeeze, text_bytes, unpack_sorted

_PLACE = U64((1 << 28) - 1)
#: Bytes and rows of text in a block; bytes of text whose triggers a fragment of their order holds.
BLOCK_BYTES, BLOCK_ROWS, FRAGMENT_BYTES = 5 << 20, 100_000, 24 << 20
#: Phrases of a trigger gram that one suffix array holds; suffixes sorted at once, about.
BUCKET, SORTED = 1024, 100_000
REQUEST = "fragment int, block long, keys binary, several binary, carry binary, lengths binary, texts binary"
REPLY = "block long, fragment int, n int, live binary, carry binary, lengths binary, texts binary"
BLOCK = "block long, carry binary, lengths binary, texts binary, phrases array<struct<row:int,s0:int,s1:int,t:int,trigger:long,phrase:long>>"
BORDER = "trigger long, bytes binary, at int, suffix long, block long, row int, s0 int, s1 int, once boolean"
RUNS = "block long, row int, s0 int, s1 int"


def phrases(data: np.ndarray, offsets: np.ndarray, span: int):
    """(row, first window, last window, trigger's place, fingerprint of trigger gram, of phrase); places from the row's start."""
    gram, width = span // 2, span - span // 2 + 1
    p = prefix_hash(data)
    n = len(data) - gram + 1
    none = np.zeros(0, np.int64)
    nothing = none, none, none, none, none.view(U64), none.view(U64)
    if n < width:
        return nothing
    at = np.arange(n)
    rank = (span_hash(p, at, at + gram) & ~_PLACE) | at.astype(U64)
    padded = np.full(-(-n // width) * width, ~U64(0))
    padded[:n] = rank
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, 1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    trigger = (np.minimum(after[: n - width + 1], before[width - 1 : n]) & _PLACE).astype(np.int64)
    row_of = np.searchsorted(offsets, np.arange(len(trigger)), "right") - 1
    start = np.flatnonzero(np.arange(len(trigger)) + span <= offsets[row_of + 1])  # windows inside one row
    if not len(start):
        return nothing
    t = trigger[start]
    new = np.ones(len(start), bool)
    new[1:] = (t[1:] != t[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    s0, s1 = start[first], start[np.append(first[1:], len(start)) - 1]
    t = t[first]
    key = span_hash(p, t, t + gram)
    with np.errstate(over="ignore"):
        whole = mix(span_hash(p, s0, s1 + span) + (t - s0).astype(U64) * U64(0x8EBC6AF09C88C6E3))
    row = row_of[s0]
    return row, s0 - offsets[row], s1 - offsets[row], t - offsets[row], key, whole


def parse(data: np.ndarray, offsets: np.ndarray, span: int):
    """phrases() of all rows, a bounded part of the bytes at a time: a phrase may end where such a part ends."""
    out = []
    for lo, hi in slices(offsets):
        begin, end = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or end - begin <= SLICE_BYTES + span:
            row, *rest = phrases(data[begin:end], offsets[lo : hi + 1] - begin, span)
            out.append((row + lo, *rest))
            continue
        for at in range(begin, end, SLICE_BYTES):
            to = min(end, at + SLICE_BYTES + span - 1)
            row, s0, s1, t, *rest = phrases(data[at:to], np.array([0, to - at]), span)
            out.append((row + lo, s0 + at - begin, s1 + at - begin, t + at - begin, *rest))
    if not out:
        return phrases(data[:0], np.zeros(1, np.int64), span)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# ---------------------------------------------------------------- blocks


def _blocks(batches):
    """(number, rows) of blocks of the rows of a partition; the text is the first column."""
    from pyspark import TaskContext

    block, held, size, rows = TaskContext.get().partitionId() << 32, [], 0, 0
    for b in batches:
        _, offsets = text_bytes(b.column(0))
        for lo, hi in slices(offsets, BLOCK_BYTES):
            for i in range(lo, hi, BLOCK_ROWS):
                j = min(hi, i + BLOCK_ROWS)
                more = int(offsets[j] - offsets[i])
                if held and (size + more > BLOCK_BYTES or rows + j - i > BLOCK_ROWS):
                    yield block, pa.Table.from_batches(held).combine_chunks()
                    block, held, size, rows = block + 1, [], 0, 0
                held.append(b.slice(i, j - i))
                size, rows = size + more, rows + j - i
    if held:
        yield block, pa.Table.from_batches(held).combine_chunks()


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, which are null) of a block's texts."""
    length = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(np.maximum(length, 0))))
    data = pa.decompress(row["texts"], int(offsets[-1]), "zstd", asbytes=True) if offsets[-1] else b""
    return np.frombuffer(data, np.uint8), offsets, length < 0


def _table(columns, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(columns) or [[]] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _request_kernel(span, fragments, bits):
    def run(batches):
        for block, rows in _blocks(batches):
            text = rows.column(0)
            data, offsets = text_bytes(text)
            length = np.where(text.is_null().to_numpy(), -1, np.diff(offsets))
            keys, count = np.unique(parse(data, offsets, span)[4] >> U64(64 - bits), return_counts=True)
            cut = np.concatenate(([0], np.searchsorted(keys, np.array([-(-(f << bits) // fragments) for f in range(1, fragments)], U64)), [len(keys)])).tolist()
            out = []
            names_in = scattered(block, fragments)
            for f in range(fragments):
                i, j = cut[f], cut[f + 1]
                own = (_ipc(rows.drop_columns(rows.column_names[0])), length.astype("<i4").tobytes(), squeeze(data.tobytes())) if f == names_in else (None,) * 3
                if i < j or own[0] is not None:
                    out.append((f, block, pack_sorted(keys[i:j]), np.packbits(count[i:j] > 1).tobytes(), *own))
            yield from _table(zip(*out, strict=True), REQUEST).to_batches()

    return run


def _fragment_kernel(table: pa.Table) -> pa.Table:
    """Which of the blocks' trigger grams in a fragment occur more than once."""
    table = table.combine_chunks()
    keys = [unpack_sorted(x.as_buffer()) for x in table.column("keys")]
    every = np.concatenate(keys)
    live = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(k)).astype(bool) for x, k in zip(table.column("several"), keys, strict=True)])
    order = np.argsort(every, kind="stable")
    twice = every[order][1:] == every[order][:-1]
    live[order[1:][twice]] = live[order[:-1][twice]] = True
    at = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).tolist()
    bits = [np.packbits(live[i:j]).tobytes() for i, j in zip(at, at[1:], strict=False)]
    return pa.table([table.column("block"), table.column("fragment"), pa.array([len(k) for k in keys], pa.int32()), pa.array(bits, pa.binary()), *(table.column(c) for c in ("carry", "lengths", "texts"))], [x.split()[0] for x in REPLY.split(", ")])


def _live_kernel(span, bits):
    def run(table: pa.Table) -> pa.Table:
        """A block's phrases whose trigger gram occurs more than once."""
        table = table.combine_chunks().sort_by("fragment")
        live = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n).astype(bool) for x, n in zip(table.column("live"), table.column("n").to_pylist(), strict=True)])
        named = table.filter(table.column("lengths").is_valid()).select(["block", "carry", "lengths", "texts"]).slice(0, 1)
        data, offsets, _ = _texts(named.to_pylist()[0])
        row, s0, s1, t, key, whole = parse(data, offsets, span)
        short = key >> U64(64 - bits)
        some = live[np.searchsorted(np.unique(short), short)] if len(short) else np.zeros(0, bool)
        fields = [pa.array(x[some].astype(np.int32)) for x in (row, s0, s1, t)] + [pa.array(i64(x[some])) for x in (key, whole)]
        struct = pa.StructArray.from_arrays(fields, ["row", "s0", "s1", "t", "trigger", "phrase"])
        return named.append_column("phrases", pa.ListArray.from_arrays(pa.array([0, len(struct)], pa.int32()), struct))

    return run


# ---------------------------------------------------------------- borders


def _border_kernel(span):
    def run(left: pa.Table, texts: pa.Table) -> pa.Table:
        """The bytes of a block's border phrases; the suffixes' fingerprints of those whose gram has too many phrases."""
        if not left.num_rows or not texts.num_rows:
            return _table([], BORDER)
        data, offsets, _ = _texts(texts.to_pylist()[0])
        block = texts.column("block")[0].as_py()
        out = []
        for r in left.to_pylist():
            base = int(offsets[r["row"]])
            part = data[base + r["s0"] : base + r["s1"] + span]
            if not r["hot"]:
                out.append((r["trigger"], part.tobytes(), r["t"] - r["s0"], None, block, r["row"], r["s0"], r["s1"], r["once"]))
                continue
            at = np.arange(len(part) - span + 1)
            for k, h in enumerate(i64(span_hash(prefix_hash(part), at, at + span)).tolist()):
                out.append((r["trigger"], None, None, h, block, r["row"], r["s0"] + k, r["s0"] + k, r["once"]))
        return _table(zip(*out, strict=True), BORDER)

    return run


def repeated_suffixes(trigger: np.ndarray, data: np.ndarray, offsets: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases (bytes, trigger gram, its place): of each phrase's windows, (phrase, window, whether an equal one exists).

    Sorts the suffixes by (trigger gram, distance from it, span bytes): a suffix array cut at span bytes.
    """
    n = np.diff(offsets) - span + 1
    phrase = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
    record = np.empty((len(phrase), 10 + span), np.uint8)
    record[:, :8] = trigger.astype(">i8")[phrase].view(np.uint8).reshape(-1, 8)
    record[:, 8:10] = (at[phrase] - window).astype(">i2").view(np.uint8).reshape(-1, 2)
    record[:, 10:] = np.lib.stride_tricks.sliding_window_view(data, span)[offsets[phrase] + window]
    order = np.argsort(record.view(f"S{10 + span}").ravel(), kind="stable")
    record = record[order]
    equal = (record[1:] == record[:-1]).all(1)
    found = np.zeros(len(phrase), bool)
    found[order[1:][equal]] = found[order[:-1][equal]] = True
    return phrase, window, found


def _suffix_array_kernel(span):
    def run(batches):
        held, count = [], 0

        def sort(table):
            data, offsets = text_bytes(table.column("bytes"))
            phrase, window, found = repeated_suffixes(table.column("trigger").to_numpy(), data, offsets, table.column("at").to_numpy(), span)
            found &= np.array(table.column("once").to_pylist(), bool)[phrase]
            begin, end = found.copy(), found.copy()
            begin[1:] &= ~(found[:-1] & (phrase[1:] == phrase[:-1]))
            end[:-1] &= ~(found[1:] & (phrase[1:] == phrase[:-1]))
            at = phrase[begin]
            block, row, s0 = (table.column(c).to_numpy()[at] for c in ("block", "row", "s0"))
            yield from _table((block, row, s0 + window[begin].astype(np.int32), s0 + window[end].astype(np.int32)), RUNS).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            count += int(text_bytes(b.column(1))[1][-1]) - (span - 1) * b.num_rows
            if count < SORTED:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            whole = int(np.searchsorted(table.column("trigger").to_numpy(), table.column("trigger")[-1].as_py()))
            if whole:
                yield from sort(table.slice(0, whole).combine_chunks())
                held = table.slice(whole).to_batches()
                count = sum(int(text_bytes(x.column(1))[1][-1]) - (span - 1) * x.num_rows for x in held)
        if held:
            yield from sort(pa.Table.from_batches(held).combine_chunks())

    return run


# ---------------------------------------------------------------- results


def covered(s0: np.ndarray, s1: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Maximal runs covered by the windows s0..s1 of each pair."""
    out: list[list[int]] = []
    for a, b in sorted(zip(s0.tolist(), (s1 + span).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cuts(found: pa.Table, rows: int, span: int) -> list[list[tuple[int, int]]]:
    row, s0, s1 = (found.column(c).to_numpy() for c in ("row", "s0", "s1"))
    order = np.argsort(row, kind="stable")
    at = np.searchsorted(row[order], np.arange(rows + 1)).tolist()
    return [covered(s0[order[i:j]], s1[order[i:j]], span) if i < j else [] for i, j in zip(at, at[1:], strict=False)]


def _digest_kernel(span):
    def run(found: pa.Table, block: pa.Table) -> pa.Table:
        named = block.to_pylist()[0]
        data, offsets, _ = _texts(named)
        ids = pa.ipc.open_stream(named["carry"]).read_all().column(0)
        out = []
        for k, cut in enumerate(_cuts(found, len(ids), span)):
            raw, kept, at = data[offsets[k] : offsets[k + 1]], hashlib.sha256(), 0
            for x, y in cut:
                kept.update(raw[at:x])
                at = y
            kept.update(raw[at:])
            out.append((len(raw), sum(y - x for x, y in cut), len(cut), kept.hexdigest()))
        columns = list(zip(*out, strict=True))
        return pa.table([ids, *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _cut_kernel(span, at, names):
    """The texts without their repeated spans; bytes that no longer form a character are dropped."""

    def run(found: pa.Table, block: pa.Table) -> pa.Table:
        named = block.to_pylist()[0]
        data, offsets, null = _texts(named)
        carry = pa.ipc.open_stream(named["carry"]).read_all()
        texts = []
        for k, cut in enumerate(_cuts(found, len(null), span)):
            raw, parts, i = data[offsets[k] : offsets[k + 1]], [], 0
            for x, y in cut:
                parts.append(raw[i:x].tobytes())
                i = y
            texts.append(None if null[k] else b"".join([*parts, raw[i:].tobytes()]).decode("utf-8", "ignore"))
        columns = carry.columns[:-1]  # the last one is only there so that some is
        return pa.table([*columns[:at], pa.array(texts, pa.string()), *columns[at:]], names)

    return run


def repeated_windows(scratch: Scratch, docs: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """(blocks of the rows of docs, whose first column is the text; runs s0..s1 of starts of repeated windows in them)."""
    if span < 4:
        raise ValueError("span must be at least 4 bytes")
    size = docs.agg(F.sum(F.octet_length(docs.columns[0]))).first()[0] or 0
    fragments, bits = max(1, -(-size // FRAGMENT_BYTES)), min(60, size.bit_length() + 5)
    asked = docs.mapInArrow(over_batches(_request_kernel(span, fragments, bits)), REQUEST)
    told = asked.groupBy("fragment").applyInArrow(over_group(_fragment_kernel), REPLY)
    blocks = scratch.keep(told.groupBy("block").applyInArrow(over_group(_live_kernel(span, bits)), BLOCK))
    asked = told = None  # their shuffles are read
    release_shuffles(docs.sparkSession)
    live = blocks.select("block", F.explode("phrases").alias("p")).select("block", "p.*")
    dictionary = scratch.keep(live.groupBy("phrase").agg(F.count("*").alias("n"), F.min("trigger").alias("trigger"), F.min(F.struct("block", "row", "s0", "s1", "t")).alias("one")))
    whole = live.join(dictionary.filter("n >= 2").select("phrase").hint("merge"), "phrase", "left_semi").select("block", "row", "s0", "s1")
    shared = dictionary.groupBy("trigger").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m >= 2 and least = 1").select("trigger", (F.col("m") > BUCKET).alias("hot"))
    left = dictionary.join(shared.hint("merge"), "trigger").select("trigger", "hot", "one.*", (F.col("n") == 1).alias("once"))
    border = left.groupBy("block").cogroup(blocks.select("block", "lengths", "texts").groupBy("block")).applyInArrow(over_cogroup(_border_kernel(span)), BORDER)
    border, left = scratch.keep(border), None
    release_shuffles(docs.sparkSession)
    sorted_ = border.filter("bytes is not null").select("trigger", "bytes", "at", "block", "row", "s0", "once").repartition("trigger").sortWithinPartitions("trigger").mapInArrow(over_batches(_suffix_array_kernel(span)), RUNS)
    suffixes = border.filter("bytes is null")
    equal = suffixes.groupBy("suffix").agg(F.count("*").alias("n")).filter("n >= 2").select("suffix")
    dealt = suffixes.filter("once").join(equal, "suffix", "left_semi").select("block", "row", "s0", "s1")
    found = scratch.keep(whole.union(sorted_).union(dealt))
    scratch.drop(dictionary)
    scratch.drop(border)
    return blocks.select("block", "carry", "lengths", "texts"), found


def suffix_dedup(docs: DataFrame, *, span: int = 200, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    blocks, found = repeated_windows(scratch, docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id")), span)
    return found.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(over_cogroup(_digest_kernel(span)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, span: int = 200, text: str = "text") -> DataFrame:
    """docs with repeated spans cut from their texts; other columns as they are."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    at = docs.columns.index(text)
    named = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    order = [f"c{at}"] + [f"c{k}" for k in range(len(docs.columns)) if k != at]
    blocks, found = repeated_windows(scratch, named.select(*order, F.lit(True).alias("row")), span)
    out = found.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(over_cogroup(_cut_kernel(span, at, named.columns)), named.schema)
    return out.toDF(*docs.columns)
