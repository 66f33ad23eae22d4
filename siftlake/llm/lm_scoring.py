"""Interpolated modified Kneser-Ney n-gram scoring.

Documents are dealt into blocks of bounded size by a hash; n-gram fingerprints
into shards by their value.

1. Counting, for each order from the highest down.  Every block of training
   documents sends each shard its distinct n-grams, sorted, with its own
   contribution to their counts (tokens at the highest order, below it the
   distinct longer n-grams that the block answers for).  A shard adds them up
   into sorted hash arrays - the keys, their adjusted counts, their totals as a
   context - which it stores as a file in the shared folder: the model; a block
   is told the counts of its n-grams and which of them it answers for.
2. Looking up.  Every block of all documents sends each shard its distinct
   n-grams (of words one order after the other); a worker maps the shard's file into memory (reads it,
   where the shared folder is not mounted) and searches the keys there.
3. Scoring.  Every block meets its answers and scores its documents token by
   token, so that no task ever holds the model and nothing of it passes through
   the driver but the counts of counts.

What is exchanged grows with the distinct n-grams of the blocks.

Text is lower-cased (A-Z); tokens are words (runs without ASCII space) and one
end token; histories are padded with start marks.  Discounts follow Chen and
Goodman from the counts of counts of each order; the lowest order is
interpolated with the uniform distribution over the training vocabulary and one
unknown token.

Defined results: null text counts as empty (its end token is scored); rows that
repeat an id count and are scored one by one; a null id is scored and learned
from; without training tokens every token has probability 1 (score 0); extra
columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SLICE_BYTES, U64, Scratch, crc_fold, long_cuts, mix, over_batches, over_cogroup, over_group, pack_sorted, prefix_hash, release_shuffles, slices, span_hash, squeeze, text_bytes, unpack_sorted, words

#: Bytes of text in a block.
BLOCK_BYTES = 6 << 20
#: Bytes of text that are packed at once on their way to the blocks.
PACK_BYTES = 8 << 20
#: Tokens whose probabilities are worked out at once.
STRIP = 1 << 18
#: Tokens with a meaning of their own.
END, START = U64(0x1F83D9ABFB41BD6B), U64(0x5BE0CD19137E2179)


# ---------------------------------------------------------------- blocks


def tokens(column, unit: str = "word") -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of all rows' tokens back to back, offsets); each row ends with END.

    Words are lower-cased (A-Z); characters are taken as they are.
    """
    data, offsets = text_bytes(column)
    if unit == "character":
        first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        n = np.diff(first[offsets])
        out = np.full(len(code) + len(n), END)
        out[np.arange(len(code)) + np.repeat(np.arange(len(n)), n)] = mix(code.astype(U64) + U64(1))
        return out, np.concatenate(([0], np.cumsum(n + 1)))
    parts, counts = [], []
    for lo, hi in slices(offsets):
        if hi - lo == 1 and offsets[hi] - offsets[lo] > SLICE_BYTES:  # a long text, part by part
            cut = long_cuts(data, int(offsets[lo]), int(offsets[hi]))
            some = [tokens(pa.array([data[i:j].tobytes()], pa.binary()))[0][:-1] for i, j in zip(cut, cut[1:], strict=False)] if len(cut) > 2 else None
            if some:
                parts += [*some, np.array([END])]
                counts.append(np.array([sum(map(len, some)) + 1]))
                continue
        part, at = LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        start, end, row = words(part, at)
        n = np.bincount(row, minlength=hi - lo)
        out = np.full(len(start) + hi - lo, END)
        out[np.arange(len(start)) + row] = span_hash(prefix_hash(part), start, end)
        parts.append(out)
        counts.append(n + 1)
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.concatenate(([0], np.cumsum(count)))


def padded(level: int) -> np.uint64:
    """Fingerprint of the history of ``level`` start marks."""
    return mix(np.array([START + U64(level)], U64))[0]


def _longer(h: np.ndarray, token: np.ndarray, level: int) -> np.ndarray:
    """Fingerprints of n-grams of a level from those of their histories and last tokens."""
    with np.errstate(over="ignore"):
        return mix(h * U64(0xD1342543DE82EF95) + token + U64(level))


class Coded:
    """A block's n-grams of a level: its sorted distinct keys, and the place of each token's n-gram among them (``at``).

    Below the highest level the start history is one of the keys, and ``before``
    is the place of the n-gram that ends before each token.
    """

    def __init__(self, code: np.ndarray, found: np.ndarray, offsets: np.ndarray, level: int, order: int):
        """code: which of the fingerprints ``found`` each token's n-gram is."""
        if level < order:
            start = padded(level)
            where = np.flatnonzero(found == start)
            extra = int(where[0]) if len(where) else len(found)
            found = found if len(where) else np.append(found, start)
        by = np.argsort(found)
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        self.keys, self.at = found[by], place[code]
        if level < order:
            self.before = np.empty_like(self.at)
            self.before[1:] = self.at[:-1]
            self.before[offsets[:-1]] = place[extra]

    def first(self) -> np.ndarray:
        """Where each key stands first in the text (for the start history: past its end)."""
        out = np.full(len(self.keys), len(self.at))
        out[self.at[::-1]] = np.arange(len(self.at))[::-1]
        return out


def levels(token: np.ndarray, offsets: np.ndarray, order: int, upto: int):
    """Coded of each level from 1 to upto; fingerprints are made of distinct n-grams only."""
    last, words_ = pd.factorize(token)
    own = Coded(last, words_, offsets, 1, order)
    yield own
    for level in range(2, upto + 1):
        code, pairs = pd.factorize(own.before.astype(np.int64) * len(words_) + last)
        history, word = np.divmod(pairs, len(words_))
        own = Coded(code, _longer(own.keys[history], words_[word], level), offsets, level, order)
        yield own


# ---------------------------------------------------------------- coding


def pack_counts(c: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them; nothing if all are 0."""
    if not len(c) or not c.any():
        return b""
    for kind in (np.uint8, np.uint16, np.uint32, np.uint64):
        if c.max() <= np.iinfo(kind).max:
            return bytes([np.dtype(kind).itemsize]) + c.astype(kind).tobytes()
    raise OverflowError


def unpack_counts(raw, n: int) -> np.ndarray:
    if raw is None or not len(raw):
        return np.zeros(n, np.int64)
    raw = np.frombuffer(raw, np.uint8)
    return raw[1:].view(f"<u{raw[0]}").astype(np.int64)


def buffers(column) -> list:
    """The bytes of a binary column's values, not copied."""
    return [x.as_buffer() for x in column]


def _shards(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys begin in the sorted keys."""
    with np.errstate(over="ignore"):
        at = np.array([k * (1 << 64) // shards for k in range(1, shards)], dtype=U64)
    return np.concatenate(([0], np.searchsorted(keys, at), [len(keys)]))


#: Contributions and answers of a key: count, context totals (n1, n2, n3+, sum), raw training count.
FIELDS = ("n", "x1", "x2", "x3", "xs", "raw")


def _request(level, order, shards):
    """Block -> rows for the shards of a level, from the block's training documents."""

    def rows(block, token, offsets, answer):
        own = longer = None
        for k, x in enumerate(levels(token, offsets, order, min(level + 1, order)), 1):
            own, longer = (x, longer) if k == level else (own, x if k > level else None)
        keys = own.keys
        got = {f: np.zeros(len(keys), np.int64) for f in FIELDS}
        if level == 1:
            got["raw"] = np.bincount(own.at, minlength=len(keys))
        if level == order:
            got["n"] = np.bincount(own.at, minlength=len(keys))
        else:
            where = longer.first()
            some = answer["own"] & (where < len(token))
            count, where = answer["n"][some], where[some]
            got["n"] = np.bincount(own.at[where], minlength=len(keys))
            context = own.before[where]
            for f, some in (("x1", count == 1), ("x2", count == 2), ("x3", count >= 3)):
                got[f] = np.bincount(context[some], minlength=len(keys))
            got["xs"] = np.bincount(context, count, len(keys)).astype(np.int64)
        cut = _shards(keys, shards)
        return [(block, k, pack_sorted(keys[a:b]), *(pack_counts(got[f][a:b]) for f in FIELDS)) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]

    return rows


COUNTS = ", ".join(f"{f} binary" for f in FIELDS)
REQUEST = f"block int, shard int, keys binary, {COUNTS}"
#: What a shard stored (block -1: size and totals) and its answers to the training blocks (counts and ownership).
COUNTED = f"block int, shard int, size int, own binary, {COUNTS}, totals array<long>"
ASK = "block int, level int, shard int, keys binary"
FOUND = f"block int, level int, shard int, size int, {COUNTS}"


def _joined(table: pa.Table, fields, own: bool = False) -> dict[str, np.ndarray]:
    """The shards' answers to a block, put together in the order of its keys."""
    size, held = table.column("size").to_pylist(), {f: buffers(table.column(f)) for f in (*fields, *(["own"] if own else []))}
    rows = np.argsort(table.column("shard").to_numpy(), kind="stable").tolist()
    out = {f: np.concatenate([unpack_counts(held[f][k], size[k]) for k in rows] or [np.zeros(0, np.int64)]) for f in fields}
    if own:
        out["own"] = np.concatenate([np.unpackbits(np.frombuffer(held["own"][k], np.uint8), count=size[k]).astype(bool) for k in rows] or [np.zeros(0, bool)])
    return out


PACKED = "block int, ids array<long>, tags array<string>, train binary, real binary, sizes array<int>, raw_bytes long, texts binary"


def _pack_kernel(batches):
    """Rows -> one compressed row for each block in a slice, so that little of the text is moved."""
    names = [x.split()[0] for x in PACKED.split(", ")]
    for b in batches:
        data, offsets = text_bytes(b.column("text"))
        block = b.column("block").to_numpy()
        train, real = (np.array(b.column(c).to_pylist(), np.uint8) for c in ("train", "real"))
        for lo, hi in slices(offsets, PACK_BYTES):
            out = []
            for k in np.unique(block[lo:hi]).tolist():
                at = lo + np.flatnonzero(block[lo:hi] == k)
                text = b"".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in at.tolist())
                take = pa.array(at)
                out.append((k, b.column("doc_id").take(take).to_pylist(), b.column("tag").take(take).to_pylist(), train[at].tobytes(), real[at].tobytes(), np.diff(offsets)[at].tolist(), len(text), squeeze(text)))
            kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _unpack(table: pa.Table) -> pa.Table:
    """A block's rows, ordered so that a repeated task sees them alike."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["raw_bytes"], zlib.crc32(r["texts"]), str(r["ids"])))
    sizes = np.concatenate([r["sizes"] for r in rows] or [[]]).astype(np.int64)
    text = b"".join(pa.decompress(r["texts"], r["raw_bytes"], "zstd", asbytes=True) if r["texts"] else b"" for r in rows)
    texts = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes)))), pa.py_buffer(text)])
    flags = {c: np.frombuffer(b"".join(r[c] for r in rows), np.uint8).astype(bool) for c in ("train", "real")}
    block = np.full(len(sizes), rows[0]["block"] if rows else 0, np.int32)
    return pa.table({"block": block, "doc_id": pa.array([x for r in rows for x in r["ids"]], pa.int64()), "tag": pa.array([x for r in rows for x in r["tags"]], pa.string()), "train": pa.array(flags["train"]), "real": pa.array(flags["real"]), "text": texts})


def _marked(table: pa.Table, trusted: bool) -> tuple[pa.Table, np.ndarray]:
    """The documents of a block, and which of them to learn from; if only some are trusted, rows without a document name their ids."""
    table = _unpack(table)
    real, train = (np.array(table.column(c).to_pylist(), bool) for c in ("real", "train"))
    if trusted:
        ids = np.array([x if x is not None else -1 for x in table.column("doc_id").to_pylist()], np.int64)
        train = train & np.isin(ids, ids[~real])
        table = table.filter(pa.array(real))
    return table, train[real]


def _trusted_kernel(table: pa.Table) -> pa.Table:
    """The training documents of a block, packed again."""
    docs, train = _marked(table, True)
    batches = docs.filter(pa.array(train)).combine_chunks().to_batches()
    packed = [b for x in batches for b in _pack_kernel([x])]
    return pa.Table.from_batches(packed) if packed else _table([], PACKED)


def _count_kernel(level, order, shards, unit):
    make = _request(level, order, shards)

    def run(docs: pa.Table, got: pa.Table | None = None) -> pa.Table:
        if not docs.num_rows:
            return _table([], REQUEST)
        docs, _ = _marked(docs, False)
        token, offsets = tokens(docs.column("text"), unit)
        return _table(make(docs.column("block")[0].as_py(), token, offsets, None if got is None else _joined(got, ["n"], True)), REQUEST)

    return run


def _ask_kernel(wanted, order, shards, unit, trusted):
    def run(docs: pa.Table) -> pa.Table:
        docs, _ = _marked(docs, trusted)
        if not docs.num_rows:
            return _table([], ASK)
        block = docs.column("block")[0].as_py()
        token, offsets = tokens(docs.column("text"), unit)
        rows = []
        for level, own in enumerate(levels(token, offsets, order, max(wanted)), 1):
            if level not in wanted:
                continue
            keys = own.keys
            cut = _shards(keys, shards)
            rows += [(block, level, k, pack_sorted(keys[a:b])) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
        return _table(rows, ASK)

    return run


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


# ---------------------------------------------------------------- shards


def narrow(c: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type that holds them."""
    return c.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(c) or c.max() <= np.iinfo(k).max))


def store(folder: str, name: str, keys: np.ndarray, totals: dict[str, np.ndarray]) -> None:
    """Sorted hash arrays as an Arrow file in the shared folder; a repeated task writes the same file again."""
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    table = pa.table({"keys": keys, **{f: narrow(v) for f, v in totals.items()}})
    part = f"{root}/{name}.{uuid.uuid4().hex[:8]}.part"
    with files.open_output_stream(part) as out, pa.ipc.new_file(out, table.schema) as writer:
        writer.write_table(table)
    try:
        files.move(part, f"{root}/{name}")
    except OSError:  # some file systems do not move onto a file: then another try of this task was first
        if files.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
            raise
        files.delete_file(part)


def stored(folder: str, name: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The arrays of a stored file: mapped into memory where the folder is mounted, read where it is not."""
    files, root = pafs.FileSystem.from_uri(folder)
    source = pa.memory_map(f"{root}/{name}") if isinstance(files, pafs.LocalFileSystem) else files.open_input_file(f"{root}/{name}")
    table = pa.ipc.open_file(source).read_all()
    return table.column("keys").to_numpy(), {f: table.column(f).to_numpy() for f in table.column_names[1:]}


def _shard_kernel(level, order, folder):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("block")
        keys = [unpack_sorted(x) for x in buffers(table.column("keys"))]
        every = np.concatenate(keys)
        order_of = np.argsort(every, kind="stable")
        new = np.ones(len(every), bool)
        new[1:] = every[order_of[1:]] != every[order_of[:-1]]
        first = np.flatnonzero(new)
        used = ("n", "raw") if level == order == 1 else ("n",) if level == order else FIELDS if level == 1 else FIELDS[:-1]
        totals, owner = {}, np.zeros(len(every), bool)
        for f in used:
            c = np.concatenate([unpack_counts(x, len(k)) for x, k in zip(buffers(table.column(f)), keys, strict=True)])
            totals[f] = np.add.reduceat(c[order_of], first)
            if f == "n":  # the first block with a contribution answers for the key
                place = np.where(c[order_of] > 0, np.arange(len(every)), len(every))
                at = np.minimum.reduceat(place, first)
                owner[order_of[at[at < len(every)]]] = True
        n = totals["n"]
        sums = [int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((n >= 3).sum()), int(n.sum())]
        raw = totals.get("raw", np.zeros(1, np.int64))
        sums += [int(raw.sum()), int((raw > 0).sum())]
        shard = table.column("shard")[0].as_py()
        store(folder, f"{level}-{shard}", every[order_of[first]], totals)
        out: list[tuple] = [(-1, shard, len(first), None, *(b"" for _ in FIELDS), sums)]
        if level > 1:
            place, at = np.empty(len(every), np.int64), 0
            place[order_of] = np.cumsum(new) - 1
            for block, k in zip(table.column("block").to_pylist(), keys, strict=True):
                out.append((block, shard, len(k), np.packbits(owner[at : at + len(k)]).tobytes(), pack_counts(n[place[at : at + len(k)]]), *(b"" for _ in FIELDS[1:]), None))
                at += len(k)
        return _table(out, COUNTED)

    return run


def _look_kernel(folder):
    def run(asked: pa.Table, model: pa.Table) -> pa.Table:
        """The totals of the asking blocks' n-grams; 0 for those the model has not seen."""
        if not asked.num_rows:
            return _table([], FOUND)
        level, shard = asked.column("level")[0].as_py(), asked.column("shard")[0].as_py()
        held, totals = stored(folder, f"{level}-{shard}") if model.num_rows else (np.zeros(0, U64), {})
        out = []
        for block, raw in zip(asked.column("block").to_pylist(), buffers(asked.column("keys")), strict=True):
            keys = unpack_sorted(raw)
            got = dict.fromkeys(FIELDS, b"")
            if len(held):
                at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
                known = held[at] == keys
                got |= {f: pack_counts(np.where(known, v[at], 0)) for f, v in totals.items()}
            out.append((block, level, shard, len(keys), *got.values()))
        return _table(out, FOUND)

    return run


# ---------------------------------------------------------------- scores


def discounts(t: list[int]) -> list[float]:
    """D for counts 0, 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    if not t[0]:
        return [0.0, 0.5, 0.75, 1.0]
    y = t[0] / (t[0] + 2 * t[1])
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * t[k] / t[k - 1] if t[k - 1] else k / 2
        out.append(min(max(d, 0.05), k - 0.05))
    return out


def _score_kernel(order, sums, unit, trusted):
    d = {level: discounts(s[:4]) for level, s in sums.items()}
    one = sums[1]
    total, kinds = one[6], one[7]

    def run(docs: pa.Table, got: pa.Table) -> pa.Table:
        docs, train = _marked(docs, trusted)
        if not docs.num_rows:
            return _table([], SCORED)
        token, offsets = tokens(docs.column("text"), unit)
        at_level = got.column("level").to_numpy()
        p = np.full(len(token), 1.0 / (kinds + 1))
        raw = np.zeros(len(token), np.int64)
        context = before = None
        for level, own in enumerate(levels(token, offsets, order, order), 1):
            a, cut = _joined(got.filter(pa.array(at_level == level)), FIELDS), np.array(d[level])
            for lo in range(0, len(token), STRIP):
                part = slice(lo, lo + STRIP)
                at = own.at[part]
                n = a["n"][at]
                if level == 1:
                    raw[part] = a["raw"][at]
                    den = np.full(len(at), float(one[5]))
                    rest = np.full(len(at), cut[1] * one[0] + cut[2] * one[1] + cut[3] * one[4])
                else:
                    h = before[part]
                    den = context["xs"][h].astype(float)
                    rest = cut[1] * context["x1"][h] + cut[2] * context["x2"][h] + cut[3] * context["x3"][h]
                some = den > 0
                mixed = (np.maximum(n - cut[np.minimum(n, 3)], 0) + rest * p[part]) / np.where(some, den, 1.0)
                p[part] = np.where(some, mixed, p[part])
            if level < order:
                context, before = a, own.before
        base = np.log10((raw + 0.1) / (total + 0.1 * (kinds + 1)))
        first = offsets[:-1]
        sum_of = lambda x: np.add.reduceat(x, first)  # noqa: E731  every row has its end token
        columns = [docs.column("doc_id"), docs.column("tag"), pa.array(train), pa.array(np.diff(offsets)), pa.array(sum_of((raw > 0).astype(np.int64))), pa.array(np.full(len(first), total, np.int64)), pa.array(sum_of(base)), pa.array(sum_of(np.log10(p)))]
        return pa.table(columns, [x.split()[0] for x in SCORED.split(", ")])

    return run


SCORED = "doc_id long, tag string, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, train=None, *, trusted: DataFrame | None = None, order: int = 2, unit: str = "word", tag=None, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES, shard_bytes: int | None = None) -> DataFrame:
    """doc_id, tag, train, n_tokens, n_known, train_tokens, base_score, score of every row.

    train: a Column that is true for the rows to learn from (null: true);
    trusted: a DataFrame whose first column holds the ids to learn from; both
    together: rows in both.  Scores are log10 probabilities of whole texts;
    base_score is the unigram baseline with 0.1 added to each count.  tag: a
    Column to carry along as a string.  docs is read several times and its rows
    are dealt out by their places, so it has to be a table, or a plan whose
    partitions keep their order.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-scoring")
    folder = f"{scratch.path}/model"
    yes, none = F.lit(True), F.lit(None).cast("string")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (none if tag is None else tag.cast("string")).alias("tag"), (yes if train is None else F.coalesce(train, yes)).alias("train"), F.coalesce(F.col(text), F.lit("")).alias("text"), yes.alias("real"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = (max(1, math.ceil(size / n)) for n in (block_bytes, shard_bytes or block_bytes))
    looked = trusted is not None
    # A common text is dealt out by its rows' places; where ids are looked up, rows of one id stay together.
    place = F.monotonically_increasing_id()
    key = ["doc_id", F.when(F.col("doc_id").isNull(), place) if looked else place]
    if looked:
        ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
        base = base.union(ids.select("doc_id", none, F.lit(True), F.lit(""), F.lit(False)))
    base = base.withColumn("block", F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")).select("block", "doc_id", "tag", "train", "real", "text")
    learn = base.filter("train").mapInArrow(over_batches(_pack_kernel), PACKED)
    base = base.mapInArrow(over_batches(_pack_kernel), PACKED)
    if looked:
        learn = scratch.keep(learn.groupBy("block").applyInArrow(over_group(_trusted_kernel), PACKED))
        release_shuffles(spark)
    model: DataFrame | None = None
    answers: DataFrame | None = None
    sums: dict[int, list[int]] = {}
    for level in range(order, 0, -1):
        count = _count_kernel(level, order, shards, unit)
        if answers is None:
            asked = learn.groupBy("block").applyInArrow(over_group(count), REQUEST)
        else:
            asked = learn.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(over_cogroup(count), REQUEST)
        got = scratch.keep(asked.groupBy("shard").applyInArrow(over_group(_shard_kernel(level, order, folder)), COUNTED))
        asked = None
        release_shuffles(spark)
        arrays, answers = got.filter("block < 0"), got.filter("block >= 0").select("block", "shard", "size", "own", "n")
        parts = arrays.select(F.posexplode("totals")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
        sums[level] = [{r.pos: r.n for r in parts}.get(k, 0) for k in range(8)]
        arrays = arrays.select(F.lit(level).alias("level"), "shard")
        model = arrays if model is None else model.union(arrays)
    def look(wanted: list[int]) -> DataFrame:
        asks = base.groupBy("block").applyInArrow(over_group(_ask_kernel(wanted, order, shards, unit, looked)), ASK)
        return asks.groupBy("level", "shard").cogroup(model.filter(F.col("level").isin(wanted)).groupBy("level", "shard")).applyInArrow(over_cogroup(_look_kernel(folder)), FOUND)

    found = None
    for wanted in [list(range(1, order + 1))] if unit == "character" else [[level] for level in range(1, order + 1)]:  # few characters, many words
        part = scratch.keep(look(wanted))
        release_shuffles(spark)
        found = part if found is None else found.union(part)
    return base.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(over_cogroup(_score_kernel(order, sums, unit, looked)), SCORED)


def score_documents(docs: DataFrame, *, folds: int = 10, held: int = 0, order: int = 2, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of every row; learns from rows outside the held-out fold of their id."""
    out = lm_scores(docs, crc_fold(doc_id, folds) != held, order=order, text=text, doc_id=doc_id, block_bytes=block_bytes)
    return out.select("doc_id", (crc_fold("doc_id", folds) == held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
