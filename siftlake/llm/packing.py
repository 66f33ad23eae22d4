"""Packing of token sequences: bounded-space online best fit.

Each partition keeps a fixed number of open windows of ``size`` tokens.  A
document is cut into full windows and a rest; the rest goes into the open
window that it leaves the least room in (best fit).  When none fits, the
fullest window is topped up with the head of the rest and emitted, and what
remains is placed again.  At the end of a partition the open windows are
merged into full ones; fewer than ``size`` tokens are left, cut at powers of
two, which need no padding.  No shuffle is needed: a lost task repeats from
its input and gives the same windows again.

Token ids are those of the tokenizer file (byte-level BPE); its special tokens,
where a text spells one out, are that one id, as the library has it.  Texts are
cut before each space that precedes a solid character, where no token can
cross, and the ids of the distinct parts are cached; parts that are not in the
cache are encoded with the same vocabulary and merge ranks.

Defined results: null or empty text is the end id alone; rows that repeat a
doc_id are packed one by one; a null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, prefix_hash, ship, slices, span_hash, text_bytes

#: Characters of a byte-level vocabulary that stand for themselves.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts of text whose ids a worker remembers at most; how many the small level of its index holds.
CACHE, MERGE = 2_000_000, 100_000
#: Bytes before which a space begins a token: solid ASCII and leads of characters that are never white space.
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = SOLID[0xC3:0xF5] = True
SOLID[[0xE1, 0xE2, 0xE3]] = False
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_ranks(path: str) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """Token bytes to id, from a byte-level BPE file in JSON (ids are merge ranks there), and the special tokens."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    odd = [b for b in range(256) if b not in set(_PLAIN)]
    of = {chr(b): b for b in _PLAIN} | {chr(256 + k): b for k, b in enumerate(odd)}
    special = {x["content"]: x["id"] for x in whole.get("added_tokens", []) if x["special"]}
    vocabulary = whole["model"]["vocab"]
    return {bytes(of[c] for c in t): i for t, i in vocabulary.items() if t not in special and all(c in of for c in t)}, {t.encode(): i for t, i in special.items()}


class PartCache:
    """Ids of the distinct parts of texts, by fingerprint; subclasses encode those not yet known."""

    def room(self) -> None:
        if self.parts > CACHE:
            self.clear()

    def clear(self) -> None:
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]  # sorted fingerprints, place in ids
        self.ids, self.filled = np.zeros(1 << 16, "<u4"), 0
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.parts = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        for keys, place in self.levels:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                out = np.where(keys[at] == h, place[at], out)
        return out

    def learn(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Remember parts with fingerprints h (sorted), their ids back to back."""
        n = len(h)
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.parts + n > len(self.first):
            self.first, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.count))
        self.ids[self.filled : self.filled + len(ids)] = ids
        place = np.arange(self.parts, self.parts + n)
        self.first[place] = self.filled + np.cumsum(counts) - counts
        self.count[place] = counts
        self.filled += len(ids)
        self.parts += n
        small = len(self.levels[1][0]) + n < MERGE
        held = self.levels[1:] if small else self.levels
        keys, places = np.concatenate([x[0] for x in held] + [h]), np.concatenate([x[1] for x in held] + [place])
        order = np.argsort(keys, kind="stable")
        merged = (keys[order], places[order])
        self.levels = [self.levels[0], merged] if small else [merged, (keys[:0], places[:0])]
        return place

    def gather(self, h, start, end, data, offsets, **more) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows back to back, their offsets); h: the fingerprints of the parts start..end."""
        h, where, back = np.unique(h, return_index=True, return_inverse=True)
        place = self.find(h)
        new = place < 0
        if new.any():
            some = where[new]
            ids, counts = self.encode(data, start[some], end[some], **{k: v[some] for k, v in more.items()})
            place[new] = self.learn(h[new], ids, counts)
        place = place[back]
        counts = self.count[place]
        upto = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.arange(upto[-1]) + np.repeat(self.first[place] - upto[:-1], counts)]
        return ids, upto[np.searchsorted(start, offsets)]


class Encoder(PartCache):
    """Texts -> ids, a slice of documents at a time.

    The distinct parts of a slice are found by their fingerprints; those not
    yet in the cache are encoded in one call and cut apart by token lengths.
    """

    def __init__(self, path: str):
        import tiktoken

        ranks, self.special = byte_ranks(path)
        self.find_special = re.compile(b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or b"(?!)")
        self.plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self.clear()

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts of data, back to back, and how many each has; parts that stand apart are encoded alone."""
        raw = data.tobytes()
        parts = [raw[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]
        inner = np.array([x[:1] == b" " for x in parts], bool) & ~apart
        ids = [None] * len(parts)
        joined = b"".join(x for x, k in zip(parts, inner, strict=True) if k)
        if joined:
            got = np.array(self.plain.encode_ordinary(joined.decode()), "<u4")
            upto = np.concatenate(([0], np.cumsum(self.width[got])))
            cut = np.searchsorted(upto, np.concatenate(([0], np.cumsum((end - start)[inner]))))
            for k, i, j in zip(np.flatnonzero(inner).tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                ids[k] = got[i:j]
        for k in np.flatnonzero(~inner).tolist():
            ids[k] = np.array([self.special[parts[k]]] if parts[k] in self.special else self.plain.encode_ordinary(parts[k].decode()), "<u4")
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows back to back, their offsets)."""
        self.room()
        following = np.zeros(len(data), bool)
        following[:-1] = SOLID[data[1:]]
        cut = (data == 32) & following
        inside = offsets[:-1][np.diff(offsets) > 0]
        cut[inside] = True
        last = offsets[1:][np.diff(offsets) > 0] - 1  # the next byte is another row's
        cut[last[~np.isin(last, inside)]] = False
        apart = np.zeros(len(data), bool)
        for row, spans in self.specials(data, offsets):  # such a row is cut there and nowhere else
            lo, hi = int(offsets[row]), int(offsets[row + 1])
            cut[lo:hi], apart[lo:hi] = False, True
            cut[[lo, *(x for i, j in spans for x in (i, j) if x < hi)]] = True
        start = np.flatnonzero(cut)
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        end = np.append(start[1:], len(data))
        return self.gather(span_hash(prefix_hash(data), start, end), start, end, data, offsets, apart=apart[start])

    def specials(self, data: np.ndarray, offsets: np.ndarray):
        """(row, spans) of the rows that spell a special token out."""
        spans: dict[int, list[tuple[int, int]]] = {}
        for m in self.find_special.finditer(data.tobytes()):
            row = int(np.searchsorted(offsets, m.start(), "right")) - 1
            if m.end() <= offsets[row + 1]:
                spans.setdefault(row, []).append(m.span())
        return spans.items()


class Windows:
    """Open windows of one partition; rows() gives the pieces of those emitted."""

    def __init__(self, size: int, open_windows: int, first_id: int):
        self.size, self.most, self.next = size, open_windows, first_id
        self.open: list[list] = []  # [used, pieces]; a piece is (doc_id, start, ids, doc_tokens)
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        total, whole = len(ids) // 4, len(ids) // 4 // self.size * self.size
        for start in range(0, whole, self.size):
            self.emit([(doc, start, ids[4 * start : 4 * (start + self.size)], total)])
        if whole < total:
            self.place((doc, whole, ids[4 * whole :], total))

    def place(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        fits = [w for w in self.open if w[0] + n <= self.size]
        if not fits and len(self.open) >= self.most:
            full = max(self.open, key=lambda w: w[0])
            self.open.remove(full)
            head, piece = self.cut(piece, self.size - full[0])
            self.emit([*full[1], head])
            n = len(piece[2]) // 4
            fits = [w for w in self.open if w[0] + n <= self.size]
        if fits:
            best = max(fits, key=lambda w: w[0])
        else:
            self.open.append(best := [0, []])
        best[0] += n
        best[1].append(piece)
        if best[0] == self.size:
            self.open.remove(best)
            self.emit(best[1])

    @staticmethod
    def cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc, start, ids, total = piece
        return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total)

    def merge(self) -> None:
        """Leftovers into full windows, then into windows of powers of two."""
        left = [p for _, pieces in self.open for p in pieces]
        room, now = 0, []
        tokens = sum(len(p[2]) // 4 for p in left)
        self.open = []
        while left:
            if room == 0:
                room = self.size if tokens >= self.size else 1 << (tokens.bit_length() - 1)
                tokens -= room
            piece = left.pop(0)
            n = len(piece[2]) // 4
            if n > room:
                head, rest = self.cut(piece, room)
                left.insert(0, rest)
                piece, n = head, room
            now.append(piece)
            room -= n
            if room == 0:
                self.emit(now)
                now = []


def _kernel(path, size, open_windows, end_id):
    def run(batches):
        from pyspark import TaskContext

        encode, end = Encoder(path), end_id.to_bytes(4, "little")
        windows = Windows(size, open_windows, TaskContext.get().partitionId() << 36)
        names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]

        def flush():
            columns = list(zip(*windows.rows, strict=True)) or [[]] * len(names)
            windows.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for b in batches:
            data, offsets = text_bytes(b.column(1))
            docs = b.column(0).to_pylist()
            for lo, hi in slices(offsets):
                ids, at = encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                raw, at = ids.tobytes(), (4 * at).tolist()
                for k in range(hi - lo):
                    windows.add(docs[lo + k], raw[at[k] : at[k + 1]] + end)
                if len(windows.rows) > 20_000:
                    yield flush()
        windows.merge()
        yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, *, size: int = 1024, open_windows: int = 32, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sequence_id is the partition's number shifted, plus the window's; the
    tokenizer's file must exist on every worker.
    """
    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(over_batches(_kernel(tokenizer, size, open_windows, end_id)), PIECE_SCHEMA)
