"""Lengths of texts in sub-words: each word is cut, from the left, into the longest pieces of a stated vocabulary.

A word is a run without white space (space, tab to carriage return) and begins
with one space, as pieces of public vocabularies do.  Pieces are bytes; every
byte that stands in no piece is a piece of its own, so a word is always cut.
The vocabulary is a file of a fixed size that the driver reads: one piece in
base64 and its rank a line.  Its trie, some megabytes, goes to the workers once.

``subword_count`` is a column: nulls and texts without a word have 0, rows and
other columns are not touched.  Words are walked together, a letter of all of
them at a time; in words of over ``LONG`` bytes the longest piece is looked up
at each place, ``SLICE`` places at a time, so a text that is one word is cut in
time that grows with its length.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from siftlake.shipping import ship

#: Where the vocabulary lies unless a caller names another file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of texts that are cut at a time, words and places walked together, bytes from which a word is long.
BYTES, SLICE, LONG = 1 << 21, 1 << 16, 256
#: The most bytes of a vocabulary's pieces: its trie is sent to every worker.
MOST = 1 << 24
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def pieces_of(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a vocabulary file that a word can hold: white space stands at their head only."""
    with open(path, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    return [p for p in pieces if p and not any(b in SPACES for b in p[1:])]


@dataclass
class Trie:
    """Edges (state * 256 + byte, sorted) with the states they lead to; state 0 is the root; ends: whether a piece ends in a state."""

    edges: np.ndarray
    targets: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, pieces: list[bytes]) -> Trie:
        if sum(map(len, pieces)) > MOST:
            raise ValueError(f"a vocabulary has at most {MOST} bytes")
        edge: dict[int, int] = {}
        ends = [False]
        for piece in [*pieces, *(bytes([b]) for b in range(256))]:
            state = 0
            for b in piece:
                if (found := edge.get(state << 8 | b)) is None:
                    found = edge[state << 8 | b] = len(ends)
                    ends.append(False)
                state = found
            ends[state] = True
        keys = np.fromiter(edge.keys(), np.int64, len(edge))
        order = np.argsort(keys)
        return cls(keys[order], np.fromiter(edge.values(), np.int64, len(edge))[order], np.array(ends))

    def longest(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Bytes of the longest piece at each place, none beyond its stop."""
        found = np.ones(len(at), np.int64)
        live, state, depth = np.arange(len(at)), np.zeros(len(at), np.int64), 0
        while len(live):
            inside = at[live] + depth < stop[live]
            live, state = live[inside], state[inside]
            key = state << 8 | data[at[live] + depth]
            place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            known = self.edges[place] == key
            live, state = live[known], self.targets[place[known]]
            depth += 1
            found[live[self.ends[state]]] = depth
        return found

    def cut(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The number of pieces of each word, given by its first byte and the one behind its last."""
        counts = np.zeros(len(starts), np.int64)
        long = stops - starts > LONG
        for k in np.flatnonzero(long):
            at, lo = int(starts[k]), int(starts[k])
            stop = int(stops[k])
            while lo < stop:
                hi = min(lo + SLICE, stop)
                steps = self.longest(data, np.arange(lo, hi), np.full(hi - lo, stop)).tolist()
                while at < hi:
                    at += steps[at - lo]
                    counts[k] += 1
                lo = hi
        short = np.flatnonzero(~long)
        for lo in range(0, len(short), SLICE):
            live = short[lo : lo + SLICE]
            at = starts[live]
            while len(live):
                at = at + self.longest(data, at, stops[live])
                counts[live] += 1
                more = at < stops[live]
                live, at = live[more], at[more]
        return counts

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Pieces of each text; the texts lie in one buffer, each behind a space."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        data = np.insert(data, offsets[:-1], 32)
        offsets = offsets + np.arange(len(offsets))
        space = (data == 32) | ((data >= 9) & (data <= 13))
        data[space] = 32
        last = np.append(space[1:], True)
        starts = np.flatnonzero(space & ~last)
        stops = np.flatnonzero(~space & last) + 1
        counts = self.cut(data, starts, stops)
        return np.bincount(np.searchsorted(offsets, starts, side="right") - 1, counts, len(texts)).astype(np.int64)


def subword_count(spark: SparkSession, text: Column | str, path: str = VOCABULARY) -> Column:
    """The number of sub-words of a text."""
    ship(spark)
    trie = spark.sparkContext.broadcast(Trie.of(pieces_of(path)))

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        texts = texts.fill_null("")
        size = texts.nbytes
        rows = max(1, len(texts) * BYTES // max(size, 1))
        parts = [trie.value.lengths(texts.slice(lo, rows)) for lo in range(0, len(texts), rows)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return count(F.col(text) if isinstance(text, str) else text)
