"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A unigram vocabulary file gives pieces with log scores, which are taken as they
are.  A BPE file gives pieces in the order of their merges and no scores (its
"scores" are negated ranks); as merges are made in falling order of frequency, a
piece of rank r gets the log of Zipf's law, -log(r + 1) - log(sum of 1 / (r + 1)),
so that sums of scores are log-likelihoods of segmentations.  Nothing is trained.

Text gets a leading whitespace marker, spaces become markers; the best segmentation is the one of
the highest sum of scores, found by Viterbi over the pieces that the trie
matches at each character.  A character that no piece covers costs the least
score less 10 and is written as byte pieces (or as the unknown piece if the
vocabulary has none).  Ties go to the segmentation whose last piece starts
first, as in the published implementation; that one adds scores up in single
precision from the start of the whole text, which may decide a tie otherwise.

A marker begins a part of the text unless another marker stands before it; if
no piece holds a marker after another character, no piece crosses a part, so
the distinct parts are segmented once per worker, many at a time, and cached.
Vocabularies that do hold such pieces are segmented text by text.

Decoding joins the pieces' bytes, turns markers into spaces and drops the
leading one.  It restores every text that holds no literal marker character
(U+2581), which comes back as a space.

Defined results: null or empty text has no pieces and decodes to empty text;
repeated rows are encoded one by one; a null doc_id is kept; extra columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, over_batches, prefix_hash, ship, slices, span_hash, text_bytes
from .packing import PartCache

MARK = "▁".encode()
#: Byte length up to which parts are segmented many at a time; how many at once.
TOGETHER, AT_ONCE = 64, 50_000


class DoubleArray:
    """Trie of byte strings: from state s byte b leads to base[s] + b + 1 if check there is s."""

    def __init__(self, keys: dict[bytes, int]):
        root: dict = {}
        for key, value in keys.items():
            node = root
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        size = 1 << 12
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.check[0] = 0
        first, high, queue, free = 1, 1, [(0, root)], self.check < 0
        while queue:
            state, node = queue.pop()
            self.value[state] = node.get(-1, -1)
            codes = np.array(sorted(b for b in node if b >= 0), np.int64) + 1
            if not len(codes):
                continue
            base = max(0, first - int(codes[0]))
            while True:  # the first base at which all codes are free
                while base + 258 + 1024 > len(self.check):
                    self._grow()
                    free = self.check < 0
                fits = np.ones(1024, bool)
                for c in codes.tolist():
                    fits &= free[base + c : base + c + 1024]
                if fits.any():
                    base += int(fits.argmax())
                    break
                base += 1024
            self.base[state] = base
            self.check[base + codes] = state
            free[base + codes] = False
            high = max(high, base + int(codes[-1]))
            if len(codes) > 1:
                first = max(1, high - 4096)
            queue += [(base + c, node[c - 1]) for c in codes.tolist()]
        while int(self.base.max()) + 258 > len(self.check):
            self._grow()

    def _grow(self) -> None:
        n = len(self.base)
        self.base, self.check, self.value = (np.concatenate((x, np.full(n, fill, np.int32))) for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states reached; -1 where there is none."""
        to = self.base[state] + byte.astype(np.int32) + 1
        return np.where(self.check[to] == state, to, -1)


def zipf(score: np.ndarray) -> np.ndarray:
    """Log probabilities by Zipf's law of pieces with negated merge ranks; ranks past 10**8 mark pieces that merges never make."""
    rank = -score.astype(np.float64)
    made = rank < 1e8
    out = -np.log(np.where(made, rank, rank[made].max(initial=0) * 1e6) + 1)
    return (out - np.log(np.exp(out[made]).sum())).astype(np.float32)


class Pieces:
    """A vocabulary: pieces, log scores, byte pieces and the trie."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            kind = sentencepiece_model_pb2.ModelProto.FromString(f.read()).trainer_spec.model_type
        if kind not in (1, 2):
            raise ValueError("the vocabulary must be a unigram or a BPE one")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.score = np.array([sp.get_score(i) for i in range(n)], np.float32)
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if kind == 2:
            self.score[plain] = zipf(self.score[plain])
        self.bytes_of = [b""] * n
        for i in plain:
            self.bytes_of[i] = text[i].encode()
        self.byte_id = np.full(256, -1, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                b = int(text[i][1:-1], 16)
                self.byte_id[b] = i
                self.bytes_of[i] = bytes([b])
        self.fallback = bool((self.byte_id >= 0).all())
        self.score = self.score.astype(np.float64)
        self.least = float(self.score[plain].min()) - 10 if plain else -10.0
        self.trie = DoubleArray({self.bytes_of[i]: i for i in plain})
        self.longest = max((len(self.bytes_of[i]) for i in plain), default=1)
        self.parted = not any("▁" in text[i].lstrip("▁") for i in plain)
        self.width = np.array([len(b) for b in self.bytes_of], np.int64)
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.first = np.cumsum(self.width) - self.width

    def segment(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of the best segmentation of each part (markers in place, one piece of text each)."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(parts)
        order = sorted(range(len(parts)), key=lambda k: len(parts[k]))
        for at in range(0, len(order), AT_ONCE):
            some = order[at : at + AT_ONCE]
            short = [k for k in some if len(parts[k]) <= TOGETHER]
            for group in ([short] if short else []) + [[k] for k in some if len(parts[k]) > TOGETHER]:
                for k, ids in zip(group, self._viterbi([parts[k] for k in group]), strict=True):
                    out[k] = ids
        return out

    def _viterbi(self, parts: list[bytes]) -> list[np.ndarray]:
        n, width = len(parts), max(map(len, parts))
        size = np.array([len(p) for p in parts])
        text = np.zeros((n, width + 1), np.uint8)
        for k, p in enumerate(parts):
            text[k, : len(p)] = np.frombuffer(p, np.uint8)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        came, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        for p in range(width):
            head = text[:, p]
            row = np.flatnonzero((p < size) & (best[:, p] > -np.inf) & ((head & 0xC0) != 0x80))
            if not len(row):
                continue
            char = 1 + (head >= 0xC0).astype(np.int64) + (head >= 0xE0) + (head >= 0xF0)
            single = np.zeros(n, bool)
            at, state = row, np.zeros(len(row), np.int32)
            for depth in range(1, min(self.longest, width - p) + 1):
                state = self.trie.step(state, text[at, p + depth - 1])
                ok = (state >= 0) & (p + depth <= size[at])
                at, state = at[ok], state[ok]
                if not len(at):
                    break
                found = self.trie.value[state]
                hit = found >= 0
                self._offer(best, came, piece, at[hit], p, depth, self.score[found[hit]], found[hit])
                single[at[hit & (char[at] == depth)]] = True
            for length in (1, 2, 3, 4):
                rest = row[~single[row] & (char[row] == length)]
                if len(rest):
                    self._offer(best, came, piece, rest, p, min(length, width - p), self.least, -1)
        out = []
        for k in range(n):
            end, ids = len(parts[k]), []
            while end > 0:
                start, i = int(came[k, end]), int(piece[k, end])
                if i >= 0:
                    ids.append(i)
                elif self.fallback:
                    ids.extend(self.byte_id[np.frombuffer(parts[k][start:end], np.uint8)][::-1].tolist())
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
                end = start
            out.append(np.array(ids[::-1], np.int64))
        return out

    @staticmethod
    def _offer(best, came, piece, row, p, depth, score, which) -> None:
        total = best[row, p] + score
        better = total > best[row, p + depth]
        row = row[better]
        best[row, p + depth] = total[better]
        came[row, p + depth] = p
        piece[row, p + depth] = which[better] if isinstance(which, np.ndarray) else which

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes: markers are spaces, the leading one goes."""
        if not len(ids):
            return b""
        width = self.width[ids]
        upto = np.cumsum(width)
        data = self.all_bytes[np.arange(upto[-1]) + np.repeat(self.first[ids] - upto + width, width)].tobytes().replace(MARK, b" ")
        return data[1:] if data[:1] == b" " else data


class SentencePieces(PartCache):
    """Texts -> ids, a slice of documents at a time."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.clear()

    def encode(self, data, start, end, head=None):
        raw = data.tobytes()
        parts = [(b" " if h else b"") + raw[i:j] for i, j, h in zip(start.tolist(), end.tolist(), head.tolist(), strict=True)]
        ids = self.pieces.segment([p.replace(b" ", MARK) for p in parts])
        return np.concatenate(ids).astype("<u4"), np.array([len(x) for x in ids], np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.room()
        cut = np.zeros(len(data), bool)
        if self.pieces.parted:
            cut = data == 32
            cut[1:] &= data[:-1] != 32
            cut[3:] &= ~((data[2:-1] == MARK[2]) & (data[1:-2] == MARK[1]) & (data[:-3] == MARK[0]))
        inside = offsets[:-1][np.diff(offsets) > 0]
        head = np.zeros(len(data), bool)
        head[inside] = cut[inside] = True
        start = np.flatnonzero(cut)
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        end = np.append(start[1:], len(data))
        h = span_hash(prefix_hash(data), start, end)
        h = np.where(head[start], mix(h + U64(3)), h)
        return self.gather(h, start, end, data, offsets, head=head[start])


def _kernel(path):
    def run(batches):
        encode = SentencePieces(path)
        byte_ids = np.zeros(len(encode.pieces.width), bool)
        byte_ids[encode.pieces.byte_id[encode.pieces.byte_id >= 0]] = True
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for lo, hi in slices(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                ids, upto = encode(part, at)
                out = []
                for k in range(hi - lo):
                    own = ids[upto[k] : upto[k + 1]]
                    out.append((len(own), int(byte_ids[own].sum()), zlib.crc32(own.tobytes()), encode.pieces.decode(own) == part[at[k] : at[k + 1]].tobytes()))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.bool_())], ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "restored"])

    return run


def encode_documents(docs: DataFrame, model: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32 and whether decoding restores the text, of every row."""
    ship(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return base.mapInArrow(over_batches(_kernel(model)), "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, restored boolean")


def _ids_kernel(path):
    def run(batches):
        encode = SentencePieces(path)
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for lo, hi in slices(offsets):
                ids, upto = encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], ["doc_id", "ids"])

    return run


def encode_ids(docs: DataFrame, model: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the list of piece ids of every row."""
    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(over_batches(_ids_kernel(model)), "doc_id long, ids array<int>")


def _decode_kernel(path):
    def run(batches):
        pieces = Pieces(path)
        for b in batches:
            text = [None if ids is None else pieces.decode(np.array(ids, np.int64)).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return run


def decode_ids(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give null."""
    ship(rows.sparkSession)
    return rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(over_batches(_decode_kernel(model)), "doc_id long, text string")
