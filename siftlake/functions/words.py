"""Tokens of whole Arrow batches: those of ``text.tokens``, found in the bytes of all texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# what a byte becomes in a token: digits and small letters stay, A-Z are lowered, all others (0) end it
LOWERED = np.zeros(256, np.uint8)
LOWERED[48:58], LOWERED[97:123], LOWERED[65:91] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123)


def token_lists(texts: pa.Array) -> pa.ListArray:
    """Lower-cased runs of Latin letters, digits and Hangul syllables of each text; null gives an empty list."""
    texts = texts.cast(pa.string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    bounds = bounds.astype(np.int64) - bounds[0]
    low = LOWERED[data]
    lead = np.flatnonzero((data >= 0xEA) & (data <= 0xED))  # of the three bytes of U+A000 to U+DFFF
    if len(lead):
        lead = lead[lead + 2 < len(data)]
        a, b, c = (data[lead + k].astype(np.int64) for k in range(3))
        point = (a & 15) << 12 | (b & 63) << 6 | c & 63
        hangul = lead[(b >> 6 == 2) & (c >> 6 == 2) & (point >= 0xAC00) & (point <= 0xD7A3)]
        for k in range(3):
            low[hangul + k] = data[hangul + k]
    word = low != 0
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = bounds[:-1][bounds[:-1] < len(data)]
    start[first] = word[first]
    at, kept = np.flatnonzero(start), low[word]
    ends = np.append(np.cumsum(word)[at] - 1, len(kept)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(kept))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds), pa.int32()), found)
