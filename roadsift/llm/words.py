"""Words of letters and digits for whole Arrow batches: maximal runs of ASCII letters (lower-cased), ASCII digits and non-ASCII bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A byte as part of a word, 0 where it separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256))


def flat_words(bodies: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all bodies (binary, no nulls) in order as one binary array, and ``bounds``: those of body i are bounds[i] to bounds[i + 1]."""
    kind = np.int64 if pa.types.is_large_binary(bodies.type) else np.int32
    if not len(bodies):
        return pa.array([], pa.large_binary()), np.zeros(1, np.int64)
    cuts = np.frombuffer(bodies.buffers()[1], kind)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
    raw = bodies.buffers()[2]
    data = (raw[int(cuts[0]) : int(cuts[-1])].to_pybytes() if raw is not None else b"").translate(_FOLD)
    folded = np.frombuffer(data, np.uint8)
    cuts = cuts - cuts[0]
    inside = folded != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin, end = cuts[:-1][cuts[:-1] < len(folded)], cuts[1:][cuts[1:] > 0] - 1
    first[begin], last[end] = inside[begin], inside[end]  # no word runs from one body into the next
    starts = np.flatnonzero(first)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(folded[inside])])
    return words, np.searchsorted(starts, cuts).astype(np.int64)


def word_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a whole array of ``flat_words`` and the offsets of its words in them."""
    if not len(words):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    return np.frombuffer(words.buffers()[2], np.uint8), np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
