"""Word and shingle hashes of Arrow text columns, vectorised with numpy.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``, with A-Z lower-cased;
in UTF-8 that equals splitting code points. A word's hash is a polynomial over
its bytes modulo 2**64 with random byte values, computed for all words of a
slice of text at once; a shingle's hash mixes its words' hashes in order.
Polynomials modulo a power of two have known equal pairs among words of a
thousand bytes and more, so words over ``LONG`` bytes are hashed by BLAKE2.
Texts are taken in slices of about ``SLICE`` bytes, cut between words, so a
very long text needs no more memory per byte than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
LONG = 256
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        steps = np.full(max(n, SLICE + 1), base, dtype=np.uint64)
        steps[0] = 1
        table = _powers[name] = np.multiply.accumulate(steps)
    return table[:n]


def _slice_words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words in ``data``."""
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = _VALUE[_LOWER[data]] * _power_table("up", _BASE, len(data))
    np.cumsum(terms, out=sums[1:])
    back = _power_table("down", pow(_BASE, -1, 1 << 64), len(data))
    found = _mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG):
        word = _LOWER[data[start[i] : end[i]]].tobytes()
        found[i] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
    return found


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text's UTF-8 bytes, in order."""
    if len(data) <= SLICE:
        return _slice_words(data)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        if end < len(data):
            spaces = np.flatnonzero(_SPACE[data[at:end]])
            while not len(spaces) and end < len(data):  # one word longer than a slice
                more = min(len(data), end + SLICE)
                spaces = np.flatnonzero(_SPACE[data[end:more]]) + (end - at)
                end = more
            if len(spaces) and end < len(data):
                end = at + int(spaces[-1]) + 1
        parts.append(_slice_words(data[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct shingles of ``n`` words as sorted int64 hashes; a shorter
    text with words has one shingle, the whole sequence."""
    if not len(words):
        return np.empty(0, np.int64)
    width = min(n, len(words))
    count = len(words) - width + 1
    x = np.full(count, width, np.uint64)
    for k in range(width):
        x = _mixed(x * _U(0x9E3779B97F4A7C15) + words[k : k + count])
    return np.unique(x.view(np.int64))


def texts(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each text's bytes, without copying; None for null."""
    size = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, size)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = column.is_valid().to_pylist()
    for i, ok in enumerate(valid):
        yield data[offsets[i] : offsets[i + 1]] if ok else None


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """``shingle_set`` of each text; empty for null."""
    for data in texts(column):
        yield shingle_set(word_hashes(data), n) if data is not None else np.empty(0, np.int64)
