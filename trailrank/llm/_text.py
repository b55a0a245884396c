"""Vectorised word and line hashing over Arrow text batches.

Words are runs of ``[^\\x20\\x09-\\x0D]``; A-Z count as a-z. A word's 64-bit
hash is a polynomial over randomised byte values modulo 2^64, read off prefix
sums, so a whole batch is hashed in a handful of numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = np.random.default_rng(20240611).integers(1, 2**63, size=256, dtype=np.uint64) * _U(2) + _U(1)
_VALUES[65:91] = _VALUES[97:123]

_powers: np.ndarray | None = None
_inverses: np.ndarray | None = None


def _running_product(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if _powers is None or len(_powers) <= n:
        size = max(n + 1, 2 * CHUNK_BYTES)
        _powers = _running_product(_MULT, size)
        _inverses = _running_product(pow(_MULT, -1, 1 << 64), size)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ (h >> _U(31))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(raw: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive documents of about ``limit`` bytes: (first, last+1, bytes, offsets).

    A longer document is a chunk of its own, so whole texts are always kept.
    """
    n, first = len(offs) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1)
        yield first, last, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def hash_words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, index of each document's first word; n+1 entries)."""
    words, bounds, _ = hash_words_and_prefixes(raw, offs, ())
    return words, bounds


def hash_words_and_prefixes(raw: np.ndarray, offs: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``hash_words``, and for each length the hash of each word's first bytes (0 where the word is not longer)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), np.zeros((len(lengths), 0), np.uint64)
    solid = ~_SPACE[raw]
    head = np.zeros(n + 1, dtype=bool)
    head[offs] = True
    starts_here = solid.copy()
    starts_here[1:] &= ~solid[:-1] | head[1:n]
    ends_here = solid.copy()
    ends_here[:-1] &= ~solid[1:] | head[1:n]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    powers, inverses = _tables(n)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[raw] * powers[:n], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inverses[starts])
    prefixes = np.zeros((len(lengths), len(starts)), np.uint64)
    for k, length in enumerate(lengths):
        longer = np.flatnonzero(ends - starts > length)
        at = starts[longer]
        prefixes[k, longer] = mix((sums[at + length] - sums[at]) * inverses[at] + _U(length))
    return words, np.searchsorted(starts, offs), prefixes


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width``-word windows of a word-hash array (one hash of all, if shorter)."""
    if len(words) == 0:
        return words
    width_here = min(width, len(words))
    n = len(words) - width_here + 1
    acc = np.full(n, _U(0x243F6A8885A308D3 + width_here), dtype=np.uint64)
    for k in range(width_here):
        acc = (acc ^ words[k : k + n]) * _U(_MULT)
        acc ^= acc >> _U(29)
    return mix(acc)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For every text: its distinct ``width``-word shingles as ascending uint64 hashes."""
    raw, offs = text_buffers(column)
    for first, last, part, part_offs in chunks(raw, offs):
        words, bounds = hash_words(part, part_offs)
        for i in range(last - first):
            yield np.unique(shingle_hashes(words[bounds[i] : bounds[i + 1]], width))
