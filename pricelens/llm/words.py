"""Words, hashes and shingles of whole Arrow text columns, as numpy arrays.

All word classes used by the operators are sets of bytes in UTF-8 (a byte of 0x80 or more
belongs to a character beyond ASCII), so a column's own buffer is split without decoding it.
Hashes have 64 bits; two different words are taken for one with a chance of 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # documents handled at once; a longer document is a chunk of its own
LONG_WORD = 64  # bytes from which a word is hashed on its own

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

ALNUM = np.ones(256, dtype=bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALNUM[_low : _high + 1] = False

_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
     0xA0761D6478BD642F], dtype=np.uint64,
)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column, and where each row begins; null counts as empty."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary()).fill_null(b"")
    else:
        column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole, bounds


def chunks(
    column: pa.Array, size: int = CHUNK_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``size`` bytes: first row, last row + 1, bytes, local row bounds."""
    whole, bounds = text_bytes(column)
    row, rows = 0, len(column)
    while row < rows:
        end = int(np.searchsorted(bounds, bounds[row] + size, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, whole[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


class Words:
    """The words of one chunk: byte ``starts`` and ``ends``, and ``rows``: row i has the words
    ``rows[i]`` to ``rows[i + 1] - 1``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, inside: np.ndarray):
        self.data = data
        member = inside[data]
        before = np.empty_like(member)
        before[:1] = False
        before[1:] = member[:-1]
        before[bounds[:-1][bounds[:-1] < len(data)]] = False
        after = np.empty_like(member)
        after[-1:] = False
        after[:-1] = member[1:]
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(member & ~before)
        self.ends = np.flatnonzero(member & ~after) + 1
        self.rows = np.searchsorted(self.starts, bounds)

    def hashes(self) -> np.ndarray:
        lengths = self.ends - self.starts
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        found = mix((eights[self.starts] & _LOW_BYTES[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _PLACES[0])
        rest = np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD))
        at = 8
        while len(rest):
            more = eights[self.starts[rest] + at] & _LOW_BYTES[np.minimum(lengths[rest] - at, 8)]
            found[rest] = mix(found[rest] ^ (more * _PLACES[1] + _PLACES[2]))
            at += 8
            rest = rest[lengths[rest] > at]
        for w in np.flatnonzero(lengths > LONG_WORD):
            word = self.data[self.starts[w] : self.ends[w]].tobytes()
            found[w] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return found


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row (n up to 5), row borders ignored."""
    total = np.zeros(max(len(words) - n + 1, 0), dtype=np.uint64)
    for k in range(n):
        total += words[k : k + len(total)] * _PLACES[k]
    return mix(total)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """The sorted set of word shingles of each row, lower-cased in A-Z and split at spaces.

    A row of fewer words has one shingle, the whole sequence; a row without words has none.
    """
    words = Words(LOWER[data], bounds, NOT_SPACE)
    hashes = words.hashes()
    grams = ngram_hashes(hashes, size)
    sets = []
    for first, last in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True):
        if last - first >= size:
            own = np.sort(grams[first : last - size + 1])
            sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif last > first:
            short = ngram_hashes(hashes[first:last], last - first) + np.uint64(last - first)
            sets.append(mix(short))
        else:
            sets.append(grams[:0])
    return sets
