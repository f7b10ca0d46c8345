"""Words of many texts as numpy arrays.

A batch of texts is one byte array with offsets, the form Arrow hands over, so words are
found, hashed and counted for all texts of a batch at once, without a Python loop over
words. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; all of these are
ASCII, so UTF-8 sequences stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 512 * 1024
_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_FOLDED_CODES = _BYTE_CODES[_FOLD]


def mix(values: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values, so that any of their bits can serve as a bucket."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            bases = np.array([_ODD, pow(_ODD, -1, 2**64)], dtype=np.uint64)
            grown = []
            for base in bases:
                column = np.full(max(count, CHUNK_BYTES), base, dtype=np.uint64)
                column[0] = 1
                grown.append(np.multiply.accumulate(column))
            self.up, self.down = grown
        return self.up[:count], self.down[:count]


_powers = _Powers()


@dataclass
class Words:
    """The words of some consecutive texts of a batch.

    ``rows`` is the range of texts; ``starts`` and ``ends`` are byte positions (end
    exclusive) in ``data``; ``bounds[i]:bounds[i + 1]`` are the words of text ``i``;
    ``text_bounds`` are the texts' own byte bounds.
    """

    rows: range
    data: np.ndarray
    text_bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.rows)), self.counts)

    def hashes(self, fold: bool = True, prefix: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, of its first ``prefix`` bytes if that is given."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        up, down = _powers.of(len(self.data) + 1)
        codes = (_FOLDED_CODES if fold else _BYTE_CODES)[self.data]
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(codes * up[:-1], out=sums[1:])
        ends = self.ends if prefix is None else np.minimum(self.ends, self.starts + prefix)
        return mix((sums[ends] - sums[self.starts]) * down[self.starts])


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their bounds; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8), bounds


def chunks(texts: pa.Array) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Ranges of texts of about half a megabyte together, with their bytes and bounds.

    A text larger than a chunk makes a chunk of its own; no text is cut.
    """
    data, bounds = _bytes_of(texts)
    first, count = 0, len(texts)
    while first < count:
        last = int(np.searchsorted(bounds, bounds[first] + CHUNK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), count)
        yield range(first, last), data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def words_of(texts: pa.Array) -> Iterator[Words]:
    """The words of all texts, chunk by chunk."""
    for rows, data, bounds in chunks(texts):
        inside = ~_SPACE[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:]
        edges = bounds[:-1][bounds[:-1] < bounds[1:]]
        begin[edges] = inside[edges]
        finish[edges[1:] - 1] = inside[edges[1:] - 1]
        starts = np.flatnonzero(begin)
        yield Words(
            rows, data, bounds, starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, bounds)
        )
