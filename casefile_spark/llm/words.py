"""Words of Arrow text columns as numpy arrays: where each begins and ends, and 64-bit codes of words and of runs of words.

A word is a maximal run of bytes outside the ASCII white space ``[\\x20\\x09-\\x0D]``. UTF-8 never holds those
bytes inside a longer character, so bytes are enough. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as long as the longest chunk seen."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up.size <= n:
            size = 1 << int(n + 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (self.base, self.inverse))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE | np.uint64(1)), _Powers(_STEP)


def _spans_code(values: np.ndarray, start: np.ndarray, stop: np.ndarray, powers: _Powers) -> np.ndarray:
    """A code of ``values[start:stop]`` for each span, from prefix sums, whatever the span's length."""
    up, down = powers.upto(values.size)
    sums = np.zeros(values.size + 1, dtype=np.uint64)
    np.cumsum(values * up[: values.size], out=sums[1:])
    return mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


@dataclass
class Words:
    """The words of ``rows`` consecutive texts; word i is ``data[start[i]:stop[i]]``, text r has words ``first[r]:first[r + 1]``."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.first.size - 1), np.diff(self.first))

    def codes(self) -> np.ndarray:
        return _spans_code(_BYTE_CODE[self.data], self.start, self.stop, _BYTES)

    def runs(self, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which ``n`` words of one text begin, and the code of those words."""
        last = np.repeat(self.first[1:] - n, np.diff(self.first))
        at = np.flatnonzero(np.arange(self.start.size) <= last)
        return at, _spans_code(codes, at, at + n, _WORDS)

    def spans(self, codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The codes of words ``start`` to ``stop``, for arrays of both."""
        return _spans_code(codes, start, stop, _WORDS)

    def text(self, i: int, j: int, raw: bytes) -> bytes:
        """Words i to j of one text joined by one space."""
        return b" ".join(raw[int(self.start[i]) : int(self.stop[j - 1])].split()) if j > i else b""


def find_words(array: pa.Array) -> Words:
    array = array.cast(pa.large_string()) if not pa.types.is_large_string(array.type) else array
    if array.null_count:
        array = array.fill_null("")
    ends = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = np.zeros(data.size + 2, dtype=bool)
    inside[1:-1] = _IS_WORD[data]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = ends[1:-1]
    edge = edge[(edge > 0) & (edge < data.size)]
    begins[edge] = inside[1:-1][edge]
    stops[edge - 1] = inside[1:-1][edge - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, start, stop, np.searchsorted(start, ends))


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again in batches of about ``limit`` bytes of text, so that work arrays stay small; a longer text is a batch of its own."""
    for batch in batches:
        sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        group = np.cumsum(sizes + 64) // limit
        for lo, hi in zip(cuts := np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]]), cuts[1:]):
            if hi > lo:
                yield batch.slice(int(lo), int(hi - lo))
