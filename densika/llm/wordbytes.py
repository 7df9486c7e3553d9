"""Words of Arrow string columns as NumPy arrays: byte spans, 64-bit hashes, and hashes of word runs.

All per-byte work is on pieces of bounded size, so a very long text costs memory by its words only.
Hashes are polynomials modulo 2**64 with an odd base, passed through an invertible finaliser; they depend
on the bytes alone, so every executor gives the same.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 21  # bytes of text handled at a time
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[48:58] = _NO_LETTER[65:91] = _NO_LETTER[97:123] = _NO_LETTER[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def finish(x: np.ndarray) -> np.ndarray:
    """An invertible mixing of 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        out = np.full(max(n, 1 << 12), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def run_hashes(values: np.ndarray, which: int = 0):
    """A function (from, to) to the hashes of those runs of ``values``."""
    base = _BASES[which]
    inverse = pow(base, -1, 1 << 64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])

    def of(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return finish((sums[hi] - sums[lo]) * powers(inverse, len(values) + 1)[lo] + (hi - lo).astype(np.uint64) * np.uint64(_BASES[2]))

    return of


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # of each word
    end: np.ndarray
    first: np.ndarray  # of each text its first word, and the number of words at last

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + PIECE, "right")))
            at = int(self.start[lo])
            of = run_hashes(_BYTE[self.data[at : int(self.end[hi - 1])]], 1)
            out[lo:hi] = of(self.start[lo:hi] - at, self.end[lo:hi] - at)
            lo = hi
        return out


def letters(texts: pa.Array) -> Words:
    """Runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased."""
    return words(texts, lower=True, gaps=_NO_LETTER)


def words(texts: pa.Array, lower: bool = False, gaps: np.ndarray = _WHITE) -> Words:
    """Words between ASCII white space; a null text has none.  ``lower`` maps A-Z to a-z first."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    chars = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if lower:
        chars = _LOWER[chars]
    inside = ~gaps[chars]
    n = len(chars)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < n)]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(opens)
    return Words(chars, start, np.flatnonzero(closes) + 1, np.searchsorted(start, at))


def release() -> None:
    """Give memory that the worker's allocators hold back to the system, so that idle workers are small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with memory released at the end of each task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose texts have about ``limit`` bytes (a longer text is alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto, lo = np.cumsum(sizes.astype(np.int64)), 0
        while lo < batch.num_rows:
            base = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, base + limit, "right")))
            hi = min(hi, lo + 20_000)
            yield batch.slice(lo, hi - lo)
            lo = hi


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
