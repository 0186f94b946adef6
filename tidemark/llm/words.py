"""Word spans and word hashes of a whole Arrow batch at once (numpy)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)  # of lower-cased bytes: digits, a-z and every byte of a non-ASCII character
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

SEGMENT = 1 << 18
_MULT = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Polynomial hashes modulo 2**64 of byte spans, from one prefix sum a segment."""

    def __init__(self):
        self._grow(2 * SEGMENT)

    def _grow(self, n):
        self.up, self.down = _powers(_MULT, n), _powers(pow(_MULT, -1, 1 << 64), n)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        cuts = np.flatnonzero(np.diff(starts // SEGMENT, prepend=-1))
        for i, j in zip(cuts, [*cuts[1:], len(starts)]):
            lo, hi = starts[i], ends[j - 1]
            if hi - lo + 1 > len(self.up):
                self._grow(int(hi - lo + 1))
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[data[lo:hi]] * self.up[:hi - lo], out=sums[1:])
            out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * self.down[starts[i:j] - lo]
        return out


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the texts' lower-cased UTF-8, each followed by a newline; nulls are empty."""
    apart = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", "\n")
    wide = pa.types.is_large_string(apart.type)
    _, offsets, data = apart.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[apart.offset:apart.offset + len(apart) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if len(apart) else np.empty(0, np.uint8)
    return LOWER[data], offsets - offsets[0]


def spans(data: np.ndarray, of_word: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = of_word[data]
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
