"""Elias-Fano sequences in numpy arrays that can be memory-mapped, with batched queries."""

from __future__ import annotations

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_POP = _BITS.sum(1).astype(np.uint8)
#: Place of the k-th one in a byte.
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _SELECT[_b, : _POP[_b]] = np.flatnonzero(_BITS[_b])


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a monotone sequence of numbers below `universe`.

    `low` packs the lower bits of each number; in `high` number i sets bit
    (its upper bits) + i; `ones` counts the ones before each 64 bits of `high`.
    """
    values = np.asarray(values, np.uint64)
    n = len(values)
    bits = max(0, (universe // n).bit_length() - 1) if n else 0
    flags = np.zeros(-(-(n + (universe >> bits) + 2) // 64) * 64, np.uint8)
    flags[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
    ones = flags.reshape(-1, 64).sum(1, dtype=np.uint32)
    step, parts = 1 << 18, []  # a multiple of 64 numbers fills whole words
    for at in range(0, n if bits else 0, step):
        x = values[at : at + step, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)
        parts.append(np.packbits(x.astype(np.uint8).ravel(), bitorder="little"))
    low = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    low = np.concatenate([low, np.zeros(-len(low) % 8 + 8, np.uint8)]).view(np.uint64)
    return {"low": low, "high": np.packbits(flags, bitorder="little"), "ones": (np.cumsum(ones) - ones).astype(np.uint32), "shape": np.array([n, bits], np.int64)}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.high, self.ones = arrays["low"], arrays["high"].reshape(-1, 8), arrays["ones"]
        self.n, self.bits = map(int, arrays["shape"])
        # a number of up to 57 bits lies in the eight bytes from its first one on
        self.octets = np.lib.stride_tricks.as_strided(self.low, (8 * len(self.low) - 7,), (1,)) if self.bits <= 57 else None
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def _select(self, k: np.ndarray, before: np.ndarray, flip: int) -> np.ndarray:
        """Place of the k-th one (flip 0) or zero (flip 255) in `high`."""
        word = np.searchsorted(before, k, "right") - 1
        left = k - before[word]
        octets = self.high[word] ^ np.uint8(flip)
        ends = np.cumsum(_POP[octets], axis=1, dtype=np.int64)
        octet = (ends <= left[:, None]).sum(1)
        row = np.arange(len(k))
        left = left - np.where(octet > 0, ends[row, np.maximum(octet - 1, 0)], 0)
        return word * 64 + octet * 8 + _SELECT[octets[row, octet], left]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        if self.octets is not None:
            at = i * self.bits
            return (self.octets[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        rest = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | rest) & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((self._select(i, self.ones, 0) - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first number that is not less than each x, and whether it equals x.

        The upper bits lead to a bucket between two zeros of `high`, the lower
        bits are searched in it.
        """
        x = np.asarray(x, np.uint64)
        if not len(x) or not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        top = (x >> np.uint64(self.bits)).astype(np.int64)
        want = x & np.uint64((1 << self.bits) - 1)
        lo = np.where(top > 0, self._select(np.maximum(top - 1, 0), self.zeros, 255) + 1 - top, 0)
        end = self._select(top, self.zeros, 255) - top
        hi, open_ = end.copy(), np.flatnonzero(lo < end)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        hit = lo < end
        hit[hit] = self._low(lo[hit]) == want[hit]
        return lo, hit
