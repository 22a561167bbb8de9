"""Rising sequences of integers in near-minimal space, with access to any place.

n values below u take about 2 + log2(u / n) bits each: the low bits stand packed in an array, the high parts are
written in unary, a set bit per value, so value i's high part is the place of the i-th set bit less i. A select
structure finds that bit: the number of set bits before each group of 512 as 32-bit integers, a search
among those, then set bits counted by byte inside the group. It adds 1/16 bit per bit of the unary part;
no table of 64-bit offsets is kept, neither in the file nor in memory.
"""

from __future__ import annotations

import numpy as np

#: Bits between two entries of the select structure.
GROUP = 512
_ONES = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int64)
#: The place of the r-th set bit in each byte.
_PLACE = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _set = [b for b in range(8) if _byte >> b & 1]
    _PLACE[_byte, : len(_set)] = _set


class EliasFano:
    """A rising sequence (repeats allowed) of integers from 0 up."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.before = n, low_bits, low, high, before

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("the values don't rise")
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if low_bits:
            out = np.zeros((n, low_bits), np.uint8)
            for b in range(low_bits):
                out[:, b] = (values >> np.uint64(b)) & np.uint64(1)
            low = np.packbits(out.reshape(-1), bitorder="little")
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(at[-1]) + 1 if n else 0) // GROUP) * GROUP, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little")
        return cls(n, low_bits, low, high, cls._counts(high))

    @staticmethod
    def _counts(high: np.ndarray) -> np.ndarray:
        per_group = _ONES[high].reshape(-1, GROUP // 8).sum(1)
        return np.r_[0, np.cumsum(per_group)].astype("<u4")

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The places of the set bits with these ranks from 0."""
        group = np.searchsorted(self.before, rank, side="right") - 1
        left = rank - self.before[group].astype(np.int64)
        inside = self.high.reshape(-1, GROUP // 8)[group]
        sums = np.cumsum(_ONES[inside], axis=1)
        byte = (sums <= left[:, None]).sum(1)
        row = np.arange(len(rank))
        left = left - np.where(byte > 0, sums[row, np.maximum(byte - 1, 0)], 0)
        return group * GROUP + byte * 8 + _PLACE[inside[row, byte], left]

    def __getitem__(self, places) -> np.ndarray:
        """The values at these places, as unsigned 64-bit integers."""
        at = np.atleast_1d(np.asarray(places, np.int64))
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError(f"no place {at.min()} or {at.max()} among {self.n}")
        out = np.empty(len(at), np.uint64)
        for low in range(0, len(at), 1 << 14):
            part = at[low : low + (1 << 14)]
            value = (self.select(part) - part).astype(np.uint64) << np.uint64(self.low_bits)
            for b in range(self.low_bits):
                bit = part * self.low_bits + b
                value |= ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
            out[low : low + (1 << 14)] = value
        return out

    def parts(self) -> list[bytes]:
        """What of_parts() needs, less n."""
        return [bytes([self.low_bits]), self.low.tobytes(), self.high.tobytes(), self.before.tobytes()]

    @classmethod
    def of_parts(cls, n: int, parts: list[bytes]) -> EliasFano:
        low_bits, low, high, before = parts
        return cls(n, low_bits[0], np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(before, "<u4"))
