"""Elias-Fano coding of a non-decreasing sequence of integers, with select.

n values below u take about 2 + log2(u / n) bits each: the low bits lie packed, the
high bits as unary gaps in a bit vector. ``select`` finds a value from one sampled
position in every 256 and a scan of few bytes, so there is no table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQBII")
SAMPLE = 256


class EliasFano:
    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.universe, self.low_bits = n, universe, low_bits
        self.low, self.high = low, high  # packed bytes, most significant bit first
        self.samples = np.flatnonzero(np.unpackbits(high))[::SAMPLE].astype("<u4") if n else np.zeros(0, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 0
        l = max(0, (universe // n).bit_length() - 1) if n else 0
        high = np.zeros((n + (universe >> l) + 8) // 8 * 8 + 8, np.uint8)
        high[(values >> np.uint64(l)).astype(np.int64) + np.arange(n)] = 1
        shifts = np.arange(l - 1, -1, -1, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, universe, l, np.packbits(low), np.packbits(high))

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        a = i * self.low_bits
        b = a + self.low_bits
        word = int.from_bytes(self.low[a // 8 : -(-b // 8)].tobytes(), "big")
        return (word >> (-b % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        bits = int(self.high[byte]) & (0xFF >> (at % 8))
        while bits.bit_count() <= left:
            left -= bits.bit_count()
            byte += 1
            bits = int(self.high[byte])
        for k in range(8):
            if bits & (0x80 >> k):
                if not left:
                    return ((byte * 8 + k - i) << self.low_bits) | self._low(i)
                left -= 1
        raise AssertionError("unreachable")

    def decode(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high))[: self.n].astype(np.int64) - np.arange(self.n)
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low)[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (high << self.low_bits) | bits @ (1 << np.arange(self.low_bits - 1, -1, -1, dtype=np.int64))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, max(self.universe - 1, 0), self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> tuple["EliasFano", int]:
        """The coded sequence at the start of data, and the bytes that it takes."""
        n, most, l, a, b = _HEAD.unpack_from(data)
        universe = most + 1 if n else 0
        at = _HEAD.size
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        self = cls.__new__(cls)
        self.n, self.universe, self.low_bits, self.low, self.high = n, universe, l, low, high
        k = -(-n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", k, at + a + b)
        return self, at + a + b + 4 * k
