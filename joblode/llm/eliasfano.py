"""Rising numbers in near-minimal space (Elias-Fano), with direct access to each of them.

``n`` numbers up to ``u`` take about ``2 + log2(u / n)`` bits each: the low bits
of each number are stored as they are, the rest as the position of one set bit
among ``n + u / 2**low`` bits. Every ``SAMPLE``-th set bit's position is kept, so
that the i-th number is found by counting bits from there.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<qqB")


def pack_low(values: np.ndarray, bits: int) -> bytes:
    if not bits:
        return b""
    each = (values[:, None] >> np.arange(bits, dtype="uint64")) & np.uint64(1)
    return np.packbits(each.astype("uint8").ravel(), bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    """Numbers that never fall, as bytes. The first is taken off all, so they may be negative."""
    values = np.asarray(values, "int64")
    n = len(values)
    first = int(values[0]) if n else 0
    rest = values.astype("uint64") - np.uint64(first % 2**64)
    top = int(rest[-1]) if n else 0
    bits = max(0, (top // n).bit_length() - 1) if n else 0
    at = (rest >> np.uint64(bits)).astype("int64") + np.arange(n)
    upper = np.zeros(int(at[-1]) + 1 if n else 0, "uint8")
    upper[at] = 1
    samples = at[::SAMPLE].astype("uint32").tobytes()
    return b"".join([_HEAD.pack(n, first, bits), samples, pack_low(rest & np.uint64(2**bits - 1), bits),
                     np.packbits(upper, bitorder="little").tobytes()])


class Rising:
    """Reads what :func:`encode` wrote."""

    def __init__(self, data: bytes):
        self.n, self.first, self.bits = _HEAD.unpack_from(data)
        view, at = np.frombuffer(data, "uint8"), _HEAD.size
        n_samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", n_samples, at)
        at += 4 * n_samples
        low = -(-self.n * self.bits // 8)
        self.low, self.upper = view[at:at + low], view[at + low:]

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Position of the i-th set bit: from the sample before it, byte by byte."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        word = int(self.upper[byte]) >> (at % 8) << (at % 8)
        while (here := word.bit_count()) <= left:
            left -= here
            byte += 1
            word = int(self.upper[byte])
        for _ in range(left):
            word &= word - 1
        return 8 * byte + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        low = 0
        for b in range(self.bits):
            at = i * self.bits + b
            low |= (int(self.low[at // 8]) >> (at % 8) & 1) << b
        return self.first + ((self.select(i) - i) << self.bits | low)

    def all(self) -> np.ndarray:
        """All numbers at once."""
        at = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[:self.n]
        out = (at - np.arange(self.n)).astype("uint64") << np.uint64(self.bits)
        if self.bits:
            each = np.unpackbits(self.low, bitorder="little")[:self.n * self.bits].reshape(self.n, self.bits)
            out |= each.astype("uint64") @ (np.uint64(1) << np.arange(self.bits, dtype="uint64"))
        return (out + np.uint64(self.first % 2**64)).astype("int64")
