"""A wavelet matrix: bit planes with a rank directory that is stored with them. Access, counting and occurrence lookup work on arrays of places.

The directory has the ones before each word of 64 bits, as 16 bits within a block of 1,000 words and 64 bits for the block: a
quarter of the planes' size.
"""

from __future__ import annotations

import struct

import numpy as np

#: Bits of a word, and words of a block of the directory.
STEP = 64
BLOCK = 1000
_MAGIC = b"WVM2"


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        """planes: 64-bit words, most significant bit of the values first."""
        self.n, self.planes, self.zeros, self.bits = n, planes, zeros, len(planes)
        self.small: list[np.ndarray] = []
        self.large: list[np.ndarray] = []

    def _direct(self) -> WaveletMatrix:
        """Makes the directory."""
        for p in self.planes:
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(p), dtype=np.int64)))[:-1]
            large = before[::BLOCK]
            self.large.append(large)
            self.small.append((before - np.repeat(large, BLOCK)[: len(before)]).astype(np.uint16))
        return self

    @classmethod
    def build(cls, values: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        n = len(values)
        bits = bits or max(1, int(values.max(initial=0)).bit_length())
        kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32
        v, planes, zeros = np.asarray(values, kind), [], []
        for b in range(bits - 1, -1, -1):
            one = (v & kind(1 << b)) != 0
            packed = np.packbits(one, bitorder="little")
            plane = np.zeros(-(-n // STEP) + 1, np.uint64)
            plane.view(np.uint8)[: len(packed)] = packed
            planes.append(plane)
            left = v[~one]
            zeros.append(len(left))
            v = np.concatenate((left, v[one]))
        return cls(n, planes, zeros)._direct()

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.large[level][word // BLOCK] + self.small[level][word] + np.bitwise_count(self.planes[level][word] & low)

    def _places(self, level: int, one: bool, number: np.ndarray) -> np.ndarray:
        """Places of a plane's ones or zeros by their ascending numbers, from 0: the directory leads to the words, and only those are unpacked."""
        before = np.repeat(self.large[level], BLOCK)[: len(self.small[level])] + self.small[level]
        if not one:
            before = np.arange(len(before)) * STEP - before
        word = np.searchsorted(before, number, "right") - 1
        some, at = np.unique(word, return_inverse=True)
        bits = np.unpackbits(self.planes[level][some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") == one
        order = np.argsort(~bits, axis=1, kind="stable")  # places of a word's bits, wanted ones first
        return word * STEP + order[at, number - before[word]]

    def access(self, at: np.ndarray) -> np.ndarray:
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for level in range(self.bits):
            ones = self._ones(level, at)
            bit = (self.planes[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            out = out << 1 | bit.astype(np.int64)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return out

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value stands before each place."""
        value, hi = np.broadcast_arrays(np.asarray(value, np.int64), np.asarray(at, np.int64))
        lo = np.zeros(len(hi), np.int64)
        for level in range(self.bits):
            one = (value >> (self.bits - 1 - level)) & 1 == 1
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + b, hi - b)
        return hi - lo

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least value of each range of places, none of them empty."""
        out = np.zeros(len(lo), np.int64)
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            one = hi - lo == b - a
            lo, hi, out = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + b, hi - b), out << 1 | one
        return out

    def count(self, value: int) -> int:
        return int(self.rank(np.array([value]), np.array([self.n]))[0]) if value < 1 << self.bits else 0

    def select(self, value: int) -> np.ndarray:
        """All places of a value, ascending."""
        total, lo = self.count(value), np.zeros(1, np.int64)
        for level in range(self.bits):
            ones = self._ones(level, lo)
            lo = self.zeros[level] + ones if (value >> (self.bits - 1 - level)) & 1 else lo - ones
        at = int(lo[0]) + np.arange(total)
        for level in range(self.bits - 1, -1, -1):
            one = bool((value >> (self.bits - 1 - level)) & 1)
            at = self._places(level, one, at - (self.zeros[level] if one else 0))
        return at

    def decode(self) -> np.ndarray:
        """All values in order."""
        kind = np.uint8 if self.bits <= 8 else np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level].view(np.uint8), bitorder="little")[: self.n].astype(bool)
            z, above = self.zeros[level], np.empty(self.n, kind)
            above[~one] = now[:z]
            above[one] = now[z:] | kind(1 << (self.bits - 1 - level))
            now = above
        return now

    def to_bytes(self) -> bytes:
        head = struct.pack("<4sqi", _MAGIC, self.n, self.bits) + struct.pack(f"<{self.bits}q", *self.zeros)
        parts = [x.astype(kind).tobytes() for kind, xs in (("<u8", self.planes), ("<i8", self.large), ("<u2", self.small)) for x in xs]
        return head + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> WaveletMatrix:
        magic, n, bits = struct.unpack_from("<4sqi", data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        zeros, at, words = list(struct.unpack_from(f"<{bits}q", data, 16)), 16 + 8 * bits, -(-n // STEP) + 1
        blocks = -(-words // BLOCK)
        out = cls(n, [np.frombuffer(data, "<u8", words, at + 8 * words * i) for i in range(bits)], zeros)
        at += 8 * words * bits
        out.large = [np.frombuffer(data, "<i8", blocks, at + 8 * blocks * i) for i in range(bits)]
        at += 8 * blocks * bits
        out.small = [np.frombuffer(data, "<u2", words, at + 2 * words * i) for i in range(bits)]
        return out
