"""Elias-Fano coding of monotone integer sequences, with constant-time select.

n values below u take n * (2 + log2(u / n)) bits: each value's low bits stand in a packed
array, its high part as a unary gap in a bit vector; select(i) finds the i-th set bit by a
sampled position and a popcount of at most a few words.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQB7xQQ")  # n, first, low bits, bytes of low part, bytes of high part


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Each value's lowest `width` bits, little-endian, without gaps."""
    n, out = len(values), np.zeros((len(values) * width + 63) // 64 + 1, "<u8")
    if n and width:
        v = values & np.uint64((1 << width) - 1)
        bit = np.arange(n, dtype=np.uint64) * np.uint64(width)
        shift = bit & np.uint64(63)
        starts = (np.arange((int(bit[-1]) >> 6) + 1) * 64 + width - 1) // width  # the first value that begins in each word
        out[: len(starts)] = np.add.reduceat(v << shift, starts)
        over = np.flatnonzero(shift > np.uint64(64 - width))  # ends in the next word, where no other's end is
        out[(bit[over] >> np.uint64(6)).astype(np.int64) + 1] |= v[over] >> (np.uint64(64) - shift[over])
    return out


def _unpack(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.uint64) * np.uint64(width)
    if width <= 57:  # within the eight bytes from the one where it begins
        words = np.ascontiguousarray(words)
        held = np.ndarray((8 * len(words) - 7,), "<u8", words, 0, (1,))
        return held[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)) & np.uint64((1 << width) - 1)
    word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    low = words[word] >> shift
    up = np.where(shift > 0, words[np.minimum(word + 1, len(words) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | up) & np.uint64((1 << width) - 1)


class EliasFano:
    """A sequence that never falls; values are taken relative to the first."""

    def __init__(self, n: int, first: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.first, self.width, self.low, self.high = n, first, width, low, high
        self._samples: np.ndarray | None = None

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        if not len(v):
            return cls(0, 0, 0, np.zeros(1, "<u8"), np.zeros(1, "<u8"))
        if len(v) > 1 and (v[1:] < v[:-1]).any():
            raise ValueError("values must not fall")
        first = int(v[0])
        rel = v.astype(np.uint64) - np.uint64(first & 0xFFFFFFFFFFFFFFFF)
        width = max(0, (int(rel[-1]) // len(v)).bit_length() - 1) if int(rel[-1]) else 0
        ones = (rel >> np.uint64(width)).astype(np.int64) + np.arange(len(v))
        bits = np.zeros((int(ones[-1]) // 64 + 1) * 64, np.uint8)
        bits[ones] = 1
        return cls(len(v), first, width, _pack(rel, width), np.packbits(bits, bitorder="little").view("<u8"))

    def to_bytes(self) -> bytes:
        low, high = self.low.tobytes(), self.high.tobytes()
        return _HEAD.pack(self.n, self.first & 0xFFFFFFFFFFFFFFFF, self.width, len(low), len(high)) + low + high

    @classmethod
    def from_buffer(cls, buffer, offset: int = 0) -> tuple[EliasFano, int]:
        """The sequence that starts at offset (of bytes or a memory map), and where it ends."""
        n, first, width, low, high = _HEAD.unpack_from(buffer, offset)
        at = offset + _HEAD.size
        made = cls(n, first - (1 << 64) if first >> 63 else first, width, np.frombuffer(buffer, "<u8", low // 8, at), np.frombuffer(buffer, "<u8", high // 8, at + low))
        return made, at + low + high

    def _select(self, i: int) -> int:
        """Position of the i-th set bit of the high part."""
        if self._samples is None:
            counts = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
            self._samples = np.searchsorted(counts, np.arange(0, self.n, SAMPLE), side="right")
            self._ranks = counts
        word = int(self._samples[i // SAMPLE])
        while self._ranks[word] <= i:
            word += 1
        left = i - (int(self._ranks[word - 1]) if word else 0)
        w = int(self.high[word])
        for _ in range(left):
            w &= w - 1
        return word * 64 + (w & -w).bit_length() - 1

    def many(self, at: np.ndarray) -> np.ndarray:
        """The values at many places, by vectorised select; nothing is decoded as a whole."""
        at = np.asarray(at, np.int64)
        if not len(at):
            return np.zeros(0, np.int64)
        if self._samples is None:
            self._select(0)
        word = np.searchsorted(self._ranks, at, side="right")
        left = at - np.where(word > 0, self._ranks[np.maximum(word - 1, 0)], 0)
        w, pos = np.asarray(self.high)[word], word * 64
        for s in (32, 16, 8, 4, 2, 1):
            low = w & np.uint64((1 << s) - 1)
            c = np.bitwise_count(low).astype(np.int64)
            up = left >= c
            left -= np.where(up, c, 0)
            w = np.where(up, w >> np.uint64(s), low)
            pos += np.where(up, s, 0)
        high = (pos - at).astype(np.uint64) << np.uint64(self.width)
        rel = high | _unpack(self.low, at, self.width)
        return (rel + np.uint64(self.first & 0xFFFFFFFFFFFFFFFF)).view(np.int64)

    def successor(self, value: int, lo: int, hi: int) -> int:
        """The first place in [lo, hi) whose value is at least `value`, else hi; by selects, nothing is decoded."""
        while lo < hi:
            mid = (lo + hi) >> 1
            lo, hi = (mid + 1, hi) if self[mid] < value else (lo, mid)
        return lo

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        low = int(_unpack(self.low, np.array([i]), self.width)[0])
        return self.first + (((self._select(i) - i) << self.width) | low)

    def decode(self) -> np.ndarray:
        """All values at once."""
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little").view(bool))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        rel = high | _unpack(self.low, np.arange(self.n), self.width)
        return (rel + np.uint64(self.first & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
