"""Counting quotient filters that lose nothing: keys of packed ids are permuted, cut into quotient and full remainder.

A key is a run of word ids of `bits` bits each, packed into two halves of at most 64 bits. An
invertible permutation (two Feistel rounds) spreads the keys evenly. Its first bits choose a shard, the next ones are the
quotient, and all others are kept as the remainder, so that every key can be read back and no two are mixed up.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from lamina.llm.common import mix

_HEAD = struct.Struct("<BBBBIIQ")
_MOST = 255


def _low(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def pack(ids: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Halves of the keys whose k-th word ids are ids[k]."""
    if bits > 32 or len(ids) > 4:
        raise ValueError("a key has at most four ids of at most 32 bits")
    cut = (len(ids) + 1) // 2
    halves = []
    for part in (ids[:cut], ids[cut:]):
        half = np.zeros(len(ids[0]), np.uint64)
        for column in part:
            half = (half << np.uint64(bits)) | column.astype(np.uint64)
        halves.append(half)
    return halves[0], halves[1]


def unpack(a: np.ndarray, b: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    cut = (n + 1) // 2
    return [(half >> np.uint64(bits * (many - 1 - k))) & _low(bits) for half, many in ((a, cut), (b, n - cut)) for k in range(many)]


def permute(a: np.ndarray, b: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    cut = (n + 1) // 2
    a = a ^ (mix(b + np.uint64(0x51)) & _low(bits * cut))
    return a, b ^ (mix(a + np.uint64(0xA7)) & _low(bits * (n - cut)))


def unpermute(a: np.ndarray, b: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    cut = (n + 1) // 2
    b = b ^ (mix(a + np.uint64(0xA7)) & _low(bits * (n - cut)))
    return a ^ (mix(b + np.uint64(0x51)) & _low(bits * cut)), b


def _summed(a: np.ndarray, b: np.ndarray, counts: np.ndarray, b_bits: int, a_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, each once, with the sum of its counts. The stable sort merges sorted runs in one pass."""
    if a_bits + b_bits <= 64:
        key = (a << np.uint64(b_bits)) | b
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        del key
    else:
        order = np.lexsort((b, a))
        new = np.ones(len(order), bool)
        new[1:] = False
        for column in (a, b):
            x = column[order]
            new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    one = order[at]  # whole columns are put in order one at a time, so that few of them are held
    return a[one], b[one], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


@dataclass
class CountingFilter:
    """Sorted permuted keys of one shard with their counts; `shard_bits` leading bits are the same in all."""

    n: int
    bits: int
    shard_bits: int
    a: np.ndarray
    b: np.ndarray
    counts: np.ndarray

    @property
    def a_bits(self) -> int:
        return self.bits * ((self.n + 1) // 2)

    @classmethod
    def of(cls, ids: list[np.ndarray], bits: int) -> CountingFilter:
        """Counts of all keys, as one shard."""
        a, b = permute(*pack(ids, bits), len(ids), bits)
        out = cls(len(ids), bits, 0, a, b, np.ones(len(a), np.int64))
        return out._with(a, b, out.counts)

    def _with(self, a, b, counts) -> CountingFilter:
        return CountingFilter(self.n, self.bits, self.shard_bits, *_summed(a, b, counts, self.bits * self.n - self.a_bits, self.a_bits))

    def __len__(self) -> int:
        return len(self.a)

    def merged(self, other: CountingFilter) -> CountingFilter:
        return self._with(*(np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("a", "b", "counts")))

    def shards(self, shard_bits: int):
        """(shard, filter) for each shard with keys, by the first bits."""
        shard_bits = min(shard_bits, self.a_bits)
        shard = (self.a >> np.uint64(self.a_bits - shard_bits)).astype(np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else np.zeros(1, int)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield int(shard[lo]), CountingFilter(self.n, self.bits, shard_bits, self.a[lo:hi], self.b[lo:hi], self.counts[lo:hi])

    def at_least(self, least: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids and counts of the keys with a count of `least` or more."""
        on = self.counts >= least
        return unpack(*unpermute(self.a[on], self.b[on], self.n, self.bits), self.n, self.bits), self.counts[on]

    def to_bytes(self) -> bytes:
        """Bitmaps of occupied quotients and of run ends, the remainders in as few whole bytes as hold them, and counts of a byte (255: eight more follow at the end)."""
        size = len(self)
        q = max(0, min(self.a_bits - self.shard_bits, size.bit_length(), 32))
        rest = self.a_bits - self.shard_bits - q
        quotient = ((self.a >> np.uint64(rest)) & _low(q)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        ends = np.ones(size, bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        shard = int(self.a[0] >> np.uint64(self.a_bits - self.shard_bits)) if size and self.shard_bits else 0
        large = self.counts >= _MOST
        parts = [
            _HEAD.pack(self.n, self.bits, self.shard_bits, q, size, int(large.sum()), shard),
            np.packbits(occupied).tobytes(),
            np.packbits(ends).tobytes(),
            self._trimmed(self.a & _low(rest), rest),
            self._trimmed(self.b, self.bits * self.n - self.a_bits),
            np.minimum(self.counts, _MOST).astype(np.uint8).tobytes(),
            self.counts[large].astype("<i8").tobytes(),
        ]
        return b"".join(parts)

    @staticmethod
    def _trimmed(values: np.ndarray, bits: int) -> bytes:
        return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (bits + 7) // 8]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingFilter:
        n, bits, shard_bits, q, size, large, shard = _HEAD.unpack_from(data)
        at = _HEAD.size
        a_bits = bits * ((n + 1) // 2)
        rest = a_bits - shard_bits - q

        def take(many: int) -> np.ndarray:
            nonlocal at
            at += many
            return np.frombuffer(data, np.uint8, many, at - many)

        def wide(width: int) -> np.ndarray:
            out = np.zeros((size, 8), np.uint8)
            out[:, : (width + 7) // 8] = take(size * ((width + 7) // 8)).reshape(size, (width + 7) // 8)
            return out.view("<u8").ravel().astype(np.uint64)

        occupied = np.flatnonzero(np.unpackbits(take(((1 << q) + 7) // 8), count=1 << q))
        ends = np.unpackbits(take((size + 7) // 8), count=size)
        run = np.concatenate([[0], np.cumsum(ends)[:-1]]).astype(np.int64) if size else np.zeros(0, np.int64)
        a = (np.uint64(shard) << np.uint64(a_bits - shard_bits) if shard_bits else np.uint64(0)) | (occupied[run].astype(np.uint64) << np.uint64(rest)) | wide(rest)
        b = wide(bits * n - a_bits)
        counts = take(size).astype(np.int64)
        counts[counts == _MOST] = take(8 * large).view("<i8")
        return cls(n, bits, shard_bits, a, b, counts)


class Merger:
    """Filters of one shard, merged when two are about as large: each key is moved a logarithmic number of times."""

    def __init__(self):
        self.held: list[CountingFilter] = []

    def add(self, new: CountingFilter) -> None:
        self.held.append(new)
        while len(self.held) > 1 and len(self.held[-2]) <= 2 * len(self.held[-1]):
            self._join()

    def _join(self) -> None:
        last = self.held.pop()
        self.held[-1] = self.held[-1].merged(last)

    def __len__(self) -> int:
        return sum(map(len, self.held))

    def close(self) -> CountingFilter | None:
        while len(self.held) > 1:
            self._join()
        return self.held.pop() if self.held else None
