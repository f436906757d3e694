"""Elias-Fano code of ascending integers, with select and successor search on the packed bits."""

from __future__ import annotations

import struct

import numpy as np

#: Number of values, the largest, low bits of each; then the bytes of the high bits.
_HEAD, _SIZE = struct.Struct("<QQB"), struct.Struct("<Q")
#: Bits that share one rank sample of 32 bits.
BLOCK = 64
_COUNT = np.bitwise_count(np.arange(256, dtype=np.uint8))
#: Place of the k-th one in a byte, and 8 where there are fewer.
_NTH = np.full((256, 8), 8, np.uint8)
for _byte in range(256):
    for _k, _bit in enumerate(b for b in range(8) if _byte >> b & 1):
        _NTH[_byte, _k] = _bit


def encode(values: np.ndarray) -> bytes:
    """Ascending unsigned integers below 2^63 in about 2 + log2(largest / n) bits each; equal ones are allowed."""
    return encode_each(values, [len(values)])[0]


def encode_each(values: np.ndarray, ends: np.ndarray | list[int]) -> list[bytes]:
    """Codes of runs of `values`, all made in one pass; `ends` has the index where each run ends."""
    v, ends = np.ascontiguousarray(values, np.uint64), np.asarray(ends, np.int64)
    n = np.diff(ends, prepend=0)
    tops = [int(v[end - 1]) if m else 0 for end, m in zip(ends.tolist(), n.tolist(), strict=True)]
    widths = [max(0, (top // max(m, 1)).bit_length() - 1) for top, m in zip(tops, n.tolist(), strict=True)]
    top, width = np.array(tops, np.uint64), np.array(widths, np.uint64)
    at = np.arange(len(v)) - _spread(ends - n, n)
    # Room for every one and for the zero that ends the last bucket.
    size = ((top >> width).astype(np.int64) + n + 8) >> 3
    high_end = np.cumsum(size)
    bits = np.zeros(8 * int(size.sum()), np.uint8)
    bits[(v >> _spread(width, n)).astype(np.int64) + at + _spread(8 * (high_end - size), n)] = 1
    high = np.packbits(bits, bitorder="little").tobytes()
    words = _words(n, width)
    low_end = np.cumsum(words)
    low = _pack(v, _spread(width, n), at.astype(np.uint64), _spread(low_end - words, n), int(words.sum())).tobytes()
    parts = zip(n.tolist(), tops, widths, size.tolist(), high_end.tolist(), words.tolist(), low_end.tolist(), strict=True)
    return [_HEAD.pack(m, t, w) + _SIZE.pack(s) + high[e - s : e] + low[8 * (f - o) : 8 * f] for m, t, w, s, e, o, f in parts]


def decode_each(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(values of all codes, one code after the other, number of values of each), read in one pass."""
    heads = np.array([_HEAD.unpack_from(x) + _SIZE.unpack_from(x, _HEAD.size) for x in codes], np.uint64).reshape(-1, 4)
    n, size, width = heads[:, 0].astype(np.int64), heads[:, 3].astype(np.int64), heads[:, 2]
    words = _words(n, width)
    start = _HEAD.size + _SIZE.size
    high = b"".join(x[start : start + s] for x, s in zip(codes, size.tolist(), strict=True))
    # A run without low bits may point past the last word.
    low = b"".join([*(x[start + s : start + s + 8 * o] for x, s, o in zip(codes, size.tolist(), words.tolist(), strict=True)), bytes(16)])
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8), bitorder="little"))
    at = np.arange(len(ones)) - _spread(np.cumsum(n) - n, n)
    above = (ones - at - _spread(8 * (np.cumsum(size) - size), n)).astype(np.uint64)
    width = _spread(width, n)
    return (above << width) | _unpack(np.frombuffer(low, np.uint64), width, at.astype(np.uint64), _spread(np.cumsum(words) - words, n)), n


def _spread(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What holds for each run, for each value; of a single run the one number."""
    return x if len(n) == 1 else np.repeat(x, n)


def _words(n: np.ndarray, width: np.ndarray) -> np.ndarray:
    """64-bit words of the low bits of n values: one more than they fill, none where there are no bits."""
    bits = n * width.astype(np.int64)
    return np.where(bits > 0, (bits + 63 >> 6) + 1, 0)


def _pack(v: np.ndarray, width: np.ndarray, place: np.ndarray, first: np.ndarray, words: int) -> np.ndarray:
    """Low `width` bits of each value, at its place in its run, whose words begin at `first`."""
    if not words:
        return np.empty(0, np.uint64)
    part = v & ((np.uint64(1) << width) - np.uint64(1))
    at = place * width
    word, shift = (at >> np.uint64(6)).astype(np.int64) + first, at & np.uint64(63)
    out = np.zeros(words + 2, np.uint64)
    start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[start]] = np.bitwise_or.reduceat(part << shift, start)
    # The part of a value that runs over into the next word; a shift by 64 is taken in two steps.
    over = (part >> np.uint64(1)) >> (np.uint64(63) - shift)
    out[word[start] + 1] |= np.bitwise_or.reduceat(over, start)
    return out[:words]


def _unpack(low: np.ndarray, width: np.ndarray | np.uint64, place: np.ndarray, first: np.ndarray | int) -> np.ndarray:
    at = place * width
    word, shift = (at >> np.uint64(6)).astype(np.int64) + first, at & np.uint64(63)
    value = (low[word] >> shift) | ((low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))
    return value & ((np.uint64(1) << width) - np.uint64(1))


#: Questions asked at once are many if there is one for so many bits; then the bits are unpacked once for all of them.
MANY = 16


class EliasFano:
    """Reads an encoded sequence in place: nothing is kept unpacked but one 32-bit rank sample for 64 bits."""

    def __init__(self, data: bytes | memoryview) -> None:
        self.n, self.top, self.width = _HEAD.unpack_from(data, 0)
        (size,) = _SIZE.unpack_from(data, _HEAD.size)
        at = _HEAD.size + _SIZE.size
        raw = np.frombuffer(data, np.uint8, size, at)
        self.high = np.concatenate([raw, np.zeros(-size % (BLOCK // 8), np.uint8)]).reshape(-1, BLOCK // 8)
        self.rank = np.r_[0, np.cumsum(_COUNT[self.high].sum(axis=1, dtype=np.int64))].astype(np.uint32)
        words = (self.n * self.width + 63) // 64 + 1 if self.width and self.n else 0
        self.low = np.frombuffer(bytes(data[at + size : at + size + 8 * words]), np.uint64)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th one or zero of the high bits."""
        if len(k) * MANY >= self.high.size * 8:
            return np.flatnonzero(np.unpackbits(self.high.ravel() if ones else ~self.high.ravel(), bitorder="little"))[k]
        rank = self.rank if ones else (np.arange(len(self.rank), dtype=np.int64) * BLOCK - self.rank)
        block = np.searchsorted(rank, k, "right") - 1
        out = np.empty(len(k), np.int64)
        for lo in range(0, len(k), 65536):
            some = slice(lo, lo + 65536)
            rows = self.high[block[some]] if ones else ~self.high[block[some]]
            before = np.cumsum(_COUNT[rows], axis=1, dtype=np.int32)
            rest = (k[some] - rank[block[some]]).astype(np.int32)
            byte = (before <= rest[:, None]).sum(axis=1)
            at = np.arange(len(rest))
            rest = rest - np.where(byte > 0, before[at, np.maximum(byte - 1, 0)], 0)
            out[some] = block[some] * BLOCK + byte * 8 + _NTH[rows[at, byte], rest]
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        return _unpack(self.low, np.uint64(self.width), i.astype(np.uint64), 0)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the indexes i."""
        i = np.asarray(i, np.int64)
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.width)) | self._low(i)

    def all(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(self.high.ravel(), bitorder="little")[: (self.top >> self.width) + self.n + 1])
        i = np.arange(self.n)
        return ((ones - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is not below x; n where there is none."""
        return self._search(np.asarray(x, np.uint64))[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value equal to x; -1 where there is none."""
        at, equal = self._search(np.asarray(x, np.uint64))
        return np.where(equal, at, -1)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, equal = np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        able = np.flatnonzero(x <= np.uint64(self.top)) if self.n else np.empty(0, np.int64)
        x = x[able]
        bucket = (x >> np.uint64(self.width)).astype(np.int64)
        # The zero before a bucket and the zero that ends it; the first has none before.
        zero = self._select(np.concatenate([np.maximum(bucket - 1, 0), bucket]), False)
        lo, end = np.where(bucket > 0, zero[: len(x)] - (bucket - 1), 0), zero[len(x) :] - bucket
        want = x & np.uint64((1 << self.width) - 1)
        low = self._low(np.arange(self.n)).__getitem__ if len(x) * MANY >= self.n else self._low
        on = np.flatnonzero(lo < end)
        a, b, w = lo[on], end[on], want[on]
        while len(on):
            middle = (a + b) >> 1
            less = low(middle) < w
            a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
            rest = a < b
            lo[on[~rest]] = a[~rest]
            on, a, b, w = on[rest], a[rest], b[rest], w[rest]
        out[able] = lo
        inside = np.flatnonzero(lo < end)
        equal[able[inside]] = low(lo[inside]) == want[inside]
        return out, equal
