"""Monotone sequences in Elias-Fano code, and sorted lists of lists on top of them.

A value's low bits are stored side by side, its high bits as gaps in unary. Reading one element is a
select in the unary bits, looking for a value is a select of its bucket and a comparison of the few
low parts there: both from a sampled position on, for many at once, without decoding anything else.
The bits are in one anonymous memory map.
"""

from __future__ import annotations

import mmap

import numpy as np

#: Every ``SAMPLE``-th one and zero of the unary bits has its position stored: a power of two.
SAMPLE = 4
_SHIFT = SAMPLE.bit_length() - 1
_57 = np.uint64((1 << 57) - 1)
_PACK = 1 << 16
#: Numbers looked for at a time: what a search holds beside its result doesn't grow with their number.
_SEARCH = 1 << 15


def _words_at(data: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on; ``data`` ends with spare bytes."""
    return np.ndarray((len(data) - 8,), "<u8", data, strides=(1,))[byte]


def _select(data: np.ndarray, samples: np.ndarray, nth: np.ndarray, flip: np.uint64) -> np.ndarray:
    """Position of the ``nth`` one (or zero, if ``flip`` has all bits set) of the unary bits."""
    at = samples[nth >> _SHIFT].astype(np.int64)
    left = (nth & (SAMPLE - 1)).astype(np.uint8)  # ones still to pass; the sampled one itself is the first
    out, todo = np.empty(len(nth), np.int64), np.arange(len(nth))
    while len(todo):
        word = _words_at(data, at >> 3) ^ flip
        word >>= (at & 7).astype(np.uint64)  # 57 bits or more
        word &= _57
        there = np.bitwise_count(word)
        more = there <= left
        some = more.any()
        w, r = (word[~more], left[~more]) if some else (word, left)
        for k in range(int(r.max(initial=0))):
            w &= w - (r > k)  # without its lowest one, where there are ones to pass
        found = np.bitwise_count(w ^ (w - np.uint64(1)))  # the lowest one and the zeros below it
        if not some:
            out[todo] = at + found - 1
            break
        out[todo[~more]] = at[~more] + found - 1
        todo, at, left = todo[more], at[more] + 57, (left - there)[more]
    return out


_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


class EliasFano:
    """A monotone sequence of non-negative integers below 2^56."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.int64)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.low_bits = bits = max(0, (top // n).bit_length() - 1) if n else 0
        self.buckets = (top >> bits) + 1 if n else 0
        high = values >> bits
        ones = high + np.arange(n)
        unary = np.zeros(n + self.buckets + 128, np.uint8)
        unary[ones] = 1
        packed = np.packbits(unary, bitorder="little")
        lows = []
        for s in range(0, n, _PACK):
            part = (values[s:s + _PACK] & ((1 << bits) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)
            lows.append(np.unpackbits(part, axis=1, count=bits, bitorder="little").ravel() if bits else np.zeros(0, np.uint8))
        low = np.packbits(np.concatenate(lows), bitorder="little") if lows else np.zeros(0, np.uint8)
        size = len(low) + 16
        self.map = mmap.mmap(-1, size + len(packed) + 16)
        self.map.write(low.tobytes() + bytes(16) + packed.tobytes() + bytes(16))
        whole = np.frombuffer(self.map, np.uint8)
        self.low, self.high = whole[:size], whole[size:]
        zeros = np.flatnonzero(unary[:n + self.buckets] == 0)
        self.one_at, self.zero_at = ones[::SAMPLE].astype(np.uint32), zeros[::SAMPLE].astype(np.uint32)

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low_bits
        return (_words_at(self.low, bit >> 3) >> (bit & 7).astype(np.uint64)).astype(np.int64) & ((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at some places."""
        if not len(i):
            return np.zeros(0, np.int64)
        high = _select(self.high, self.one_at, i, np.uint64(0)) - i
        return (high << self.low_bits) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of the first element that is each of ``x``, or -1."""
        out = np.full(len(x), -1, np.int64)
        bucket = x >> self.low_bits
        some = np.flatnonzero((bucket >= 0) & (bucket < self.buckets))
        if not len(some):
            return out
        x, bucket = x[some] & ((1 << self.low_bits) - 1), bucket[some]
        # A bucket's elements are the ones between the zero before it and its own.
        at = np.zeros(len(some), np.int64)
        later = np.flatnonzero(bucket > 0)
        at[later] = _select(self.high, self.zero_at, bucket[later] - 1, _ALL) + 1
        i = at - bucket
        todo = np.arange(len(some))
        for _ in range(3):  # most buckets hold few elements: these are looked at one by one
            bit = at[todo]
            one = (self.high[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            todo = todo[one]
            low = self._low(i[todo])
            hit = low == x[todo]
            out[some[todo[hit]]] = i[todo[hit]]
            todo = todo[low < x[todo]]
            if not len(todo):
                return out
            at[todo] += 1
            i[todo] += 1
        # The others by halves, up to the bucket's own zero.
        lo, want = i[todo], x[todo]
        hi = end = _select(self.high, self.zero_at, bucket[todo], _ALL) - bucket[todo]
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            right = (lo < hi) & (self._low(np.minimum(mid, self.n - 1)) < want)
            lo, hi = np.where(right, mid + 1, lo), np.where(right, hi, np.minimum(mid, hi))
        there = np.flatnonzero(lo < end)
        there = there[self._low(lo[there]) == want[there]]
        out[some[todo[there]]] = lo[there]
        return out


class Lists:
    """Sorted lists of numbers, one after the other: ``pointers`` to where each begins, and the
    numbers, each list's counted on from the end of the list before, so that all are one monotone
    sequence. A number is looked for relative to its list."""

    def __init__(self, sizes: np.ndarray, numbers: np.ndarray):
        ends = np.cumsum(sizes)
        self.pointers = EliasFano(np.concatenate([[0], ends]))
        last = np.zeros(len(sizes), np.int64)  # each list's share: its largest number and one
        full = sizes > 0
        last[full] = numbers[ends[full] - 1] + 1
        self.values = EliasFano(numbers + np.repeat(np.cumsum(last) - last, sizes))

    def find(self, which: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of ``number`` in the list ``which``, among all, or -1; and where the list begins."""
        at, begin = np.empty(len(which), np.int64), np.empty(len(which), np.int64)
        for s in range(0, len(which), _SEARCH):
            part = slice(s, s + _SEARCH)
            at[part], begin[part] = self._find(which[part].astype(np.int64), number[part].astype(np.int64))
        return at, begin

    def _find(self, which: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # A list asked for many times in a row is looked up once.
        new = np.concatenate([[True], which[1:] != which[:-1]])
        lists, run = which[new], np.cumsum(new) - 1
        begin, end = self.pointers.get(lists), self.pointers.get(lists + 1)
        base = np.zeros(len(lists), np.int64)
        later = np.flatnonzero(begin > 0)
        base[later] = self.values.get(begin[later] - 1) + 1
        begin, end, base = begin[run], end[run], base[run]
        at = self.values.find(base + number)
        return np.where((at >= begin) & (at < end), at, -1), begin
