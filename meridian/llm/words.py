"""Words and windows of words of a whole Arrow batch at once, as 64-bit hashes.

Two words are the same where their hashes are; with n different words or windows the chance of any collision
is about n * n / 2**65 (one in ten million for ten million, so counts are exact for practical purposes).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes worked on at once.
STEP = 1 << 20
_FACTOR, _WINDOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_WINDOW_INVERSE = np.uint64(pow(int(_WINDOW), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, at least n of them."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        known = _POWERS[int(base)] = np.multiply.accumulate(known)
    return known


def _values(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mix((codes + np.uint64(1)) * _FACTOR)


SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[9, 10, 11, 12, 13, 32]] = True
#: Also every ASCII character that isn't a letter or digit.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_AS_IS, _LOWER = _values(False), _values(True)


class Words:
    """counts: words of each text; first: index of each text's first word; hashes: of all words in order."""

    def __init__(self, texts: pa.Array, lower: bool = False, separators: np.ndarray = SEPARATORS, keep_places: bool = False, stem: int = 0):
        if texts.null_count:
            texts = texts.fill_null("")
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
        self.offsets, self.data = offsets, data
        begin, end = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
        values = _LOWER if lower else _AS_IS
        hashes, stems, starts, ends = [], [], [], []
        at = begin
        while at < end:
            stop = self._stop(at, min(end, at + STEP), end, separators)
            s, e, h, st = self._part(at, stop, separators, values, stem)
            hashes.append(h)
            stems.append(st)
            starts.append(s)
            if keep_places:
                ends.append(e)
            at = stop
        empty = np.empty(0, np.int64)
        all_starts = np.concatenate(starts) if starts else empty
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.stems = np.concatenate(stems) if stem and stems else np.empty(0, np.uint64)
        edges = np.searchsorted(all_starts, offsets)
        self.first, self.counts = edges[:-1], np.diff(edges)
        if keep_places:
            self.starts, self.ends = all_starts, np.concatenate(ends) if ends else empty

    def _stop(self, at: int, stop: int, end: int, separators: np.ndarray) -> int:
        """Moves a cut on to the next separator or text's end, so that no word is cut."""
        while stop < end:
            ahead = self.data[stop : min(end, stop + 4096)]
            edge = np.searchsorted(self.offsets, stop)
            text_end = int(self.offsets[edge])
            found = np.flatnonzero(separators[ahead])
            here = stop + int(found[0]) if len(found) else stop + len(ahead)
            if text_end <= here:
                return max(text_end, at + 1)
            if len(found):
                return here
            stop = here
        return end

    def _part(self, at: int, stop: int, separators: np.ndarray, values: np.ndarray, stem: int):
        data = self.data[at:stop]
        inside = ~separators[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        lo, hi = np.searchsorted(self.offsets, at), np.searchsorted(self.offsets, stop, "right")
        cut[self.offsets[lo:hi] - at] = True
        cut[0] = cut[-1] = True
        before = np.empty(len(data), dtype=bool)
        before[0] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | cut[:-1]))
        after = np.empty(len(data), dtype=bool)
        after[-1] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        if not len(starts):
            none = np.empty(0, np.uint64)
            return starts + at, ends + at, none, none
        lengths = ends - starts
        where = np.flatnonzero(inside)
        begins = np.zeros(len(starts), dtype=np.int64)
        np.cumsum(lengths[:-1], out=begins[1:])
        rank = np.arange(len(where)) - np.repeat(begins, lengths)
        worth = values[data[where]] * _powers(_FACTOR, int(lengths.max()) + 1)[rank]
        hashes = mix(np.add.reduceat(worth, begins) + lengths.astype(np.uint64) * _WINDOW)
        stems = hashes[:0]
        if stem:
            worth[rank >= stem] = 0
            stems = mix(np.add.reduceat(worth, begins) + np.minimum(lengths, stem).astype(np.uint64) * _FACTOR)
        return starts + at, ends + at, hashes, stems

    def windows(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; meaningless where fewer are left in the whole batch's last text."""
        total = len(self.hashes)
        if total < n:
            return np.empty(0, np.uint64)
        out = np.empty(total - n + 1, dtype=np.uint64)
        step = 1 << 20
        powers, inverse = _powers(_WINDOW, min(total, step + n) + 1), _powers(_WINDOW_INVERSE, min(total, step) + 1)
        for at in range(0, len(out), step):
            stop = min(len(out), at + step)
            part = self.hashes[at : stop + n - 1]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(part * powers[: len(part)], out=sums[1:])
            k = stop - at
            out[at:stop] = mix((sums[n : n + k] - sums[:k]) * inverse[:k] + np.uint64(n))
        return out
