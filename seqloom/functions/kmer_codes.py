"""k-mers as packed numbers, two bits a base and the first base lowest, over all letters of an Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from seqloom.functions.letters import utf8_bytes

#: Letters looked at together; a batch is walked in pieces that overlap by what a window needs.
PIECE = 1 << 21
#: Windows of a super-k-mer, at most: with k = 16 its bases and their number fit a 64-bit word.
RUN = 9
_COUNT = 60

_BASES = np.full(256, 4, np.uint8)
for _k, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _BASES[list(_pair)] = _k


def rolled(codes: np.ndarray, k: int, kind: type) -> np.ndarray:
    """The packed number of the k codes from each place on: pieces of powers of two, put together."""
    power, width, out, done = codes.astype(kind), 1, None, 0
    while True:
        if k & width:
            out = power.copy() if out is None else out[: len(power) - done] | (power[done:] << kind(2 * done))
            done += width
        if done == k:
            return out[: max(0, len(codes) - k + 1)]
        power = power[:-width] | (power[width:] << kind(2 * width))
        width *= 2


class Windows:
    """The windows of k letters of a piece: ``codes`` (0 to 3) by place, and which windows are bases of one read."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, k: int):
        base = _BASES[data]
        n = max(0, len(data) - k + 1)
        bad = np.concatenate([[0], np.cumsum(base == 4, dtype=np.int64)])
        edge = np.zeros(len(data) + 1, np.int64)
        edge[starts] = 1
        edge = np.cumsum(edge[: len(data)])
        self.k, self.codes = k, base & 3
        self.valid = (bad[k : k + n] == bad[:n]) & (edge[k - 1 : k - 1 + n] == edge[:n])

    def numbers(self) -> np.ndarray:
        """Packed numbers of the valid windows; k at most 16."""
        return rolled(self.codes, self.k, np.uint32)[self.valid] if len(self.valid) else np.empty(0, np.uint32)


def pieces(column: pa.Array, k: int, size: int = PIECE) -> Iterator[Windows]:
    """Every window of every read once."""
    data, starts = utf8_bytes(column)  # letters beyond ASCII are several bytes, none of which is a base
    for at in range(0, max(len(data) - k + 1, 0), size):
        stop = min(len(data), at + size + k - 1)
        lo, hi = np.searchsorted(starts, (at, stop))
        yield Windows(data[at:stop], starts[lo:hi] - at, k)


# ---------------------------------------------------------------- super-k-mers


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 32 bits, so that the least number is no particular letter's."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def minimizers(codes: np.ndarray, k: int) -> np.ndarray:
    """For each window of k the least of its ``RUN`` scrambled numbers of k - RUN + 1 bases: a function of the k-mer alone."""
    least = _mixed(rolled(codes, k - RUN + 1, np.uint32))
    width = 1
    while 2 * width <= RUN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (RUN - width)], least[RUN - width :])


def super_kmers(windows: Windows, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word): runs of at most ``RUN`` neighbouring valid windows of one bucket, which the minimizer names. A word holds the run's bases
    from the lowest bits on, and the number of its windows in its highest ones."""
    k, valid = windows.k, windows.valid
    if not valid.any():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    bucket = (_mixed(minimizers(windows.codes, k)) % np.uint32(buckets)).astype(np.int64)
    place = np.arange(len(valid))
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (bucket[1:] != bucket[:-1])
    since = place - np.maximum.accumulate(np.where(first, place, 0))
    at = np.flatnonzero(valid & (since % RUN == 0))
    # A run ends at the next one's start or the next window that is none.
    stops = np.append(np.flatnonzero(~valid | (since % RUN == 0)), len(valid))
    length = stops[np.searchsorted(stops, at, side="right")] - at
    padded = np.concatenate([windows.codes, np.zeros(k + RUN - 1, np.uint8)])
    words = rolled(padded, k + RUN - 1, np.uint64)[at]
    words &= (np.uint64(1) << (2 * (k - 1 + length)).astype(np.uint64)) - np.uint64(1)
    return bucket[at], words | (length.astype(np.uint64) << np.uint64(_COUNT))


def numbers_of(words: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed numbers of the words' windows, and how often each is meant."""
    length = (words >> np.uint64(_COUNT)).astype(np.int64)
    mask = np.uint64((1 << (2 * k)) - 1)
    some = [length > j for j in range(RUN)]
    found = [((words[s] >> np.uint64(2 * j)) & mask).astype(np.uint32) for j, s in enumerate(some)]
    return np.concatenate(found), np.concatenate([times[s] for s in some])


def added(numbers: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers together, by sorting: (distinct numbers in order, their sums)."""
    if not len(numbers):
        return numbers, times
    order = np.argsort(numbers, kind="stable")
    numbers, times = numbers[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    return numbers[first], np.add.reduceat(times, first)
