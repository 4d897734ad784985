"""The bit-exact record hash: 32-bit Murmur3, each field seeded with the hash of the field before."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from seqloom.plans.shared import bound_batches

RECORD_SEED = 0xC062FB4A
_U = np.uint32
#: Bytes of strings that are hashed together; from this length on a string is hashed alone, so many words at once.
CELLS, LONG, WORDS = 1 << 22, 1 << 14, 1 << 16


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(32 - by))


def _scramble(k: np.ndarray) -> np.ndarray:
    return _turn(k * _U(0xCC9E2D51), 15) * _U(0x1B873593)


def _folded(values: list[bytes], h: np.ndarray) -> np.ndarray:
    """The words of strings of about one length taken up, word by word for all of them."""
    lengths = np.array([len(v) for v in values], np.int64)
    width = int(-(-lengths.max() // 4) * 4)
    data = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), "<u4").reshape(len(values), width // 4)
    for w in range(data.shape[1]):
        whole = lengths >= 4 * (w + 1)
        h = np.where(whole, _turn(h ^ _scramble(data[:, w]), 13) * _U(5) + _U(0xE6546B64), h)
        rest = (lengths > 4 * w) & ~whole  # the 1 to 3 last bytes; those after them are zero
        h = np.where(rest, h ^ _scramble(data[:, w]), h)
    return h


def _folded_long(value: bytes, h: int) -> int:
    """The same for one long string: its words are scrambled together, and taken up one after the other."""
    whole = len(value) // 4
    for at in range(0, whole, WORDS):
        words = _scramble(np.frombuffer(value, "<u4", min(WORDS, whole - at), 4 * at))
        for k in words.tolist():
            h ^= k
            h = (((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64) & 0xFFFFFFFF
    if len(value) % 4:
        h ^= int(_scramble(np.frombuffer(value[4 * whole :].ljust(4, b"\0"), "<u4"))[0])
    return h


def murmur3(values: list[bytes], seeds: np.ndarray) -> np.ndarray:
    """Hashes of many strings at once: those of about one length together, as many as fit ``CELLS`` bytes, long ones alone."""
    lengths = np.array([len(v) for v in values], np.int64)
    h = seeds.astype(np.uint32).copy()
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        longest = int(lengths[order[at]])
        if longest > LONG:
            h[order[at]] = _folded_long(values[order[at]], int(h[order[at]]))
            at += 1
            continue
        # Down to half the length, so that at most half of the cells are empty.
        some = order[at : at + max(1, CELLS // max(4, longest))]
        some = some[: max(1, int(np.searchsorted(-lengths[some], -(longest // 2), side="right")))]
        if longest:
            h[some] = _folded([values[k] for k in some], h[some])
        at += len(some)
    h ^= lengths.astype(np.uint32)
    h = (h ^ (h >> _U(16))) * _U(0x85EBCA6B)
    h = (h ^ (h >> _U(13))) * _U(0xC2B2AE35)
    return h ^ (h >> _U(16))


def record_hash(seed: int = RECORD_SEED, *columns: str) -> Column:
    """The hash as an unsigned number in a long column."""

    if active := SparkSession.getActiveSession():
        bound_batches(active)

    @F.arrow_udf("bigint")
    def chained(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        h = np.full(len(a), seed & 0xFFFFFFFF, np.uint32)
        for column in (a, b, c, d):
            h = murmur3([v.encode("latin-1", "replace") for v in column.to_pylist()], h)
        return pa.array(h.astype(np.int64), pa.int64())

    return chained(*(columns or ("id1", "seq", "id2", "qual")))
