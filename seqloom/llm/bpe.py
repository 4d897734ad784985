"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the whole vocabulary: a pre-token that is itself a
vocabulary entry takes one probe and one comparison. Tier two, for the misses, merges bytes held
in a doubly linked list, the next merge coming off a heap ordered by (rank, position).

Defined results: a null or empty text encodes to no ids; ids decode to exactly the text's UTF-8
bytes; rows are encoded one by one, so repeated rows repeat, a null doc_id stays null and an empty table gives an
empty one; of equal ranks the leftmost pair is merged first; very long pre-tokens go through the heap like others.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import bound_batches

_M64 = (1 << 64) - 1
#: Words remembered per worker and generation; two generations are kept.
MEMO_WORDS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _spread(h: np.ndarray, d) -> np.ndarray:
    """Mix 64-bit hashes with a displacement."""
    x = h ^ (np.uint64(d) if np.isscalar(d) else d.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: n keys take exactly the slots 0..n-1."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        h = self.digest(keys)
        if len(np.unique(h)) != n:
            raise ValueError("keys must be distinct")
        self.displace = np.zeros(self.buckets, np.int64)
        self.key_at = np.zeros(n, np.int64)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        free = np.ones(n, bool)
        tries = np.arange(1, 257, dtype=np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            own = order[starts[b] : starts[b + 1]]
            base = 0
            while True:
                slots = (_spread(h[own][None, :], (tries + base)[:, None]) % np.uint64(n)).astype(np.int64)
                ok = free[slots].all(axis=1)
                if len(own) > 1:
                    s = np.sort(slots, axis=1)
                    ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if ok.any():
                    k = int(ok.argmax())
                    self.displace[b] = tries[k] + base
                    self.key_at[slots[k]] = own
                    free[slots[k]] = False
                    break
                base += len(tries)

    @staticmethod
    def digest(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """The one key index that each given key could have."""
        h = self.digest(keys)
        d = self.displace[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.key_at[(_spread(h, d) % np.uint64(self.n)).astype(np.int64)]


class TwoTierBpe:
    """Encoder and decoder for one vocabulary; picklable, so that it can be broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.keys = list(ranks)
        self.hash = PerfectHash(self.keys)
        self.ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        self._ready()

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("ranks", "pattern", "keys", "hash", "ids")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _ready(self) -> None:
        self._find = regex.compile(self.pattern).findall
        self._token = {i: t for t, i in self.ranks.items()}
        self._young: dict[str, bytes | None] = {}
        self._old: dict[str, bytes | None] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: lowest rank first, leftmost first among equals, over linked bytes."""
        ranks, n = self.ranks, len(piece)
        if n < 2:
            return [ranks[piece]] if n else []
        end = list(range(1, n + 1))  # where the part that starts at i ends; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # one of the two parts has changed since
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (b := before[i]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
                heappush(heap, (r, b, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def resolve(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as packed little-endian 32-bit integers: the perfect hash, then the heap."""
        if not pieces:
            return []
        packed, keys = self.ids.astype("<u4"), self.keys
        out = []
        for piece, k in zip(pieces, self.hash.probe(pieces).tolist()):
            out.append(packed[k].tobytes() if keys[k] == piece else np.array(self.merge(piece), "<u4").tobytes())
        return out

    def _learn(self, words: set[str]) -> None:
        """Bring words (each standing for a blank and the word) into the memo. None: not separable at its blanks."""
        young, old = self._young, self._old
        fresh = []
        for w in words:
            if w in old:
                young[w] = old[w]
            elif not w or w[0].isspace() or w[-1].isspace():
                young[w] = None
            else:
                fresh.append(w)
        split = [[p.encode() for p in self._find(" " + w)] for w in fresh]
        distinct = list({p for pieces in split for p in pieces})
        known = dict(zip(distinct, self.resolve(distinct)))
        young.update((w, b"".join([known[p] for p in pieces])) for w, pieces in zip(fresh, split))

    def _whole(self, text: str) -> bytes:
        return b"".join(self.resolve([p.encode() for p in self._find(text)]))

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, packed. A blank between two non-blanks always begins a pre-token, so texts are cut
        there and repeated words are resolved once; texts with other runs of white space are matched whole."""
        if len(self._young) > MEMO_WORDS:
            self._old, self._young = self._young, {}
        words = [(t or "").split(" ") for t in texts]
        self._learn({w for ws in words for w in ws[1:]} - self._young.keys())
        get, out = self._young.__getitem__, []
        for text, ws in zip(texts, words):
            first = ws[0]
            try:
                if first and first[-1].isspace():
                    raise TypeError
                out.append(b"".join([self._whole(first), *map(get, ws[1:])]))
            except TypeError:  # a None among them
                out.append(self._whole(text))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self._token.__getitem__, ids))


_LOADED: dict[str, TwoTierBpe] = {}


def _in_worker(shared, key: str) -> TwoTierBpe:
    """The worker's own copy, kept between tasks together with its memo."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = shared.value
    return _LOADED[key]


class BpeCodec:
    """Column functions ``encode(text)`` and ``decode(ids)`` for one rank file."""

    def __init__(self, spark, ranks_path: str, pattern: str):
        bound_batches(spark)
        ranks = read_ranks(ranks_path)
        self._key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
        self._shared = spark.sparkContext.broadcast(TwoTierBpe(ranks, pattern))  # as large as the vocabulary, not the data

    def encode(self, text: Column) -> Column:
        shared, key = self._shared, self._key

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            packed = _in_worker(shared, key).encode_packed(texts.to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

        return encode(text)

    def decode(self, ids: Column) -> Column:
        shared, key = self._shared, self._key

        @F.arrow_udf("binary")
        def decode(rows: pa.Array) -> pa.Array:
            model = _in_worker(shared, key)
            return pa.array([None if x is None else model.decode(x) for x in rows.to_pylist()], pa.binary())

        return decode(ids)

    def digest(self, ids: Column) -> Column:
        """Number of ids, SHA-256 of the packed ids and SHA-256 of what they decode to."""
        shared, key = self._shared, self._key

        @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
        def digest(rows: pa.Array) -> pa.Array:
            model = _in_worker(shared, key)
            n, packed, decoded = [], [], []
            for ids in rows:
                a = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
                n.append(len(a))
                packed.append(hashlib.sha256(a.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(model.decode(a.tolist())).hexdigest())
            return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(packed, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

        return digest(ids)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the token ids of ``text`` as column ``ids`` (an own column of that name is replaced)."""
    return docs.withColumn(ids, BpeCodec(docs.sparkSession, ranks_path, pattern).encode(F.col(text)))


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The bytes that ``ids`` stand for, as column ``out``."""
    return encoded.withColumn(out, BpeCodec(encoded.sparkSession, ranks_path, pattern).decode(F.col(ids)))
