"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Pieces of one length are interchangeable, so the packing is planned on the histogram of lengths (at
most ``capacity`` numbers, whatever the corpus size). The reduction fixes whole runs of sets that
provably dominate every alternative; best-fit decreasing packs the remainder, again in runs. The
plan is a list of patterns with multiplicities; each piece finds its place from its rank among the
pieces of its length.

Defined results: a null or empty text is one piece that holds only the end id; repeated rows are
packed as often as they occur; a null key is a key like any other; very long
texts are cut into pieces; pieces of one length are interchangeable; an added token of the tokenizer
file (such as its end mark) that stands in a text has its own id there, as in the library; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm.common import bound_batches, stage_table

CAPACITY, END_ID = 1024, 2
#: Pieces of one length and salt that are numbered in one task.
RUN = 2000
MEMO_WORDS = 250_000
#: Fixed by the byte-level pre-tokenizer of the tokenizer files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Pattern = tuple[tuple[int, int], ...]  # (length, copies) in the order placed


# ---------------------------------------------------------------- the plan, on the driver


def _fits(sizes: list[int], counts: Counter, most: int, but: Counter) -> int | None:
    """Largest available length of at most ``most``, with the pieces in ``but`` set aside."""
    k = bisect_right(sizes, most) - 1
    while k >= 0 and counts[sizes[k]] - but[sizes[k]] <= 0:
        k -= 1
    return sizes[k] if k >= 0 else None


def _smallest(sizes: list[int], counts: Counter, but: Counter, n: int) -> list[int]:
    out: list[int] = []
    for s in sizes:
        out += [s] * min(n - len(out), counts[s] - but[s])
        if len(out) == n:
            break
    return out


def _dominating(j: int, sizes: list[int], counts: Counter, capacity: int) -> list[int] | None:
    """A set with ``j`` that dominates every feasible set with ``j``, where the criterion proves one."""
    rest, own = capacity - j, Counter([j])
    big = _fits(sizes, counts, rest, own)
    if big is None:
        return [j]
    if big == rest:
        return [j, big]  # whatever else goes with j fits into the place of the one piece
    low = _smallest(sizes, counts, own, 3)
    if sum(low[:2]) > rest or len(low) < 2:
        return [j, big]  # at most one piece goes with j
    if len(low) == 3 and sum(low) <= rest:
        return None
    # At most two pieces go with j.
    second = _fits(sizes, counts, rest - big, own + Counter([big]))
    within = True  # {j, big, second} dominates
    alone = True  # {j, big} dominates
    for x in sizes:
        if x > big or counts[x] - own[x] <= 0:
            continue
        y = _fits(sizes, counts, min(x, rest - x), own + Counter([x]))
        if y is not None and x + y > big:
            alone = False
            if second is None or y > second:
                within = False
    return [j, big] if alone else [j, big, second] if within and second else None


def reduce_instance(counts: Counter, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets; takes the fixed pieces out of ``counts``."""
    fixed, again = [], True
    while again:
        again = False
        for j in sorted(counts, reverse=True):
            while counts[j] > 0:
                sizes = sorted(s for s, n in counts.items() if n > 0)
                found = _dominating(j, sizes, counts, capacity)
                if found is None:
                    break
                need = Counter(found)
                times = min(counts[s] // n for s, n in need.items())
                for s, n in need.items():
                    counts[s] -= n * times
                fixed.append((tuple(need.items()), times))
                again = True
    return fixed


def best_fit(counts: Counter, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing in runs: equal pieces go into equal bins together."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}

    def put(left: int, pattern: Pattern, n: int) -> None:
        if n:
            open_bins.setdefault(left, []).append((pattern, n))

    for size in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        n = counts[size]
        while n:
            left = min((r for r, bins in open_bins.items() if r >= size and bins), default=None)
            if left is None:
                left, pattern, bins = capacity, (), n
            else:
                pattern, bins = open_bins[left].pop()
                if not open_bins[left]:
                    del open_bins[left]
            each = left // size
            full = min(bins, n // each)
            put(left - each * size, (*pattern, (size, each)), full)
            n -= full * each
            bins -= full
            if n and bins:  # fewer than a bin takes
                put(left - n * size, (*pattern, (size, n)), 1)
                n, bins = 0, bins - 1
            if pattern:
                put(left, pattern, bins)
    return [x for bins in open_bins.values() for x in bins]


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used; together they hold exactly the pieces of the histogram."""
    counts = Counter(histogram)
    return reduce_instance(counts, capacity) + best_fit(counts, capacity)


def slot_table(plan: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Per run of equal pieces in a pattern: (length, first rank), first sequence, copies in a sequence, first offset.
    A sequence holds pieces of under 46 different lengths, and the plan has a few patterns for each length."""
    rows, ranks, sequence = [], Counter(), 0
    for pattern, times in plan:
        offset = 0
        for size, each in pattern:
            rows.append((size, ranks[size], sequence, each, offset))
            ranks[size] += each * times
            offset += size * each
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T))


# ---------------------------------------------------------------- tokens, on the executors


def _byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class FileTokenizer:
    """Ids of whole texts by a byte-level tokenizer file, as the library's encode() gives them. Words of Latin letters go
    through the merge table of the file in tiktoken's core; words with other characters, and texts that hold an added token
    of the file, through the tokenizers library itself."""

    def __init__(self, spec: str):
        self._library = Tokenizer.from_str(spec)
        file = json.loads(spec)
        alphabet = _byte_alphabet()
        added = sorted({t["content"] for t in file["added_tokens"]})
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in file["model"]["vocab"].items() if t not in added}
        self._added = regex.compile("|".join(map(regex.escape, added)) or r"(?!)").search
        self._core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._other = regex.compile(r"[^\x00-ɏ‐-‧]").search
        self._young: dict[str, bytes | None] = {}
        self._old: dict[str, bytes | None] = {}

    def _ids(self, text: str) -> bytes:
        ids = self._library.encode(text, add_special_tokens=False).ids if self._other(text) else self._core.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """A blank between two non-blanks begins a token, so that repeated words are encoded once."""
        if len(self._young) > MEMO_WORDS:
            self._old, self._young = self._young, {}
        young, old = self._young, self._old
        words = [(t or "").split(" ") for t in texts]
        for w in {w for ws in words for w in ws[1:]} - young.keys():
            young[w] = old[w] if w in old else None if not w or w[0].isspace() or w[-1].isspace() else self._ids(" " + w)
        out, get = [], young.__getitem__
        for text, ws in zip(texts, words):
            if text and self._added(text):  # cut at added tokens before words
                out.append(np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            try:
                if ws[0] and ws[0][-1].isspace():
                    raise TypeError
                out.append(b"".join([self._ids(ws[0]), *map(get, ws[1:])]))
            except TypeError:  # a None among them: white space that isn't single blanks
                out.append(self._ids(text))
        return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: whole ones, but for the first."""
    head = n % capacity
    return [(0, head)] * bool(head) + [(s, capacity) for s in range(head, n, capacity)]


_LOADED: dict[str, FileTokenizer] = {}


def _in_worker(shared, key: str) -> FileTokenizer:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = FileTokenizer(shared.value)
    return _LOADED[key]


class Packer:
    """Packs documents into sequences of at most ``capacity`` ids."""

    def __init__(self, spark, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID):
        bound_batches(spark)
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = f.read()
        self._key = hashlib.sha256(spec.encode()).hexdigest()
        self._shared = spark.sparkContext.broadcast(spec)  # as large as the vocabulary; the driver builds no tokenizer
        self.capacity, self.end_id = capacity, end_id

    def ids(self, text: Column) -> Column:
        """The ids of a text with the end id, as an array."""
        shared, key, end = self._shared, self._key, np.array([self.end_id], "<u4").tobytes()

        @F.arrow_udf("array<int>")
        def ids(texts: pa.Array) -> pa.Array:
            packed = [p + end for p in _in_worker(shared, key).encode_packed(texts.to_pylist())]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

        return ids(text)

    def _pieces(self, text: Column) -> Column:
        shared, key, end, capacity = self._shared, self._key, np.array([self.end_id], "<u4").tobytes(), self.capacity

        @F.arrow_udf("array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>")
        def pieces(texts: pa.Array) -> pa.Array:
            piece, start, length, crc, ends = [], [], [], [], [0]
            for p in _in_worker(shared, key).encode_packed(texts.to_pylist()):
                p = memoryview(p + end)
                cuts = cut(len(p) // 4, capacity)
                piece += range(len(cuts))
                start += [s for s, _ in cuts]
                length += [n for _, n in cuts]
                crc += [zlib.crc32(p[4 * s : 4 * (s + n)]) for s, n in cuts]
                ends.append(len(piece))
            columns = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["piece", "start", "length", "ids_crc32"]))

        return pieces(text)

    def pack(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Per piece: the document's key, piece, start, length, ids_crc32, sequence_id and offset."""
        spark = docs.sparkSession
        cuts = docs.select(F.col(key).alias("doc_id"), F.inline(self._pieces(F.col(text))))
        cuts = stage_table(cuts.withColumn("row", F.monotonically_increasing_id()), "pieces")  # stored, so that it stays
        counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
        partial = {n: k for n, k in counts.items() if n < self.capacity}
        table = spark.sparkContext.broadcast(slot_table(plan_packing(partial, self.capacity)))

        # A piece that fills a sequence needs no rank; its sequence numbers are below zero.
        whole = cuts.where(F.col("length") == self.capacity)
        whole = whole.withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("bigint")})
        # Ranks 0..n-1 within a length; a length has as many salts as it has runs, so that a frequent one is in many tasks.
        salts = spark.createDataFrame([(n, -(-k // RUN)) for n, k in sorted(counts.items())], "length bigint, salts bigint")  # at most `capacity` rows
        nth = F.pmod(F.xxhash64("row"), F.col("salts"))
        salted = cuts.where(F.col("length") < self.capacity).join(F.broadcast(salts), "length").withColumn("salt", nth).drop("salts")
        before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        sums = sums.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
        own = Window.partitionBy("length", "salt").orderBy("row")
        ranked = salted.withColumn("nth", F.row_number().over(own) - 1).join(sums, ["length", "salt"])

        @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
        def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
            t, size, rank = table.value, lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
            at = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                lo, hi = np.searchsorted(t["length"], [s, s + 1])
                here = size == s
                at[here] = lo - 1 + np.searchsorted(t["rank"][lo:hi], rank[here], side="right")
            sequence, nth = np.divmod(rank - t["rank"][at], t["each"][at])
            return pa.StructArray.from_arrays([pa.array(t["sequence"][at] + sequence, pa.int64()), pa.array(t["offset"][at] + nth * size, pa.int64())], ["sequence_id", "offset"])

        placed = ranked.withColumn("place", place("length", F.col("nth") + F.col("ahead")))
        placed = placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
        return placed.union(whole.select(*placed.columns))

    def sequences(self, docs: DataFrame, packed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """The packed sequences themselves: sequence_id and its ids. ``key`` has to identify the documents."""
        ids = docs.select(F.col(key).alias("doc_id"), self.ids(F.col(text)).alias("ids"))
        pieces = packed.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
        parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # at most `capacity` ids
        return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
