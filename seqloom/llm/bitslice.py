"""Exact top-k inner-product search on a bit-sliced index.

Each component of a vector becomes an integer; a chunk of the index holds, for every component and
binary place, one bitmap over the chunk's rows. A query's score is added up for all rows of a chunk
at once by carry-save bitmap arithmetic: the query's components are written with signed binary
digits, each digit adds the (shifted, or complemented) slices of its component. The best rows are
read off the sum from its most significant slice down; rows that tie at the boundary are resolved
exactly, by key. Chunks' results are merged by score and key, first within a task, then over tasks.

Defined results: vectors that are null or hold a null or non-finite component, and rows without a
key take no part; a finite component that does not fit a long after scaling, and a result whose score
does not fit one, are errors; vectors of different length meet in their
common components; equal scores rank by smaller key; rows that share the query's key are its own
and no candidates; other repeated rows are candidates each. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import bound_batches, new_table, stage_table

SCALE, TOP, EVERY = 256, 5, 50
#: Rows of an index chunk; queries, and bytes of their components, that are broadcast together and answered in one pass over the index
#: (they and their answers are all a task holds besides a chunk).
CHUNK, QUERY_BLOCK, QUERY_BYTES = 16_384, 65_536, 32 << 20
NO_FIT = "a score does not fit a long"
_INDEX = "n int, places int, dims int, least bigint, keys binary, slices binary"


def quantise(vectors: pa.Array, scale: int = SCALE, strict: bool = False) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector; None for one that takes no part. One that is finite but does not fit longs is
    None as well, or an error if ``strict``."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        items = v.values if v.is_valid else None
        if items is None or items.null_count:
            out.append(None)
            continue
        raw = items.to_numpy(zero_copy_only=False).astype(np.float64)
        if not np.isfinite(raw).all():
            out.append(None)
            continue
        with np.errstate(over="ignore"):
            x = np.floor(scale * raw)
        fits = ((x >= -(2.0**63)) & (x < 2.0**63)).all()
        if strict and not fits:
            raise ValueError(f"a component does not fit a long after scaling: {raw[np.abs(raw).argmax()]}")
        out.append(x.astype(np.int64) if fits else None)
    return out


# ---------------------------------------------------------------- the index


def slice_rows(keys: np.ndarray, rows: list[np.ndarray]) -> dict:
    """One chunk, its rows in the order of their keys."""
    order = np.argsort(keys, kind="stable")
    n, dims = len(rows), max((len(r) for r in rows), default=0)
    x = np.zeros((n, dims), np.int64)
    for i, k in enumerate(order):
        x[i, : len(rows[k])] = rows[k]
    least = int(x.min()) if x.size else 0
    x = x.view(np.uint64) - np.int64(least).view(np.uint64)  # modulo 2**64, where every difference has its place
    places = int(x.max()).bit_length() if x.size else 0
    words = -(-n // 64)
    bits = np.zeros((dims, places, words * 8), np.uint8)
    for p in range(places):
        bits[:, p, : -(-n // 8)] = np.packbits(((x >> np.uint64(p)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
    return {"n": n, "places": places, "dims": dims, "least": least, "keys": keys[order].astype("<i8").tobytes(), "slices": bits.tobytes()}


def _build(scale: int, size: int):
    kind = pa.schema([("n", pa.int32()), ("places", pa.int32()), ("dims", pa.int32()), ("least", pa.int64()), ("keys", pa.binary()), ("slices", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = [], []
        for b in batches:
            for key, x in zip(b.column(0).to_pylist(), quantise(b.column(1), scale, strict=True)):
                if x is not None:
                    keys.append(key)
                    rows.append(x)
                    if len(rows) == size:
                        yield pa.RecordBatch.from_pylist([slice_rows(np.array(keys), rows)], kind)
                        keys, rows = [], []
        if rows:
            yield pa.RecordBatch.from_pylist([slice_rows(np.array(keys), rows)], kind)

    return build


# ---------------------------------------------------------------- bitmap arithmetic


def signed_digits(q: np.ndarray) -> np.ndarray:
    """Digits -1, 0, 1 by component and place, no two neighbours both set: q = sum of digit * 2**place."""
    n, out, q = len(q), [], q.astype(np.int64).copy()
    while q.any():
        odd = q & 1
        d = odd * (2 - (q & 3))
        out.append(d)
        q = (q >> 1) + (d < 0)  # (q - d) / 2, which cannot overflow
    return np.array(out, np.int64).reshape(len(out), n).T


def _carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def add_columns(columns: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Sum of bitmaps by weight; the slices of the result from weight 0 up."""
    out, w = [], 0
    while w <= max(columns, default=-1):
        stack = np.concatenate(columns.pop(w)) if columns.get(w) else np.zeros((0, words), np.uint64)
        carries = columns.setdefault(w + 1, [])
        while len(stack) > 2:
            t = len(stack) // 3
            s, c = _carry_save(stack[:t], stack[t : 2 * t], stack[2 * t : 3 * t])
            carries.append(c)
            stack = np.concatenate([s, stack[3 * t :]])
        if len(stack) == 2:
            carries.append((stack[0] & stack[1])[None])
            stack = (stack[0] ^ stack[1])[None]
        if not carries:
            del columns[w + 1]
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        w += 1
    return out


class Chunk:
    """An index chunk in memory."""

    def __init__(self, n: int, places: int, dims: int, least: int, keys: bytes, slices: bytes):
        self.n, self.places, self.dims, self.least = n, places, dims, least
        self.keys = np.frombuffer(keys, "<i8")
        self.words = -(-n // 64)
        self.slices = np.frombuffer(slices, "<u8").reshape(dims, places, self.words)
        self.turned = ~self.slices  # 2**places - 1 - x; bits beyond the rows are masked when rows are selected
        rows = np.zeros(self.words * 64, np.uint8)
        rows[:n] = 1
        self.rows = np.packbits(rows, bitorder="little").view("<u8")

    def score_slices(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices of the score of every row, up to a constant."""
        digits = signed_digits(q[: self.dims])
        columns: dict[int, list[np.ndarray]] = {}
        width = digits.shape[1] if self.places else 0
        carried: list[np.ndarray] = []
        b = 0
        while b < width or carried:
            stack = [np.zeros((0, self.places, self.words), np.uint64), *carried]
            if b < width:
                d = digits[:, b]
                stack += [self.slices[: len(d)][d > 0], self.turned[: len(d)][d < 0]]
            stack, carried = np.concatenate(stack), []
            while len(stack) > 2:  # whole numbers, all their places at once
                t = len(stack) // 3
                s, c = _carry_save(stack[:t], stack[t : 2 * t], stack[2 * t : 3 * t])
                carried.append(c)
                stack = np.concatenate([s, stack[3 * t :]])
            for p in range(self.places):
                columns.setdefault(b + p, []).append(stack[:, p])
            b += 1
        return add_columns(columns, self.words)

    def select(self, slices: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
        """Rows of the k largest sums; among equals at the boundary those with the smallest keys."""
        sure, tied = np.zeros(self.words, np.uint64), allowed
        for s in reversed(slices):
            more = sure | (tied & s)
            n = int(np.bitwise_count(more).sum())
            if n > k:
                tied = tied & s
            else:
                sure, tied = more, tied & ~s
                if n == k:
                    break
        at = self._positions(sure)
        return np.concatenate([at, self._positions(tied)[: k - len(at)]])

    def _positions(self, bitmap: np.ndarray) -> np.ndarray:
        full = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[full].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        return full[row] * 64 + bit

    def exact(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Scores of rows, from their slices; Python integers where they might not fit a long."""
        word, bit = at // 64, (at % 64).astype(np.uint64)
        ones = (self.slices[:, :, word] >> bit) & np.uint64(1)
        x = (ones << np.arange(self.places, dtype=np.uint64)[None, :, None]).sum(axis=1, dtype=np.uint64)
        x = (x + np.int64(self.least).view(np.uint64)).view(np.int64)
        m = min(self.dims, len(q))
        q, x = q[:m], x[:m]
        if (np.abs(q.astype(np.float64)) @ np.abs(x.astype(np.float64)) < 2.0**62).all():
            return q @ x
        return q.astype(object) @ x.astype(object)

    def top(self, key: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and scores of the k best rows but the query's own."""
        allowed = self.rows
        lo, hi = np.searchsorted(self.keys, [key, key + 1])
        if lo < hi:
            allowed = allowed.copy()
            for i in range(lo, hi):
                allowed[i // 64] &= ~(np.uint64(1) << np.uint64(i % 64))
        at = self.select(self.score_slices(q), allowed, k)
        return self.keys[at], self.exact(at, q)


# ---------------------------------------------------------------- the search


def fitting(score: int) -> int | None:
    """The score; None, which ranks last, if it is below every long. One above them is an error at once, since it or a
    better one is among the results."""
    if score >= 1 << 63:
        raise ValueError(NO_FIT)
    return score if score >= -(1 << 63) else None


def build_index(vectors: DataFrame, key: str, vector: str, scale: int = SCALE, size: int = CHUNK) -> DataFrame:
    """The index as a table of chunks in the shared folder, spread over files so that all tasks get some."""
    spark = vectors.sparkSession
    bound_batches(spark)
    chunks = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(vector)).where("key is not null").mapInArrow(_build(scale, size), _INDEX)
    return stage_table(chunks.repartition(2 * spark.sparkContext.defaultParallelism), "bit-slices")


class Best:
    """The k best rows of each query so far: scores fall, equal ones are by key."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def add(self, query: int, keys: np.ndarray, scores: np.ndarray) -> None:
        new = [(-s, key) for s, key in zip(scores.tolist(), keys.tolist())]
        self.rows[query] = sorted(self.rows.get(query, []) + new)[: self.k]

    def batch(self) -> pa.RecordBatch:
        rows = [(q, key, fitting(-s)) for q, own in self.rows.items() for s, key in own]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["query_id", "vec_id", "score"])


def search(index: DataFrame, queries: DataFrame, key: str, vector: str, k: int = TOP, scale: int = SCALE, block: int = QUERY_BLOCK) -> DataFrame:
    """For each query its k best rows: query_id, rank, vec_id, score. Queries are taken in blocks of bounded size, each a
    broadcast that passes once over the index; all blocks' answers, k of each query and task, are one table."""
    spark = index.sparkSession
    wanted = queries.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vector")).where("key is not null").distinct()
    size = wanted.agg(F.count("*").alias("n"), F.sum(8 * F.greatest(F.lit(1), F.size("vector"))).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block), -(-(size["bytes"] or 0) // QUERY_BYTES))
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    if blocks > 1:
        wanted = stage_table(wanted, "queries", "block")
    path, found = new_table(spark, "answers"), None
    for b in range(blocks):
        rows = wanted.where(F.col("block") == b).select("key", "vector").toArrow().combine_chunks()  # about `block` queries
        vectors = rows.column("vector").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float64()))
        asked = spark.sparkContext.broadcast([(k_, q) for k_, q in zip(rows.column("key").to_pylist(), quantise(vectors, scale, strict=True)) if q is not None])

        def answer(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            best = Best(k)
            for batch in batches:
                for row in batch.to_pylist():
                    chunk = Chunk(**row)
                    for key_, q in asked.value:
                        best.add(key_, *chunk.top(key_, q, k))
            yield best.batch()

        found = index.mapInArrow(answer, "query_id bigint, vec_id bigint, score bigint")
        if blocks > 1:
            found.write.mode("append").parquet(path)
            asked.unpersist()
    if blocks > 1:
        found = spark.read.schema(found.schema).parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    score = F.coalesce("score", F.raise_error(F.lit(NO_FIT)).cast("bigint"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
