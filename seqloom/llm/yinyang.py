"""Vector codes by product quantisation, the codebooks fitted by Yinyang Lloyd rounds in integers.

Components become integers, vectors are cut into equal parts, and every part position has a codebook
of its own. Its entries are put into groups once; for every vector and group a task keeps a lower bound
on the distance to the group's nearest entry but the vector's own. After a round the bounds sink by how far the
group's entries have moved, and only groups whose bound no longer exceeds the distance to the own
entry are scanned. Bounds are rounded down and compared with a margin, so that whatever could tie is decided by
exact integer distances. A round reads the table of the one before, chunks of vectors with their codes and bounds, and writes
its own, with one row a task of sums and counts, which Spark adds up by position; the driver sees a codebook's size of numbers.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter
vectors, empty ones too, are filled up with zeros to the longest one's length, this to a multiple of the parts. Rows
without a key are coded like others, but start an entry only where there are too few with one. Repeated rows count each;
of fewer vectors than entries all start one; an entry that repeats an earlier one is never chosen, ties go to the lower index, and
unused entries stay. Components too large for a distance in 64 bits are an error. Errors of rows with a
null label are added up together. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seqloom.llm.common import bound_batches, drop_table, stage_table

SCALE, PARTS, ENTRIES, ROUNDS, GROUPS = 4096, 8, 16, 6, 4
TOO_LARGE = "a component is too large for a distance in 64 bits"
_FAR = np.iinfo(np.int64).max


def quantised(vectors: list, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) as integers (vector, component), filled up with zeros."""
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return _checked(np.floor(out * scale))


def _checked(floors: np.ndarray) -> np.ndarray:
    if floors.size and 4 * np.abs(floors).max() ** 2 * floors.shape[1] >= 2.0**62:
        raise ValueError(TOO_LARGE)
    return floors.astype(np.int64)


def _from_arrow(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Of a list column without nulls; rows of one length without a step through Python."""
    if not (np.diff(column.offsets.to_numpy()) == dims).all():
        return quantised(column.to_pylist(), dims, scale)
    return _checked(np.floor(column.flatten().to_numpy().astype(np.float64).reshape(len(column), dims) * scale))


def entry_groups(entries: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Group of each entry of a codebook (entry, component): seeds as far from each other as can be, then three rounds."""
    entries = entries.astype(np.float64)
    away = lambda c: ((entries[:, None, :] - c[None]) ** 2).sum(axis=2)
    seeds = [0]
    while len(seeds) < min(groups, len(entries)):
        seeds.append(int(away(entries[seeds]).min(axis=1).argmax()))
    centres = entries[seeds]
    for _ in range(3):
        own = away(centres).argmin(axis=1)
        centres = np.stack([entries[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(len(centres))])
    return away(centres).argmin(axis=1)


def _below(x: np.ndarray) -> np.ndarray:
    """Single precision, never above x."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def reassign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray | None, group: np.ndarray, code: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of the parts ``x``, with ``moved`` the distance of each entry from its place in the round before (None:
    there was none). Returns codes, lower bounds by group, squared distances, and how many distances were computed."""
    own = ((x - entries[code]) ** 2).sum(axis=1)
    reach = np.sqrt(own.astype(np.float64))
    found, best, computed = own.copy(), code.copy(), len(x)
    scanned: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    low = np.full(lower.shape, np.inf, np.float32)
    for g in range(lower.shape[1]):
        members = np.flatnonzero(group == g)
        if not len(members):
            continue
        if moved is None:
            rows = np.arange(len(x))
        else:
            sunk = lower[:, g].astype(np.float64) - moved[members].max() * (1 + 1e-9)
            low[:, g] = _below(sunk)
            rows = np.flatnonzero(sunk <= reach * (1 + 1e-9) + 1e-6)
        if not len(rows):
            continue
        away = ((x[rows][:, None, :] - entries[members][None]) ** 2).sum(axis=2)
        computed += away.size
        first = away.argmin(axis=1)
        least, entry = away[np.arange(len(rows)), first], members[first]
        better = (least < found[rows]) | ((least == found[rows]) & (entry < best[rows]))
        found[rows[better]], best[rows[better]] = least[better], entry[better]
        scanned.append((g, rows, members, away))
    # The entry left behind counts for its group from now on.
    left = np.flatnonzero(best != code)
    low[left, group[code[left]]] = np.minimum(low[left, group[code[left]]], _below(reach[left]))
    for g, rows, members, away in scanned:
        away[members[None, :] == best[rows][:, None]] = _FAR
        least = away.min(axis=1)
        low[rows, g] = np.where(least == _FAR, np.float32(np.inf), _below(np.sqrt(least.astype(np.float64))))
    return best, low, found, computed


@dataclass
class Round:
    """What a task needs: all codebooks (part, entry, component), those of the round before, the entries' groups."""

    entries: np.ndarray
    before: np.ndarray | None
    group: np.ndarray

    def run(self, x: np.ndarray, codes: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """For chunk ``x`` (vector, part, component): codes, bounds, squared distances summed over parts, distances computed."""
        codes, low, error, computed = codes.copy(), np.empty_like(lower), np.zeros(len(x), np.int64), 0
        for p in range(x.shape[1]):
            moved = None if self.before is None else np.sqrt(((self.entries[p] - self.before[p]) ** 2).sum(axis=1).astype(np.float64))
            codes[:, p], low[:, p], found, n = reassign(x[:, p], self.entries[p], moved, self.group[p], codes[:, p].astype(np.int64), lower[:, p])
            error, computed = error + found, computed + n
        return codes, low, error, computed

    def sums(self, x: np.ndarray, codes: np.ndarray, into: np.ndarray) -> None:
        """Adds components and counts of each entry's parts to ``into`` (part, entry, component + 1)."""
        for p in range(x.shape[1]):
            for e in np.unique(codes[:, p]):
                mine = x[codes[:, p] == e, p]
                into[p, e, :-1] += mine.sum(axis=0)
                into[p, e, -1] += len(mine)


def _chunk(row: dict, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, groups, d = shape
    width = np.dtype(row["kind"])
    n = len(row["codes"]) // parts
    x = np.frombuffer(row["vectors"], width).astype(np.int64)
    return x.reshape(n, parts, d), np.frombuffer(row["codes"], np.uint8).reshape(n, parts), np.frombuffer(row["lower"], "<f4").reshape(n, parts, groups)


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    most = int(np.abs(x).max()) if x.size else 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind, x.astype(kind).tobytes()


@dataclass
class Layout:
    """How vectors are cut, and chunks of them kept between rounds."""

    dims: int
    parts: int
    scale: int
    groups: int

    @property
    def width(self) -> int:
        return self.dims // self.parts

    def first(self, rows: DataFrame, entries: int) -> np.ndarray:
        """The codebooks that the smallest keys' vectors start."""
        rows = rows.orderBy(F.asc_nulls_last("key"), "vector").limit(entries).select("vector").collect()
        x = quantised([r["vector"] for r in rows], self.dims, self.scale)
        return x.reshape(len(rows), self.parts, self.width).transpose(1, 0, 2)

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
        """Chunks of the source: all codes 0, no bounds."""
        for b in batches:
            n = b.num_rows
            if n:
                x = _from_arrow(b.column(2), self.dims, self.scale).reshape(n, self.parts, self.width)
                kind, packed = _packed(x)
                row = {"keys": b.column(0), "labels": b.column(1), "kind": kind, "vectors": packed}
                yield row, x, np.zeros((n, self.parts), np.uint8), np.zeros((n, self.parts, self.groups), np.float32)

    def held(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
        """Chunks of a round's table."""
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(n)[k].as_py() for n in ("kind", "vectors", "codes", "lower")}
                row |= {n: b.column(n)[k].values for n in ("keys", "labels")}
                yield row, *_chunk(row, (self.parts, self.groups, self.width))


def _chunk_schema(rows: DataFrame) -> T.StructType:
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    fields = [("keys", T.ArrayType(kinds["key"])), ("labels", T.ArrayType(kinds["label"])), ("kind", T.StringType()), ("vectors", T.BinaryType()), ("codes", T.BinaryType()), ("lower", T.BinaryType()), ("sums", T.ArrayType(T.LongType()))]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _row(schema: pa.Schema, row: dict) -> pa.RecordBatch:
    def cell(field):
        value = row.get(field.name)
        if isinstance(value, pa.Array):
            return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value).cast(field.type)
        return pa.array([value], field.type)

    return pa.RecordBatch.from_arrays([cell(f) for f in schema], schema=schema)


def _assigned(schema: pa.Schema, step: Round, chunks):
    shape = step.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, computed = np.zeros((shape[0], shape[1], shape[2] + 1), np.int64), 0
        for row, x, codes, lower in chunks(batches):
            codes, lower, _, n = step.run(x, codes, lower)
            step.sums(x, codes, total)
            computed += n
            yield _row(schema, row | {"codes": codes.tobytes(), "lower": lower.astype("<f4").tobytes()})
        if computed:
            yield _row(schema, {"sums": pa.array(np.append(total, computed), pa.int64())})

    return run


def _encoded(step: Round, chunks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x, codes, lower in chunks(batches):
            codes, _, error, _ = step.run(x, codes, lower)
            text = codes.tobytes().hex()
            size = 2 * codes.shape[1]
            code = [text[k : k + size] for k in range(0, len(text), size)]
            yield pa.RecordBatch.from_arrays([row["keys"], row["labels"], pa.array(code, pa.string()), pa.array(error)], ["key", "label", "code", "error"])

    return run


def _updated(entries: np.ndarray, table: DataFrame) -> tuple[np.ndarray, int]:
    """Entries as floors of their parts' means, and the distances that the round computed: one number a position."""
    rows = table.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    shape = (*entries.shape[:2], entries.shape[2] + 1)
    flat = np.zeros(math.prod(shape) + 1, np.int64)
    for r in rows:
        flat[r["at"]] = r["x"]
    total = flat[:-1].reshape(shape)
    count = total[:, :, -1:]
    return np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), entries), int(flat[-1])


def codebooks_text(entries: np.ndarray) -> str:
    return ",".join(map(str, entries.reshape(-1).tolist()))


@dataclass
class Compressed:
    """``rows``: key, label, code, error; the final codebooks; how many distances each round computed, of how many at most."""

    rows: DataFrame
    codebooks: np.ndarray
    computed: list[int]


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> Compressed | None:
    """Fit the codebooks to all vectors and code them; None where there are none."""
    if not 1 <= entries <= 256:
        raise ValueError("entries have to be within 1 to 256")
    bound_batches(vectors.sparkSession)
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(F.col("vector").isNotNull() & ~odd)
    longest = rows.agg(F.max(F.size("vector")).alias("m")).first()["m"]
    if longest is None:
        return None
    source, kept = Layout(-(-longest // parts) * parts, parts, scale, groups), _chunk_schema(rows)
    now = source.first(rows, entries)
    group = np.stack([entry_groups(c, groups) for c in now])
    step, table, computed = Round(now, None, group), None, []
    for _ in range(rounds):
        before, chunks = (rows, source.chunks) if table is None else (table.where("sums IS NULL"), source.held)
        last, table = table, stage_table(before.mapInArrow(_assigned(to_arrow_schema(kept), step, chunks), kept), "vector-codes")
        if last is not None:
            drop_table(last)
        after, n = _updated(step.entries, table)
        step = Round(after, step.entries, group)
        computed.append(n)
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = rows.mapInArrow(_encoded(Round(step.entries, None, group), source.chunks), schema) if table is None else table.where("sums IS NULL").mapInArrow(_encoded(step, source.held), schema)
    coded = stage_table(coded, "vector-codes")
    if table is not None:
        drop_table(table)
    return Compressed(coded, step.entries, computed)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``: the error summed over equal labels, nulls together."""
    total = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(codebooks_text(codebooks).encode()).hexdigest()


# ---------------------------------------------------------------- the same in SQL


def codes_sql(scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """Plain Lloyd rounds as a chain of tables: every part against every entry."""
    out = [
        f"""WITH v AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
)""",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, list_slice(q, part * (len(q) // {parts}) + 1, (part + 1) * (len(q) // {parts})) AS x FROM v, range({parts}) t(part))",
        f"c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))",
    ]
    for k in range(rounds + 1):
        away = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        out.append(f"a{k} AS MATERIALIZED (SELECT vec_id, label, p.part, x, min({away} * {entries} + entry) AS best FROM p JOIN c{k} ON p.part = c{k}.part GROUP BY ALL)")
        if k < rounds:
            out.append(f"s{k} AS (SELECT part, best % {entries} AS entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, best, x, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL)")
            out.append(f"m{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY part, entry)")
            out.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.part, c{k}.entry, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} ON m{k}.part = c{k}.part AND m{k}.entry = c{k}.entry)")
    out.append(f"d AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})")
    out.append(f"r AS (SELECT vec_id, label, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)")
    return ",\n".join(out) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, d"
