"""Ranked lexical search with block-max pruning.

The index is a table of blocks of consecutive documents. A block holds a forward index (each document's
terms and their impacts) and for every term of the block the highest impact that it has in one of
its documents. The sum of a query's weighted maxima bounds the score of every document of the block. The
block of highest bound of every query is scored first and gives a threshold; each task then takes its blocks
in order of their bounds and scores their documents until a bound falls below the query's threshold,
which rises with what the task has found. Blocks that reach it exactly are scored, as ties go to smaller keys.
Only counts, weights and thresholds of a block of queries pass through the driver.

Defined results: null texts and texts without a term are no documents; a document without a key counts in the
statistics and is never returned; repeated rows are documents each, also with the same key; equal scores rank by
ascending key. Queries without a key take no part, several texts of one key are one query of all their terms,
repeated terms count once; a query without a term that occurs has no result. Very long texts make blocks of their own.
Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import bound_batches, stage_table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Documents of a block, and bytes of text from which it is closed; blocks that a task orders by bound and scores together.
BLOCK, BLOCK_BYTES, TOGETHER = 64, 1 << 20, 16
#: Queries, and bytes of their texts, that one pass over the index answers.
QUERIES, QUERY_BYTES = 4096, 4 << 20
_INDEX = "keys array<bigint>, vocabulary binary, df binary, best binary, starts binary, terms binary, impact binary"
#: Lower case for A-Z; a space for every other ASCII character that is no digit or letter.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


# ---------------------------------------------------------------- the index


@dataclass
class Index:
    """``blocks``, a staged table with a number ``block``; documents and terms of all of them."""

    blocks: DataFrame
    documents: int
    terms: int


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts have a term, and how many terms they have."""
    documents = terms = 0
    for b in batches:
        for text in b.column(0):
            n = len(terms_of(text.as_py()))
            documents, terms = documents + (n > 0), terms + n
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], ["documents", "terms"])


def _blocks(documents: int, total: int, size: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int | None] = []
        counts: list[Counter] = []
        volume = 0

        def close() -> pa.RecordBatch:
            place: dict[bytes, int] = {}
            starts = np.cumsum([0, *map(len, counts)])
            terms = np.fromiter((place.setdefault(t, len(place)) for c in counts for t in c), np.int64, starts[-1])
            tf = np.fromiter((n for c in counts for n in c.values()), np.int64, starts[-1])
            length = [10 + 90 * sum(c.values()) * documents // total for c in counts]
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(np.array(length, np.int64), np.diff(starts)))
            best = np.zeros(len(place), np.int64)
            np.maximum.at(best, terms, impact)
            cells = [b" ".join(place), np.bincount(terms, minlength=len(place)).astype("<i4"), best.astype("<i4"), starts.astype("<i4"), terms.astype("<i4"), impact.astype("<i4")]
            columns = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.array(keys, pa.int64()))]
            columns += [pa.array([c if isinstance(c, bytes) else c.tobytes()], pa.binary()) for c in cells]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _INDEX.split(", ")])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = Counter(terms_of(text.as_py()))
                if not found:
                    continue
                keys.append(key)
                counts.append(found)
                volume += len(text.as_buffer())
                if len(keys) == size or volume >= BLOCK_BYTES:
                    yield close()
                    keys, counts, volume = [], [], 0
        if keys:
            yield close()

    return build


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = BLOCK) -> Index | None:
    """None where no document has a term."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    n = docs.select("text").mapInArrow(_sizes, "documents bigint, terms bigint").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).first()
    if not n["documents"]:
        return None
    blocks = docs.mapInArrow(_blocks(n["documents"], n["terms"], size), _INDEX)
    return Index(stage_table(blocks.withColumn("block", F.monotonically_increasing_id()), "forward-index"), n["documents"], n["terms"])


# ---------------------------------------------------------------- queries


@dataclass
class Queries:
    """A bounded set of queries: ``spans`` of ``flat``, the places in ``vocabulary`` of each one's terms; weights by place."""

    keys: list
    vocabulary: dict[bytes, int]
    flat: np.ndarray
    starts: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @classmethod
    def of(cls, rows: list) -> Queries:
        found: dict = {}
        for key, text in rows:
            found.setdefault(key, {}).update(dict.fromkeys(terms_of(text)))
        found = {k: t for k, t in found.items() if t}
        place: dict[bytes, int] = {}
        flat = np.array([place.setdefault(t, len(place)) for terms in found.values() for t in terms], np.int64)
        return cls(list(found), place, flat, np.cumsum([0, *map(len, found.values())])[:-1].astype(np.int64))

    def terms(self, q: int) -> np.ndarray:
        return self.flat[self.starts[q] : self.starts[q + 1] if q + 1 < len(self.starts) else None]

    def match(self, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places in a block's vocabulary of the queries' terms, and the queries' places of these."""
        look = self.vocabulary.get
        mine = np.array([look(t, -1) for t in vocabulary.split(b" ")], np.int64)
        hit = np.flatnonzero(mine >= 0)
        return hit, mine[hit]

    def bounds(self, hit: np.ndarray, mine: np.ndarray, best: np.ndarray) -> np.ndarray:
        value = np.zeros(len(self.vocabulary), np.int64)
        value[mine] = self.weight[mine] * best[hit]
        return np.add.reduceat(value[self.flat], self.starts)


def _frequencies(index: Index, queries: Queries) -> np.ndarray:
    """Documents that hold each of the queries' terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(queries.vocabulary), np.int64)
        for b in batches:
            for vocabulary, df in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hit, mine = queries.match(vocabulary)
                total[mine] += np.frombuffer(df, "<i4")[hit]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "df"])

    counted = index.blocks.select("vocabulary", "df").mapInArrow(count, "place bigint, df bigint").groupBy("place").agg(F.sum("df").alias("df"))
    out = np.zeros(len(queries.vocabulary), np.int64)
    for r in counted.collect():  # a row a term of these queries
        out[r["place"]] = r["df"]
    return out


def _best_blocks(index: Index, queries: Queries) -> list[int]:
    """The block of highest bound of each query."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, at = np.zeros(len(queries.keys), np.int64), np.zeros(len(queries.keys), np.int64)
        for b in batches:
            for block, vocabulary, best in zip(*(b.column(k).to_pylist() for k in range(3))):
                found = queries.bounds(*queries.match(vocabulary), np.frombuffer(best, "<i4").astype(np.int64))
                better = found > top
                top[better], at[better] = found[better], block
        some = np.flatnonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(top[some]), pa.array(at[some])], ["query", "bound", "block"])

    found = index.blocks.select("block", "vocabulary", "best").mapInArrow(bound, "query bigint, bound bigint, block bigint")
    first = found.groupBy("query").agg(F.max_by("block", F.struct("bound", "block")).alias("block")).select("block").distinct()
    return sorted(r["block"] for r in first.collect())  # at most one a query


class _Found:
    """The best documents of each query that a task has seen, and the score below which none matters."""

    def __init__(self, floor: np.ndarray, top: int):
        self.floor, self.top = floor.copy(), top
        self.score: list[np.ndarray] = [np.empty(0, np.int64)] * len(floor)
        self.key: list[np.ndarray] = [np.empty(0, np.int64)] * len(floor)

    def add(self, q: int, score: np.ndarray, key: np.ndarray) -> None:
        some = score >= max(self.floor[q], 1)
        if not some.any():
            return
        score, key = np.append(self.score[q], score[some]), np.append(self.key[q], key[some])
        order = np.lexsort((key, -score))[: self.top]
        self.score[q], self.key[q] = score[order], key[order]
        if len(order) == self.top:
            self.floor[q] = max(self.floor[q], score[order[-1]])


class _Block:
    def __init__(self, row: dict, queries: Queries):
        self.row = row
        self.hit, self.mine = queries.match(row["vocabulary"])
        self.bounds = queries.bounds(self.hit, self.mine, np.frombuffer(row["best"], "<i4").astype(np.int64))
        self.table: np.ndarray | None = None

    def open(self, queries: Queries) -> None:
        """The weighted impacts (document, query term) from the forward index; documents without a key are left out."""
        keys, starts, terms, impact = self.row["keys"], *(np.frombuffer(self.row[c], "<i4") for c in ("starts", "terms", "impact"))
        column = np.full(int(terms.max()) + 1, -1, np.int64)
        column[self.hit] = np.arange(len(self.hit))
        doc, at = np.repeat(np.arange(len(keys)), np.diff(starts)), column[terms]
        some = at >= 0
        table = np.zeros((len(keys), len(self.hit) + 1), np.int64)
        table[doc[some], at[some]] = queries.weight[self.mine[at[some]]] * impact[some].astype(np.int64)
        named = np.array([k is not None for k in keys])
        self.keys, self.table = np.array([k for k in keys if k is not None], np.int64), table[named]
        # Of each of the queries' terms; the last column is empty.
        self.column = np.full(len(queries.vocabulary), len(self.hit), np.int64)
        self.column[self.mine] = np.arange(len(self.hit))


def _scored(queries: Queries, floor: np.ndarray, top: int):
    names = ["keys", "vocabulary", "best", "starts", "terms", "impact"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, blocks = _Found(floor, top), 0
        for b in batches:
            for k in range(0, b.num_rows, TOGETHER):
                part = [_Block(r, queries) for r in b.slice(k, TOGETHER).to_pylist()]
                bounds = np.stack([p.bounds for p in part])
                order = np.argsort(-bounds, axis=0, kind="stable")
                for q in range(len(queries.keys)):
                    for at in order[:, q]:
                        if bounds[at, q] < max(found.floor[q], 1):
                            break
                        if part[at].table is None:
                            part[at].open(queries)
                        found.add(q, part[at].table[:, part[at].column[queries.terms(q)]].sum(axis=1), part[at].keys)
        counts = [len(s) for s in found.score]
        if sum(counts):
            columns = [np.repeat(np.arange(len(counts)), counts), np.concatenate(found.key), np.concatenate(found.score)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "key", "score"])

    return lambda blocks: blocks.select(*names).mapInArrow(score, "query bigint, key bigint, score bigint")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("key")))
    return found.withColumn("rank", nth).where(F.col("rank") <= top)


def _answers(index: Index, queries: Queries, top: int) -> DataFrame:
    df = _frequencies(index, queries).tolist()
    queries.weight = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * n + 1))) for n in df], np.int64)
    floor = np.zeros(len(queries.keys), np.int64)
    first = F.broadcast(index.blocks.sparkSession.createDataFrame([(k,) for k in _best_blocks(index, queries)], "block bigint"))  # a row a query at most
    seen = _ranked(_scored(queries, floor, top)(index.blocks.join(first, "block")), top).where(F.col("rank") == top)
    for r in seen.collect():
        floor[r["query"]] = r["score"]
    return _ranked(_scored(queries, floor, top)(index.blocks), top)


def search(index: Index | None, items: DataFrame, key: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """The highest-scoring documents of each query: its key (named as in ``items``), ``rank`` from 1, ``doc_id``, ``score``."""
    spark = items.sparkSession
    kind = items.select(F.col(key)).schema[0].dataType
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("item", kind)])
    items = items.select(F.col(key).alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, -(-size["n"] // QUERIES), -(-(size["bytes"] or 0) // QUERY_BYTES))
    out = None
    for part in range(parts if index is not None else 0):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()  # about QUERIES rows of QUERY_BYTES
        queries = Queries.of([(r["item"], r["text"]) for r in rows])
        if queries.keys:
            named = spark.createDataFrame(list(enumerate(queries.keys)), schema)
            found = _answers(index, queries, top).join(F.broadcast(named), "query")
            found = found.select("item", F.col("rank").cast("int").alias("rank"), F.col("key").alias("doc_id"), "score")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], T.StructType([T.StructField("item", kind)])).selectExpr("item", "0 AS rank", "0L AS doc_id", "0L AS score")
    return out.select(F.col("item").alias(key), "rank", "doc_id", "score")


# ---------------------------------------------------------------- the same in SQL


def search_sql(top: int = TOP) -> str:
    """Every document's score for every query, ranked."""
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    words = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '{TERM}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents WHERE text IS NOT NULL),
n AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN df USING (term), g),
s AS (
    SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
    FROM w JOIN tf USING (term) JOIN n USING (r), g GROUP BY item_id, r
),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN n USING (r) WHERE doc_id IS NOT NULL AND score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= {top}"""
