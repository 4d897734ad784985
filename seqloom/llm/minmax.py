"""MinHash near-duplicates by min-max hashing.

A document's set is that of its distinct shingles, as 64-bit hashes (two of a document's or pair's
shingles collide with a probability of about n^2 / 2^65). Each permutation yields two signature
values, the smallest and the largest hash under it: half as many hash evaluations as values, and as
the two come from different shingles their agreement estimates the similarity without bias and with
less variance than two permutations' minima. A band is two permutations, four values; documents of
similarity 0.8 agree in none of the 32 bands with a probability of 5e-8 for long sets, 6e-7 for sets of
five shingles, where minimum and maximum hang together most.

Equal sets are one class. Classes that share a band's bucket hang together in clusters (each bucket is
a star around its smallest member, never all its pairs), and links are confirmed on full sets within a
cluster: a task forms the sizes of all intersections of a bounded group of classes at once. Of a cluster
that is no bounded group, those classes go first that have too many shingles of their own to be similar to any other. It
is then dealt into blocks, with some of its classes as pivots in each. Links found so join most of it;
what is outside its largest component then meets every block, so that no pair that may join two
components goes unseen.

Defined results: a null, empty or blank text has the empty set, which is linked with nothing; a text
of fewer words than a shingle has its whole sequence as its one shingle; repeated rows are in one
group; rows without a key are grouped by their text, give a group no name and are never kept; a group of
such rows alone has a null component_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import bound_batches, stage_table
from seqloom.llm.components import connected_components
from seqloom.llm.simhash import shingles

WIDTH, SEED, PERCENT = 4, 7, 80
#: Permutations, and how many of them make a band.
PERMUTATIONS, ROWS = 64, 2
#: Classes and shingles that one task compares with each other; classes of a larger cluster that every block meets.
GROUP, GROUP_SHINGLES, PIVOTS = 1024, 1 << 21, 64
#: Different sets that can reach the similarity have so many shingles at least: 4 of 5.
LEAST = 4


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


_TIMES, _PLUS, _BAND = _odd(PERMUTATIONS, SEED), _odd(PERMUTATIONS, SEED + 1), _odd(2 * ROWS, SEED + 2)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingles' hashes."""
    parts = shingles((text or "").encode().lower().split(), width)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(p) for p in parts), np.uint64, len(parts)))


def signature(found: np.ndarray) -> np.ndarray:
    """(permutation, 2): smallest and largest value of a set that is not empty."""
    out = np.empty((PERMUTATIONS, 2), np.uint64)
    out[:, 0], out[:, 1] = np.iinfo(np.uint64).max, 0
    for k in range(0, len(found), 4096):
        h = found[None, k : k + 4096] * _TIMES[:, None] + _PLUS[:, None]
        np.minimum(out[:, 0], h.min(axis=1), out=out[:, 0])
        np.maximum(out[:, 1], h.max(axis=1), out=out[:, 1])
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """A bucket for each band, different ones for different bands."""
    values = signature(found).reshape(-1, 2 * ROWS)
    mixed = ((values ^ (values >> np.uint64(29))) * _BAND).sum(axis=1, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(2 * len(values) + 1) + np.arange(len(values), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


_MARKED = "n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"


def _marks(text: Column, width: int) -> Column:
    """Size, 128 bits that stand for the set, and its buckets (none where only equal sets can be linked)."""

    @F.arrow_udf(f"struct<{_MARKED.replace(' bigint', ':bigint').replace(' array', ':array')}>")
    def marks(texts: pa.Array) -> pa.Array:
        sizes, digests, bands, ends = [], [], [], [0]
        for t in texts:
            found = shingle_set(t.as_py(), width)
            sizes.append(len(found))
            digests.append(xxhash.xxh128_digest(found.tobytes()))
            if len(found) >= LEAST:
                bands.append(band_keys(found).view(np.int64))
            ends.append(ends[-1] + (PERMUTATIONS // ROWS if len(found) >= LEAST else 0))
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), lists], ["n_shingles", "set_a", "set_b", "bands"])

    return marks(text)


# ---------------------------------------------------------------- links of a group, within a task


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs. Shingles of many sets are multiplied as 0/1 columns, some at a time; those of
    few are added pair by pair; those of one set are in no intersection."""
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    value = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.empty(0, np.int64)
    counts = np.diff(np.append(starts, len(value)))
    shared = counts > 1
    starts, counts = starts[shared], counts[shared]
    many = counts > max(2, n // 64)
    step = max(1, (1 << 24) // n) if n else 1
    for k in range(0, int(many.sum()), step):
        s, c = starts[many][k : k + step], counts[many][k : k + step]
        at = np.repeat(s - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
        table = np.zeros((n, len(s)), np.float32)
        table[owner[at], np.repeat(np.arange(len(s)), c)] = 1
        out += table @ table.T
    for c in np.unique(counts[~many]):
        s = starts[~many & (counts == c)]
        for i in range(c):
            for j in range(c):
                if i != j:
                    out += np.bincount(owner[s + i] * n + owner[s + j], minlength=n * n).reshape(n, n)
    return out.astype(np.int64)


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that connect exactly the sets that chains of similar pairs connect, at most one for each set."""
    common, n = intersections(sets), np.array([len(s) for s in sets], np.int64)
    i, j = np.nonzero(100 * common >= percent * (n[:, None] + n[None, :] - common))
    root = np.arange(len(sets))
    while True:  # the smallest of each set's neighbours, till nothing moves
        low = root.copy()
        np.minimum.at(low, i, root[j])
        low = np.minimum(low, low[low])
        if np.array_equal(low, root):
            break
        root = low
    moved = np.flatnonzero(root != np.arange(len(sets)))
    return moved, root[moved]


def _confirm(width: int, percent: int):
    """Links of a partition that is sorted by group; a class may come repeatedly."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}

        def close() -> pa.RecordBatch:
            nodes = np.fromiter(held, np.int64, len(held))
            i, j = linked(list(held.values()), percent)
            return pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j])], ["u", "v"])

        for b in batches:
            for g, node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if g != group:
                    if len(held) > 1:
                        yield close()
                    group, held = g, {}
                if node not in held:
                    held[node] = shingle_set(text.as_py(), width)
        if len(held) > 1:
            yield close()

    return links


# ---------------------------------------------------------------- over tasks


def _clusters(classes: DataFrame) -> DataFrame:
    """(node, cluster, n_shingles, size, blocks) of the classes that share a bucket with another one."""
    dealt = stage_table(classes.select("node", F.explode("bands").alias("bucket")), "buckets")
    stars = dealt.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").select("bucket", "first")
    edges = dealt.join(stars, "bucket").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    grouped = connected_components(edges).withColumnRenamed("root", "cluster").join(classes.select("node", "n_shingles"), "node")
    return stage_table(_dealt(grouped), "clusters")


def _dealt(grouped: DataFrame) -> DataFrame:
    """Adds ``size`` and ``blocks``: 1, or where a cluster is beyond a group so many that two of them are one."""
    sizes = grouped.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("weight"))
    fits = (F.col("size") <= GROUP) & (F.col("weight") <= GROUP_SHINGLES)
    blocks = F.when(fits, 1).otherwise(F.greatest(F.ceil(2 * F.col("size") / GROUP), F.ceil(2 * F.col("weight") / GROUP_SHINGLES), F.lit(2)))
    return grouped.join(sizes.withColumn("blocks", blocks.cast("bigint")).drop("weight"), "cluster")


def _linkable(large: DataFrame, width: int, percent: int) -> DataFrame:
    """Without the classes that can be similar to none of their cluster, as too few of their shingles occur in another one."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in enumerate(b.column(2)):
                found = shingle_set(text.as_py(), width).view(np.int64)
                repeat = lambda c: pa.array(np.full(len(found), b.column(c)[k].as_py(), np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([repeat(0), repeat(1), pa.array(found)], ["cluster", "node", "shingle"])

    rows = large.select("cluster", "node", "text").mapInArrow(explode, "cluster bigint, node bigint, shingle bigint")
    own = rows.groupBy("cluster", "shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    lonely = own.groupBy("node").agg(F.count("*").alias("own"))
    kept = large.join(lonely, "node", "left").where(100 * (F.col("n_shingles") - F.coalesce("own", F.lit(0))) >= percent * F.col("n_shingles"))
    return _dealt(kept.drop("own", "size", "blocks"))


def _block(blocks: str = "blocks") -> Column:
    return F.pmod(F.xxhash64("node", F.lit(1)), F.col(blocks))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` its key ``doc_id``, ``n_shingles``, ``component_id``, the smallest key of those it is linked with over
    any number of links, and ``kept``: whether it is that one. Sets are linked from ``percent`` of their union in common; the bands are
    laid out for 80 and more."""
    if not 80 <= percent <= 100:
        raise ValueError("percent has to be within 80 to 100")
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    marked = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), _marks(F.col("text"), width).alias("m")).select("doc_id", "row_hash", "m.*")
    marked = stage_table(marked, "sets")
    one = F.min_by(F.struct("doc_id", "row_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash"))
    classes = marked.where("n_shingles > 0").groupBy("set_a", "set_b").agg(one.alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = stage_table(classes.select(F.monotonically_increasing_id().alias("node"), "set_a", "set_b", "one.*", "n_shingles", "bands"), "set-classes")
    clusters = _clusters(classes)

    # The text of one document of every class in a cluster, for the confirmation of its links.
    held = clusters.join(classes.select("node", "doc_id", "row_hash"), "node")
    at = lambda d: d.withColumns({"by_null": F.col("doc_id").isNull(), "by_key": F.coalesce("doc_id", F.lit(0))}).drop("doc_id")
    texts = at(docs.withColumn("row_hash", F.xxhash64("text"))).join(at(held), ["by_null", "by_key", "row_hash"]).select("node", "cluster", "n_shingles", "size", "blocks", "text")
    texts = stage_table(texts, "cluster-texts")
    confirm = lambda rows: stage_table(rows.repartition("group").sortWithinPartitions("group").mapInArrow(_confirm(width, percent), "u bigint, v bigint"), "links")
    grouped = lambda rows, *by: rows.select(F.concat_ws(":", "cluster", *by).alias("group"), "node", "text")

    links, large = confirm(grouped(texts.where("blocks = 1"))), texts.where("blocks > 1")
    if not large.isEmpty():
        large = stage_table(_linkable(large, width, percent), "cluster-texts").withColumn("block", _block())
        pivots = large.where(F.pmod(F.xxhash64("node", F.lit(2)), F.greatest(F.lit(1), F.floor(F.col("size") / PIVOTS))) == 0)
        each = pivots.where("blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        near = confirm(grouped(large.unionByName(each), "block"))
        links = links.unionByName(near).unionByName(confirm(_rest(large, near, grouped)))
    groups = connected_components(links)

    rooted = classes.join(groups, "node", "left").select("set_a", "set_b", "doc_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "root").select("set_a", "set_b", "component_id")
    out = marked.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _rest(large: DataFrame, links: DataFrame, grouped) -> DataFrame:
    """What is outside the largest component that the links made in a cluster, by blocks of its own, with every block."""
    found = connected_components(links)
    split = large.where("blocks > 1")  # the others have been compared whole
    labelled = split.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = labelled.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    # Blocks of the rest: as large as the others.
    main = main.where("most < all").withColumn("left", F.col("all") - F.col("most"))
    open_ = labelled.join(main, "cluster").withColumn("own", F.greatest(F.lit(1), F.ceil(F.col("blocks") * F.col("left") / F.col("all"))).cast("bigint"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    rest = open_.where("root <> main").withColumn("a", _block("own")).withColumn("b", numbers("blocks"))
    every = open_.withColumn("b", F.col("block")).withColumn("a", numbers("own"))
    columns = ["cluster", "node", "text", "a", "b"]
    return grouped(rest.select(*columns).unionByName(every.select(*columns)), "a", "b")
