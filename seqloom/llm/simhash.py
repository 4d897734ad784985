"""Near-duplicate groups: SimHash fingerprints joined with themselves in a binary trie.

A fingerprint is a leaf of a binary trie; the join walks pairs of nodes together, adds up the bits
in which they differ and drops a pair once it exceeds the Hamming budget. To spread the walk over
tasks, the trie is built over permuted fingerprints: of ``budget + 1`` disjoint blocks of bits at
least one is equal in any pair within the budget, so with each block in turn as the top of the trie
only pairs of equal top nodes are walked. Subtries that hold too many fingerprints are split again
by the same rule on their remaining bits, until each fits one task; no pair is lost.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; a
text of one or two words has its whole sequence as its one shingle; repeated rows are in one group; rows
without a key are grouped by their text, and a group of such rows alone has a null component_id; a bit that exactly half of the
shingles have is 0; texts of any length are read whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import bound_batches, stage_table
from seqloom.llm.components import connected_components

SHINGLE, SEED, BUDGET = 3, 42, 2
#: Largest subtrie that one task walks without splitting it again.
SUBTRIE = 4096
#: Rows of whole subtries walked together, and pairs compared at once.
FOREST_ROWS, PAIRS_AT_ONCE, LEAF = 100_000, 500_000, 32


# ---------------------------------------------------------------- fingerprints


def shingles(words: list[bytes], width: int = SHINGLE) -> list[bytes]:
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(width)))))


def fingerprint_of(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint: a bit is set if over half of the shingles' hashes have it."""
    parts = shingles((text or "").encode().lower().split(), width)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for k in range(0, len(parts), 1 << 16):
        block = parts[k : k + (1 << 16)]
        h = np.fromiter((digest(p, seed) for p in block), "<u8", len(block))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(parts), bitorder="little").view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint_of(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64), pa.int64())

    return simhash(text)


# ---------------------------------------------------------------- the trie, within a task


def _join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the trees of rows i and j; ``root`` stays flat."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def _compare(bits: np.ndarray, root: np.ndarray, nodes: np.ndarray, budget: int) -> None:
    """Compare all leaves of node pairs (alo, ahi, blo, bhi), as many at once as PAIRS_AT_ONCE allows."""
    count = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
    ends = np.cumsum(count)
    lo = 0
    while lo < len(nodes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
        part, n = nodes[lo:hi], count[lo:hi]
        at = np.repeat(np.arange(len(part)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = (part[:, 3] - part[:, 2])[at]
        i, j = part[at, 0] + nth // width, part[at, 2] + nth % width
        near = (i < j) & (np.bitwise_count(bits[i] ^ bits[j]) <= budget)
        _join_roots(root, i[near], j[near])
        lo = hi


def walk_tries(bits: np.ndarray, starts: np.ndarray, depth: int, budget: int = BUDGET) -> np.ndarray:
    """``bits``: permuted fingerprints, sorted within each trie; ``starts``: where each trie begins; all leaves of a
    trie agree in the first ``depth`` bits. Returns for each row the first row it is connected to within its trie."""
    n = len(bits)
    root = np.arange(n)
    ends = np.append(starts[1:], n)
    # alo, ahi, blo, bhi, differing bits so far
    pairs = np.stack([starts, ends, starts, ends, np.zeros(len(starts), np.int64)], axis=1).astype(np.int64)
    while len(pairs):
        same = pairs[:, 0] == pairs[:, 2]
        pairs = pairs[~same | (pairs[:, 1] - pairs[:, 0] > 1)]
        few = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= LEAF
        if depth == 64:
            few[:] = True
        _compare(bits, root, pairs[few, :4], budget)
        pairs = pairs[~few]
        if not len(pairs):
            break
        ones = np.concatenate([[0], np.cumsum((bits >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)])
        alo, ahi, blo, bhi, bad = pairs.T
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = alo == blo
        apart = ~same
        below = [
            np.stack([alo, amid, blo, bmid, bad], axis=1),
            np.stack([amid, ahi, bmid, bhi, bad], axis=1),
            np.stack([alo, amid, bmid, bhi, bad + 1], axis=1),
            np.stack([amid, ahi, blo, bmid, bad + 1], axis=1)[apart],
        ]
        pairs = np.concatenate(below)
        pairs = pairs[(pairs[:, 4] <= budget) & (pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]
        depth += 1
    return root


def _forest(depth: int, budget: int):
    """Walks the tries of a partition that is sorted by (path, top), some whole tries at a time."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk(held: list[np.ndarray]) -> pa.RecordBatch:
            path, top, bits, print_ = (np.concatenate([h[k] for h in held]) for k in range(4))
            order = np.lexsort((bits.view(np.uint64), top, path))
            path, top, bits, print_ = path[order], top[order], bits[order].view(np.uint64), print_[order]
            new = np.concatenate([[True], (path[1:] != path[:-1]) | (top[1:] != top[:-1])])
            root = walk_tries(bits, np.flatnonzero(new), depth, budget)
            linked = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(print_[linked]), pa.array(print_[root[linked]])], ["u", "v"])

        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            held.append(cols)
            rows += b.num_rows
            if rows >= FOREST_ROWS:  # all but the last trie, which may go on
                cols = [np.concatenate([h[k] for h in held]) for k in range(4)]
                last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
                if not last.all():
                    yield walk([[c[~last] for c in cols]])
                held = [[c[last] for c in cols]]
                rows = int(last.sum())
        if held:
            yield walk(held)

    return links


# ---------------------------------------------------------------- the join, over tasks


def _rotate_low(bits: Column, width: int, by: int) -> Column:
    """Rotate the low ``width`` bits left by ``by``; the bits above stay."""
    if by == 0:
        return bits
    mask = (1 << width) - 1
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("bigint")
    low = bits.bitwiseAND(signed(mask))
    turned = F.shiftleft(low, by).bitwiseAND(signed(mask)).bitwiseOR(F.shiftrightunsigned(low, width - by))
    return bits.bitwiseAND(signed(((1 << 64) - 1) ^ mask)).bitwiseOR(turned)


def hamming_links(prints: DataFrame, budget: int = BUDGET, subtrie: int = SUBTRIE) -> DataFrame:
    """Links (u, v) that connect exactly the distinct fingerprints ``print`` that chains of pairs within ``budget`` bits
    connect; at most one link for each fingerprint, permutation and level."""
    rows = prints.select("print", F.col("print").alias("bits"), F.lit(0).cast("bigint").alias("path"))
    depth, found = 0, None
    while True:
        block = max(1, (64 - depth) // (budget + 1))
        turns = [rows.select("print", _rotate_low(F.col("bits"), 64 - depth, k * block).alias("bits"), (F.col("path") * (budget + 1) + k).alias("path")) for k in range(budget + 1)]
        rows, depth = turns[0].union(turns[1]), depth + block
        for t in turns[2:]:
            rows = rows.union(t)
        rows = rows.withColumn("top", F.shiftrightunsigned("bits", 64 - depth))
        sizes = rows.groupBy("path", "top").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        sizes = stage_table(sizes, "subtries")
        large = sizes.where(F.col("n") > subtrie).select("path", "top")
        last = depth >= 64 - budget or large.isEmpty()
        here = rows.join((sizes if last else sizes.where(F.col("n") <= subtrie)).select("path", "top"), ["path", "top"], "left_semi")
        dealt = here.select("path", "top", "bits", "print").repartition("path", "top").sortWithinPartitions("path", "top")
        links = dealt.mapInArrow(_forest(depth, budget), "u bigint, v bigint")
        found = links if found is None else found.union(links)
        if last:
            return found
        rows = stage_table(rows.join(large, ["path", "top"], "left_semi").select("print", "bits", "path"), "subtrie-rows")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """Per document its key, ``row_hash`` (of the text), ``print``, the group's smallest print ``root`` and ``component_id``:
    the smallest key in the group."""
    bound_batches(docs.sparkSession)
    marked = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("row_hash"), fingerprint(F.col(text)).alias("print"))
    marked = stage_table(marked, "fingerprints")
    prints = stage_table(marked.groupBy("print").agg(F.min("doc_id").alias("first")), "prints")
    groups = connected_components(hamming_links(prints, budget))
    rooted = prints.join(groups, prints["print"] == groups["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("print", "root", "component_id")
    return marked.join(named, "print").select("doc_id", "row_hash", "print", "root", "component_id")


def hexadecimal(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id (any other before a null one), and of repeated
    rows one. All columns are kept. The texts move once: rows are dealt by key and text hash, after each task has dropped
    its own repeated rows, and meet the list of documents that stay where they are."""
    groups = near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_hash"))
    stay = groups.groupBy("root").agg(first.alias("first")).select("first.*")
    names = {c: f"__{k}" for k, c in enumerate(docs.columns)}
    doc_id, text = (names[next(c for c in docs.columns if c == n)] for n in ("doc_id", "text"))
    # Never null, so that one set of columns serves the window and the join.
    by = lambda key, row_hash: {"by_null": key.isNull(), "by_key": F.coalesce(key.cast("string"), F.lit("")), "by_text": row_hash}
    keyed = docs.toDF(*names.values()).withColumns(by(F.col(doc_id), F.xxhash64(text)))
    keys = ["by_null", "by_key", "by_text"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    once = keyed.withColumn("nth", nth).where("nth = 1").drop("nth")
    met = once.join(stay.select(*[c.alias(n) for n, c in by(F.col("doc_id"), F.col("row_hash")).items()]), keys, "left_semi")
    return met.select(*[F.col(alias).alias(c) for c, alias in names.items()])
