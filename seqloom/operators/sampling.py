"""Seeded sampling of reads, single or paired, with or without replacement."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.schema import SAMPLE_READS, SAMPLE_SEED

#: Bits of a key's hash that the histogram of the selection counts.
BINS_LOG2 = 16
#: What the exact generator of the command line can number; record numbers that it draws, which are held on the driver; and reads up to
#: which the command line takes it unasked, as its draws are made one after the other.
GENERATOR_READS, GENERATOR_DRAWS, UNASKED = 2**32 - 1, 10_000_000, 20_000_000
#: Swaps whose draws are held at once; cells of the table that sorts out most of them.
SWAPS, PLACES = 1 << 20, 1 << 22
#: Numbers drawn at once.
DRAWN = 1 << 16
#: Records of a leaf of the tree of draws, and leaves that a worker remembers.
DRAW_BLOCK, HELD_BLOCKS = 1 << 16, 64
_blocks: dict[tuple[int, int, int, int], np.ndarray] = {}


def sample_size(n: int, k: int = SAMPLE_READS, fraction: float | None = None, replacement: bool = False) -> int:
    """Reads to draw from ``n``. A positive fraction counts (rounded half up; at most n without replacement), else k, at
    most n."""
    if fraction is not None and fraction < 0:
        raise ValueError("the fraction is negative")
    if fraction:
        size = math.floor(fraction * n + 0.5)
        return size if replacement else min(size, n)
    return min(k, n)


# ---------------------------------------------------------------- by hash: a filter


def sample_key(seed: int) -> Column:
    """Hex digest of seed and record number: the smallest k are the sample, alike in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rec_no").cast("string")))


def _cut(reads: DataFrame, size: int, seed: int) -> tuple | None:
    """The key of the ``size``-th read: a histogram of the keys' first bits finds its bin, and only that bin is ordered."""
    if size <= 0:
        return None
    keyed = reads.select(sample_key(seed).alias("key"), "source_file", "rec_no")
    keyed = keyed.withColumn("bin", F.conv(F.substring("key", 1, BINS_LOG2 // 4), 16, 10).cast("int"))
    bins = sorted((r["bin"], r["n"]) for r in keyed.groupBy("bin").agg(F.count("*").alias("n")).collect())  # 2**BINS_LOG2 rows
    left = size
    for b, n in bins:
        if n >= left:
            order = ["key", "source_file", "rec_no"]
            return tuple(keyed.where(F.col("bin") == b).select(*order).orderBy(*order).limit(left).orderBy(*[F.desc(c) for c in order]).first())
        left -= n
    return ("g",)  # more than there are: all


def _within(cut: tuple | None, seed: int) -> Column:
    if cut is None:
        return F.lit(False)
    key = sample_key(seed)
    if len(cut) == 1:
        return F.lit(True)
    return (key < cut[0]) | ((key == cut[0]) & ((F.col("source_file") < cut[1]) | ((F.col("source_file") == cut[1]) & (F.col("rec_no") <= cut[2]))))


# ---------------------------------------------------------------- by the command line's generator


def _generator_of(seed: int) -> np.random.RandomState:
    return np.random.RandomState(seed or SAMPLE_SEED)


def _below(state: np.random.RandomState, bounds: np.ndarray) -> np.ndarray:
    """One draw below each bound, in order: a 32-bit Mersenne Twister number divided by the bound's share of its range,
    drawn again while the quotient is not below the bound. Drawn in blocks, never more numbers than are left to draw; a rejected number is
    taken out of its block."""
    out = np.empty(len(bounds), np.int64)
    scale = 0xFFFFFFFF // bounds
    done, left = 0, np.zeros(0, np.int64)
    while done < len(bounds):
        if not len(left):
            left = state.randint(0, 2**32, size=min(DRAWN, len(bounds) - done), dtype=np.uint32).astype(np.int64)
        here = slice(done, done + len(left))
        found = left[: len(bounds[here])] // scale[here]
        bad = np.flatnonzero(found >= bounds[here])
        good = int(bad[0]) if len(bad) else len(found)
        out[done : done + good] = found[:good]
        done, left = done + good, left[good + 1 :]
    return out


def uniform_integers(seed: int, bounds: np.ndarray) -> np.ndarray:
    return _below(_generator_of(seed), bounds)


def _shuffled_places(n: int, size: int, seed: int, block: int) -> np.ndarray:
    """What numbers stand in the first ``size`` places after 0..n-1 were shuffled from the end, place i with a drawn one of 0..i.
    The draws are made twice: once to note the generator's state before each block of them, then block by block from the last one.
    So the swaps are undone in the order in which they count, and only the places of the wanted numbers are held: the swaps among the
    first places leave these as they are, and every later one moves a wanted number from the drawn place to i."""
    starts = list(range(n - 1, size - 1, -block))  # blocks of swaps i = start, start - 1, ...; those below size are not needed
    state, states = _generator_of(seed), []
    bounds = lambda start: np.arange(start + 1, max(size, start + 1 - block), -1, dtype=np.int64)
    for start in starts:
        states.append(state.get_state())
        _below(state, bounds(start))
    wanted = set(range(size))
    for start, at in zip(reversed(starts), reversed(states)):
        state.set_state(at)
        drawn = _below(state, bounds(start))[::-1]  # now from the smallest i on
        first = start - len(drawn) + 1
        table = np.zeros(PLACES, bool)
        table[np.fromiter(wanted, np.int64, len(wanted)) & (PLACES - 1)] = True
        # Draws of wanted places, of places that become wanted within the block, and some that only share a cell with one.
        near = table[drawn & (PLACES - 1)]
        while True:
            more = near | np.isin(drawn, first + np.flatnonzero(near))
            if more.sum() == near.sum():
                break
            near = more
        for k in np.flatnonzero(near).tolist():
            if (place := int(drawn[k])) in wanted:
                wanted.remove(place)
                wanted.add(first + k)
    return np.fromiter(wanted, np.int64, len(wanted))


def draw_indices(n: int, size: int, replacement: bool, seed: int, block: int = SWAPS) -> np.ndarray:
    """Record numbers in order, repeated if drawn repeatedly. Holds ``size`` numbers and a block of draws."""
    if not n or not size:
        return np.empty(0, np.int64)
    if replacement:
        return np.sort(uniform_integers(seed, np.full(size, n, np.int64)))
    return np.sort(_shuffled_places(n, size, seed, block))


def _drawn(reads: DataFrame, n: int, size: int, replacement: bool, seed: int) -> DataFrame:
    """(rec_no, times) of the generator's draws."""
    if size > GENERATOR_DRAWS or n > GENERATOR_READS:
        raise ValueError("too many reads for the exact generator; use method='hash'")
    drawn = reads.sparkSession.createDataFrame(pa.table({"rec_no": pa.array(draw_indices(n, size, replacement, seed), pa.int64())}))
    return drawn.groupBy("rec_no").agg(F.count("*").alias("times"))


# ---------------------------------------------------------------- with replacement, by a tree of draws


def _generator(seed: int, *place: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed & 0xFFFFFFFFFFFFFFFF, *place])))


def draws_of_block(n: int, size: int, seed: int, block: int) -> np.ndarray:
    """How often each record of a block is drawn when ``size`` of ``n`` records are drawn with replacement. The draws are dealt
    down a tree of record ranges: of a range's draws a binomial number falls to its first half. Every number has a generator of
    its own, seeded by its place, so that whoever asks for a block finds the same draws, and all blocks' draws are ``size``."""
    blocks = -(-n // DRAW_BLOCK)
    lo, hi, left = 0, blocks, size
    rows = lambda a, b: min(b * DRAW_BLOCK, n) - a * DRAW_BLOCK
    while hi - lo > 1 and left:
        mid = (lo + hi) // 2
        first = int(_generator(seed, 0, lo, hi).binomial(left, rows(lo, mid) / rows(lo, hi)))
        lo, hi, left = (lo, mid, first) if block < mid else (mid, hi, left - first)
    own, rng = rows(block, block + 1), _generator(seed, 1, block)
    if left > 4 * own:
        return rng.multinomial(left, np.full(own, 1 / own))
    return np.bincount(rng.integers(0, own, left), minlength=own)


def times_drawn(n: int, size: int, seed: int, rec_no: str = "rec_no") -> Column:
    """How often a record is drawn: a function of its number alone."""

    @F.arrow_udf("bigint")
    def times(numbers: pa.Array) -> pa.Array:
        numbers = numbers.to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros(len(numbers), np.int64)
        block = numbers // DRAW_BLOCK
        order = np.argsort(block, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []:
            k = int(block[some[0]])
            if (found := _blocks.get((n, size, seed, k))) is None:
                if len(_blocks) >= HELD_BLOCKS:
                    _blocks.pop(next(iter(_blocks)))
                found = _blocks[n, size, seed, k] = draws_of_block(n, size, seed, k)
            out[some] = found[numbers[some] - k * DRAW_BLOCK]
        return pa.array(out)

    return times(F.col(rec_no))


def _repeated(reads: DataFrame, times: str = "__times") -> DataFrame:
    return reads.where(F.col(times) > 0).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int")))).drop(times, "__copy")


# ---------------------------------------------------------------- samples


def sample_reads(reads: DataFrame, k: int = SAMPLE_READS, fraction: float | None = None, replacement: bool = False, seed: int = SAMPLE_SEED, method: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(sample, complement) of reads whose ``rec_no`` counts from 0 over the table. "hash" is a filter: without replacement by the
    k-th smallest key, with it by how often a record is drawn, which each task finds by itself; no read moves. "mt" draws the command line's
    own record numbers on the driver. With replacement a read comes as often as it is drawn. The complement holds every read that is not
    in the sample."""
    (taken,), rest = _samples([reads], reads.count(), k, fraction, replacement, seed, method)
    return taken, rest


def _samples(tables: list[DataFrame], n: int, k: int, fraction: float | None, replacement: bool, seed: int, method: str) -> tuple[list[DataFrame], DataFrame]:
    """The same records of each table, and the first one's other reads."""
    if method not in ("hash", "mt"):
        raise ValueError("method must be 'hash' or 'mt'")
    first, size = tables[0], sample_size(n, k, fraction, replacement)
    if method == "mt":
        drawn = _drawn(first, n, size, replacement, seed)
        taken = [_repeated(t.join(drawn.withColumnRenamed("times", "__times"), "rec_no").select(*t.columns, "__times")) for t in tables]
        return taken, first.join(drawn, "rec_no", "left_anti").select(*first.columns)
    if replacement:
        drawn = [t.withColumn("__times", times_drawn(n, size, seed) if n else F.lit(0)) for t in tables]
        return [_repeated(t) for t in drawn], drawn[0].where("__times = 0").drop("__times")
    cut = _cut(first, size, seed)
    inside = _within(cut, seed)
    # Numbers are a table's own, so that a mate's key alone tells whether it is in.
    others = [t.where(F.lit(False) if cut is None else F.lit(True) if len(cut) == 1 else sample_key(seed) <= cut[0]) for t in tables[1:]]
    return [first.where(inside), *others], first.where(~inside)


def truncated_complement(sample: DataFrame, complement: DataFrame) -> DataFrame:
    """The part of the complement before the last sampled read: where the command line stops."""
    last = sample.agg(F.max("rec_no").alias("__last"))
    return complement.join(F.broadcast(last), F.col("rec_no") < F.col("__last")).drop("__last")


def sample_paired(first: DataFrame, second: DataFrame, k: int = SAMPLE_READS, fraction: float | None = None, replacement: bool = False, seed: int = SAMPLE_SEED, method: str = "hash") -> tuple[DataFrame, DataFrame]:
    """Samples of two files in lockstep: the same record numbers of both. Their counts have to agree. By "hash" both are
    filtered alike, and neither is joined."""
    n, m = first.count(), second.count()
    if n != m:
        raise ValueError(f"the inputs have different numbers of reads ({n} and {m})")
    taken, _ = _samples([first, second], n, k, fraction, replacement, seed, method)
    return taken[0], taken[1]
