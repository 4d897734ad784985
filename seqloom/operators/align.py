"""Local alignment scores with affine gaps, for the letters of all reads of an Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.letters import latin1_bytes
from seqloom.plans.shared import bound_batches
from seqloom.schema import GAP_EXTEND, GAP_OPEN, MATCH, MISMATCH, WITH_N

#: Letters aligned together; the working set is a dozen numbers for each, however long reads are.
PIECE = 1 << 17
#: Bits between the running maxima of neighbouring reads.
_APART = 42
_default = np.full((5, 5), MISMATCH, np.int32)
np.fill_diagonal(_default, MATCH)
_default[4, :] = _default[:, 4] = WITH_N
#: Score matrices over A, C, G, T, N; fixed values.
MATRICES = {
    "default": _default,
    "mat50": np.array([[2, -2, 0, -2, 0], [-2, 2, -2, 0, 0], [0, -2, 2, -2, 0], [-2, 0, -2, 2, 0], [0, 0, 0, 0, 0]], np.int32),
    "mat70": np.array([[2, -2, -1, -2, 0], [-2, 2, -2, -1, 0], [-1, -2, 2, -2, 0], [-2, -1, -2, 2, 0], [0, 0, 0, 0, 0]], np.int32),
}


def base_codes(rna: bool = False) -> np.ndarray:
    """Byte -> 0..3 for A, C, G, T in either case, else 4. U counts as A unless ``rna``, then as T."""
    table = np.full(256, 4, np.int64)
    for k, letters in enumerate(("Aa", "Cc", "Gg", "Tt")):
        for x in letters:
            table[ord(x)] = k
    for x in "Uu":
        table[ord(x)] = 3 if rna else 0
    return table


def local_scores(query: np.ndarray, letters: np.ndarray, starts: np.ndarray, matrix: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Best local score of ``query`` in each read; ``letters`` are the reads' codes one after the other, ``starts`` where each
    begins. One step handles one letter of the query for a piece of the letters, however these are cut into reads: gaps along a read
    are a running maximum that begins anew with every read. A read that goes on in the next piece leaves its last column there."""
    n, m = len(starts), len(query)
    best = np.zeros(n, np.int64)
    if not m or not len(letters):
        return best.astype(np.int32)
    lengths = np.diff(np.append(starts, len(letters)))
    filled = np.flatnonzero(lengths)
    begins = starts[filled]
    scores = matrix.astype(np.int64)
    kept_h, kept_gap = np.zeros(m, np.int64), np.zeros(m, np.int64)  # of the read that goes on: last scores, best gap starts
    for at in range(0, len(letters), piece):
        part = letters[at : at + piece]
        first = int(np.searchsorted(begins, at, side="right")) - 1  # the read that holds the first letter
        last = int(np.searchsorted(begins, at + len(part)))
        heads = np.maximum(begins[first:last] - at, 0)
        goes_on = begins[first] < at
        read = np.zeros(len(part), np.int64)
        read[heads[1:]] = 1
        read = np.cumsum(read)
        place = np.arange(at, at + len(part)) - begins[first:last][read]
        apart, slope = read << _APART, -GAP_EXTEND * place
        new = np.ones(len(heads), bool)
        new[0] = not goes_on
        top, h, gap = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), np.full(len(part), -(10**6), np.int64)
        before = 0  # the last score of the piece before, one letter of the query back
        for j in range(m):
            diagonal = np.empty_like(h)
            diagonal[1:], diagonal[0] = h[:-1], before
            diagonal[heads[new]] = 0
            gap = np.maximum(h + GAP_OPEN, gap + GAP_EXTEND)
            own = np.maximum(np.maximum(diagonal + scores[query[j]][part], gap), 0)
            start = own + slope + apart
            if goes_on:
                start[0] = max(start[0], kept_gap[j])
            start = np.maximum.accumulate(start)
            along = np.full(len(part), -(10**6), np.int64)
            along[1:] = start[:-1] - apart[1:] + GAP_OPEN - slope[1:] - GAP_EXTEND
            if goes_on:
                along[0] = kept_gap[j] + GAP_OPEN - slope[0] - GAP_EXTEND
            h = np.maximum(own, along)
            np.maximum(top, h, out=top)
            before, kept_h[j] = kept_h[j] if goes_on and j + 1 < m else 0, h[-1]
            kept_gap[j] = start[-1] - apart[-1]
        best[filled[first:last]] = np.maximum(best[filled[first:last]], np.maximum.reduceat(top, heads))
    return best.astype(np.int32)


def align_score(seq: Column | str, query: str, mode: str = "parity", matrix: str = "default", rna: bool = False) -> Column:
    """Score column. "textbook" is the local alignment of the whole query; "parity" is what the command line prints: its
    first column only ever counts a first letter of the read that equals the query's first."""
    if not query:
        raise ValueError("the query is empty")
    if mode not in ("parity", "textbook"):
        raise ValueError("mode must be 'parity' or 'textbook'")
    table, scores = base_codes(rna), MATRICES[matrix]
    whole = table[np.frombuffer(query.encode("latin-1"), np.uint8)]
    used = whole[1:] if mode == "parity" else whole

    if active := SparkSession.getActiveSession():
        bound_batches(active)

    @F.arrow_udf("int")
    def score(values: pa.Array) -> pa.Array:
        data, starts = latin1_bytes(values)
        letters = table[data]
        found = local_scores(used, letters, starts, scores)
        if mode == "parity" and whole[0] < 4 and len(letters):
            some = np.diff(np.append(starts, len(letters))) > 0
            first = some & (letters[np.minimum(starts, len(letters) - 1)] == whole[0])
            found = np.maximum(found, first * scores[whole[0], whole[0]])
        return pa.array(found.astype(np.int32), pa.int32())

    return score(seq)


def align(reads: DataFrame, query: str, **options) -> DataFrame:
    """(seq, score) for every read."""
    return reads.select("seq", align_score("seq", query, **options).alias("score"))
