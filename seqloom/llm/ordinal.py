"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered; P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector over hashed
words for all grades and increasing thresholds. The expected grade ranks documents, the probability
of the highest grade selects them.

Labels give three grades: 0 for low quality, 1 for good but toxic text, 2 for good and clean text.
The weights are fitted on at most SAMPLE rated documents; every text is scored whole.
Defined results: a null or empty text has no features, so that its grade comes from the thresholds
alone; without labels of at least two grades the expected grade is null, the tail probability 1 and
the document kept. Repeated rows are scored alike; a null doc_id stays null and has no
grade to learn from; a document with grades that disagree is learned from once with each; equal
tail probabilities are kept or dropped together; texts of any length are read whole; an empty table gives an empty result,
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import bound_batches, bounded_sample

BUCKETS_LOG2 = 15
BUCKETS = 1 << BUCKETS_LOG2
GRADES = 3
#: Rated documents that the weights are fitted on, at most.
SAMPLE = 8000
EPOCHS, BATCH, RATE, L2 = 30, 64, 0.3, 1e-4
#: A bucket gets a weight if it is in at least LEAST rated documents and its shares on the two sides of a threshold
#: differ by at least APART standard errors: rare words of the sample say nothing about other texts.
LEAST, APART = 10, 5.0
#: Share of top-graded rated documents that the selection threshold may lose.
LOSS = 0.002
_core = re.compile(rb"[a-z\x80-\xff]+").findall
_tail = re.compile(rb"[^a-z0-9\x80-\xff.,]+$").search


def _bucket(token: bytes) -> int:
    return zlib.crc32(token) & (BUCKETS - 1)


class _Tokens(dict):
    """Word -> buckets, for the words of one document; each word is taken apart once."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        low = word.lower()
        out = [_bucket(b"w:" + c) for c in _core(low)]
        if m := _tail(low):
            out.append(_bucket(b"t:" + m[0]))
        if word.isupper() and len(word) > 1:
            out.append(_bucket(b"u:"))
        self[word] = out = tuple(out)
        return out


def features(text: str | None) -> np.ndarray:
    """Buckets of what the text has: its words, and its traits in steps. Whole text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    tokens = _Tokens()
    known = set(words)
    present = {b for w in known for b in tokens[w]}
    lines = [x for x in raw.split(b"\n") if x.strip()]
    traits = {
        b"repeated": sum(map(bytes.__eq__, words, words[1:])) / n,
        b"distinct": len(known) / n,
        b"dup_lines": 1 - len(set(lines)) / max(len(lines), 1),
        b"symbols": min(1.0, (len(raw) - len(raw.translate(None, b"#*$%&|<>!"))) / n),
        b"upper": (len(raw) - len(raw.translate(None, bytes(range(65, 91))))) / len(raw),
        b"short": 1.0 if n < 20 else 0.0,
    }
    present.update(_bucket(b"trait:%s:%d" % (name, k)) for name, x in traits.items() for k in range(1, 6) if x >= k / 10)
    return np.array(sorted(present), np.int64)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def told_apart(x: list[np.ndarray], grade: np.ndarray) -> np.ndarray:
    seen = np.zeros((GRADES, BUCKETS))
    for at, g in zip(x, grade):
        seen[g, at] += 1
    rows = np.bincount(grade, minlength=GRADES)
    usable = np.zeros(BUCKETS, bool)
    for k in range(1, GRADES):
        a, b = max(rows[:k].sum(), 1), max(rows[k:].sum(), 1)
        p = seen.sum(axis=0) / len(grade)
        error = np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / a + 1 / b))
        usable |= np.abs(seen[:k].sum(axis=0) / a - seen[k:].sum(axis=0) / b) >= APART * error
    return usable & (seen.sum(axis=0) >= LEAST)


class OrdinalModel:
    """``weights`` over buckets, increasing ``thresholds`` and the selection threshold ``select``."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, select: float):
        self.weights, self.thresholds, self.select = weights, thresholds, select

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, by row."""
        return sigmoid(np.asarray(z)[..., None] - self.thresholds)

    @classmethod
    def fit(cls, x: list[np.ndarray], grade: np.ndarray, seed: int = 0) -> OrdinalModel:
        """AdaGrad on the likelihood; thresholds are a first one plus positive steps, so that they stay ordered."""
        rng = np.random.default_rng(seed)
        n = len(grade)
        w, w2 = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
        share = np.clip([(grade <= k).mean() for k in range(GRADES - 1)], 1e-3, 1 - 1e-3)
        start = np.log(share / (1 - share))
        free = np.array([start[0], *np.log(np.maximum(np.diff(start), 0.05))])
        free2 = np.full(len(free), 1e-6)
        usable = told_apart(x, grade)

        def thresholds() -> np.ndarray:
            return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])

        for epoch in range(EPOCHS):
            for rows in np.array_split(rng.permutation(n), max(1, n // BATCH)):
                t = thresholds()
                size = np.array([len(x[i]) for i in rows])
                at = np.concatenate([x[i] for i in rows])
                value = usable[at].astype(float)
                row = np.repeat(np.arange(len(rows)), size)
                z = np.bincount(row, w[at] * value, len(rows))
                y = grade[rows]
                upper = np.where(y < GRADES - 1, sigmoid(t[np.minimum(y, GRADES - 2)] - z), 1.0)
                lower = np.where(y > 0, sigmoid(t[np.maximum(y - 1, 0)] - z), 0.0)
                p = np.maximum(upper - lower, 1e-9)
                du = np.where(y < GRADES - 1, upper * (1 - upper), 0.0) / p
                dl = np.where(y > 0, lower * (1 - lower), 0.0) / p
                dz = (du - dl) / len(rows)  # of the loss by z
                g = np.bincount(at, dz[row] * value, BUCKETS) + L2 * w
                w2 += g * g
                w -= RATE * g / np.sqrt(w2)
                gt = np.array([(dl * (y == k + 1) - du * (y == k)).sum() / len(rows) for k in range(GRADES - 1)])
                gf = np.array([gt.sum(), *(gt[k:].sum() * np.exp(free[k]) for k in range(1, GRADES - 1))])
                free2 += gf * gf
                free -= RATE * 0.3 * gf / np.sqrt(free2)
        model = cls(w, thresholds(), 0.5)
        top = np.array([float(model.above(model.score(x[i]))[-1]) for i in np.flatnonzero(grade == GRADES - 1)])
        if len(top):
            model.select = float(min(0.5, np.quantile(top, LOSS)))
        return model

    def score(self, at: np.ndarray) -> float:
        return float(self.weights[at].sum())


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel | None:
    """Fit on a bounded sample of ``labels`` (doc_id, quality, toxic)."""
    grade = F.when(F.col("quality") <= 0, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    rated = labels.where("doc_id is not null and quality is not null").select("doc_id", grade.alias("grade")).distinct()
    bound_batches(docs.sparkSession)
    chosen = bounded_sample(rated, sample, "doc_id", "grade").orderBy("nth").limit(sample).select("doc_id", "grade")
    met = bounded_sample(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), sample, "doc_id", "text", distinct=True)  # SAMPLE rows

    @F.arrow_udf("binary")
    def present(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            bits = np.zeros(BUCKETS, np.uint8)
            bits[features(t.as_py())] = 1
            out.append(np.packbits(bits).tobytes())
        return pa.array(out, pa.binary())

    rows = met.select("nth", "grade", present("text").alias("bits")).orderBy("nth", "grade").limit(sample).collect()  # BUCKETS bits each
    y = np.array([r["grade"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    return OrdinalModel.fit([np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8))).astype(np.int32) for r in rows], y)


_LOADED: dict[str, OrdinalModel] = {}


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, grade (the most probable), expected_grade, tail_probability (of the highest grade) and kept."""
    spark = docs.sparkSession
    bound_batches(spark)
    model = train(docs, labels)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers
    key = hashlib.sha256(model.weights.tobytes() if model else b"").hexdigest()

    @F.arrow_udf("struct<grade:int,expected_grade:double,tail_probability:double,kept:boolean>")
    def grade(texts: pa.Array) -> pa.Array:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = shared.value
        m = _LOADED[key]
        names = ["grade", "expected_grade", "tail_probability", "kept"]
        if m is None:
            n = len(texts)
            return pa.StructArray.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.float64()), pa.array([1.0] * n, pa.float64()), pa.array([True] * n, pa.bool_())], names)
        above = m.above(np.array([m.score(features(t.as_py())) for t in texts]).reshape(-1))
        each = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
        tail = above[:, -1]
        return pa.StructArray.from_arrays([pa.array(each.argmax(axis=1), pa.int32()), pa.array(above.sum(axis=1), pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= m.select, pa.bool_())], names)

    return docs.select("doc_id", grade("text").alias("r")).select("doc_id", "r.*")
