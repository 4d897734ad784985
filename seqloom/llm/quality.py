"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

The trees are grown on histograms in numpy and flattened into node arrays; scoring walks all trees
of all documents of a batch together, one level at a time. For the features in FALLING the score
can only fall as the feature grows, whatever the others are.

The trees are fitted on at most SAMPLE labelled documents; the statistics of every text are whole.
Defined results: a null text has no words (all counts 0) and fails the base rule; without any label,
or with labels of one kind only, the verdict is the base rule's. Repeated rows are judged alike; a
null doc_id stays null and has no label; of a document's labels that disagree each is learned from; equal
values of a statistic fall on the same side of every split; texts of any length are read whole; an empty table gives an empty
result, other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import bound_batches, bounded_sample

SPACE, SYMBOLS = b"\t\n\x0b\x0c\r ", b"#*$%&|<>"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
MIN_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct", "words_a_line", "top_word")
FALLING = ("symbols", "dup_lines", "repeats", "upper", "top_word")
#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 8000
TREES, DEPTH, BINS, RATE, LEAST, L2 = 40, 3, 32, 0.2, 20, 1.0
#: Share of good labelled documents that the threshold may lose.
LOSS = 0.002


# ---------------------------------------------------------------- statistics


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words within windows that occur twice or more."""
    n = len(ids)
    if n <= window:
        return 0
    code = ids[: n - window + 1]
    for k in range(1, window):
        code = code * (n + 1) + ids[k : n - window + 1 + k]
        if k < window - 1 or n > 2_000_000:  # codes stay below n * (n + 1)
            code = np.unique(code, return_inverse=True)[1]
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    often = count[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(window):
        covered[k : n - window + 1 + k] |= often
    return int(covered.sum())


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    blanks = len(raw) - len(raw.translate(None, SPACE))
    chars = len(text or "") - blanks
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeats = repeated_words(ids)
    each, size = max(n, 1), max(chars, 1)
    marks = raw.count(b"!") + raw.count(b"?")
    features = [
        np.log1p(n),
        chars / each,
        symbols / each,
        dup / max(len(lines), 1),
        repeats / each,
        (len(raw) - len(raw.translate(None, UPPER))) / size,
        (len(raw) - len(raw.translate(None, DIGITS))) / size,
        marks / each,
        len(known) / each,
        n / max(len(lines), 1),
        float(np.bincount(ids).max()) / each if n else 0.0,
    ]
    return (n, chars, symbols, dup, repeats), features


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


# ---------------------------------------------------------------- trees


class Trees:
    """Flat node arrays: node k of tree t at [t, k]; children of k are 2k+1 and 2k+2; a leaf's feature is -1."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, base: float, threshold: float):
        self.feature, self.cut, self.value, self.base, self.threshold = feature, cut, value, base, threshold

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of ``x``."""
        if not len(x):
            return np.zeros(0)
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = self.feature[trees, at]
            right = x[rows, np.maximum(f, 0)] > self.cut[trees, at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        z = self.base + self.value[trees, at].sum(axis=1)
        return 1 / (1 + np.exp(-z))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, falling: list[int]) -> Trees:
        """Logistic loss; second-order gains on quantile bins."""
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        base = float(np.log(mean / (1 - mean)))
        z = np.full(n, base)
        nodes = 2 ** (DEPTH + 1) - 1
        feature, cut, value = np.full((TREES, nodes), -1), np.zeros((TREES, nodes)), np.zeros((TREES, nodes))
        best = lambda g, h, lo, hi: np.clip(-g / (h + L2), lo, hi)
        loss = lambda g, h, w: -(g * w + 0.5 * (h + L2) * w * w)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            todo = [(0, np.arange(n), -np.inf, np.inf)]
            while todo:
                k, rows, lo, hi = todo.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                w = best(gs, hs, lo, hi)
                value[t, k] = RATE * w
                found = (1e-6, -1, 0, 0.0, 0.0)
                if k < 2**DEPTH - 1 and len(rows) >= 2 * LEAST:
                    for j in range(m):
                        b = binned[rows, j]
                        gl = np.cumsum(np.bincount(b, g[rows], BINS + 1))[: len(cuts[j])]
                        hl = np.cumsum(np.bincount(b, h[rows], BINS + 1))[: len(cuts[j])]
                        nl = np.cumsum(np.bincount(b, minlength=BINS + 1))[: len(cuts[j])]
                        wl, wr = best(gl, hl, lo, hi), best(gs - gl, hs - hl, lo, hi)
                        gain = loss(gl, hl, wl) + loss(gs - gl, hs - hl, wr) - loss(gs, hs, w)
                        ok = (nl >= LEAST) & (len(rows) - nl >= LEAST)
                        if j in falling:
                            ok &= wl >= wr
                        gain = np.where(ok, gain, -np.inf)
                        if len(gain) and gain.max() > found[0]:
                            i = int(gain.argmax())
                            found = (gain[i], j, i, wl[i], wr[i])
                _, j, i, wl, wr = found
                if j < 0:
                    z[rows] += value[t, k]
                    continue
                feature[t, k], cut[t, k] = j, cuts[j][i]
                left = binned[rows, j] <= i
                middle = (wl + wr) / 2
                # Below a split on a constrained feature both sides stay on their side of the middle.
                todo.append((2 * k + 1, rows[left], middle if j in falling else lo, hi))
                todo.append((2 * k + 2, rows[~left], lo, middle if j in falling else hi))
        model = cls(feature, cut, value, base, 0.5)
        good = model.score(x[y == 1])
        model.threshold = float(min(0.5, np.quantile(good, LOSS)))
        return model


# ---------------------------------------------------------------- columns

_RESULT = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,kept:boolean,quality:double>"
_LOADED: dict[str, Trees] = {}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Fit on a bounded sample of ``labels`` (doc_id, quality); what comes to the driver is a row of features for each."""
    bound_batches(docs.sparkSession)
    named = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").distinct()
    chosen = bounded_sample(named, sample, "doc_id", "quality").orderBy("nth").limit(sample).select("doc_id", "quality")
    met = bounded_sample(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), sample, "doc_id", "text", distinct=True)  # SAMPLE rows

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py())[1] for t in texts], pa.list_(pa.float64()))

    rows = met.select("nth", "quality", features("text").alias("x")).orderBy("nth", "quality").limit(sample).collect()
    y = np.array([float(r["quality"] > 0) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    return Trees.fit(np.array([r["x"] for r in rows]), y, [FEATURES.index(f) for f in FALLING])


def judge(spark, model: Trees | None):
    """Column function text -> struct of the counts, base_failed, kept and quality."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # TREES small arrays
    key = hashlib.sha256(model.value.tobytes() if model else b"").hexdigest()

    @F.arrow_udf(_RESULT)
    def verdict(texts: pa.Array) -> pa.Array:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = shared.value
        trees = _LOADED[key]
        counts, x = [], []
        for t in texts:
            c, f = statistics(t.as_py())
            counts.append(c)
            x.append(f)
        counts = np.array(counts, np.int64).reshape(-1, 5)
        failed = np.array([base_fails(int(c[0]), int(c[4])) for c in counts], bool)
        p = trees.score(np.array(x).reshape(-1, len(FEATURES))) if trees else np.ones(len(counts))
        kept = ~failed & (p >= trees.threshold) if trees else ~failed
        cols = [pa.array(counts[:, k], pa.int64()) for k in range(5)] + [pa.array(failed), pa.array(kept), pa.array(p, pa.float64())]
        return pa.StructArray.from_arrays(cols, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"])

    return verdict


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept and quality (the trees' probability)."""
    verdict = judge(docs.sparkSession, train(docs, labels))
    return docs.select("doc_id", verdict("text").alias("r")).select("doc_id", "r.*")


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return docs.where(judge(docs.sparkSession, train(docs, labels))("text")["kept"])
