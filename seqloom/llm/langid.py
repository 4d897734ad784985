"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the average of the embeddings of its hashed byte n-grams (within words, with a mark at their
ends); a linear softmax over it is trained by stochastic gradient descent in numpy. As both are
linear, scoring adds up one row of class scores for each n-gram. A temperature is fitted on texts
kept from training, and with it the confidence below which a prediction is rejected.

The model is fitted on at most SAMPLE labelled texts; every text is scored whole.
Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; without
anything to learn from every text is ``und`` with score 0, and those with a letter are not rejected.
A document without a key is learned from. Repeated rows are scored alike, of equal probabilities the language first by name
is predicted, texts of any length are read whole, an empty table gives an empty result,
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import bound_batches, bounded_sample, fold

BUCKETS_LOG2, WIDTH, GRAMS = 13, 16, (2, 3, 4)
BUCKETS = 1 << BUCKETS_LOG2
#: Labelled texts that the model is fitted on, at most; one in CALIBRATE of them only calibrates.
SAMPLE, CALIBRATE = 4000, 4
EPOCHS, BATCH, RATE = 12, 32, 8.0
#: Share of correctly predicted calibration texts that the rejection threshold may lose.
LOSS = 0.001
UNKNOWN = "und"
_letter = regex.compile(r"\p{L}").search
#: ASCII letters and bytes of other characters stay, the rest are word ends.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def gram_buckets(text: str) -> np.ndarray:
    """Bucket of each n-gram of the text."""
    words = text.lower().encode().translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.uint32)
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    gap = a == 32
    a = a.astype(np.uint32)
    out = []
    h, inner = a, np.zeros(len(a), bool)
    for n in range(2, max(GRAMS) + 1):
        if len(a) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + a[n - 1 :]
        inner = inner[:-1] | gap[n - 2 : len(gap) - 1] if n > 2 else np.zeros(len(h), bool)
        if n in GRAMS:
            out.append((h[~inner] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS_LOG2))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def gram_counts(text: str) -> np.ndarray:
    return np.bincount(gram_buckets(text), minlength=BUCKETS)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class LanguageModel:
    """``scores``: class scores by bucket; ``bias``; ``temperature``; ``reject_below``."""

    def __init__(self, classes: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float, reject_below: float):
        self.classes, self.scores, self.bias, self.temperature, self.reject_below = classes, scores, bias, temperature, reject_below

    @classmethod
    def fit(cls, features: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 0) -> LanguageModel:
        """``features``: buckets and their counts for each text."""
        classes = sorted(set(langs))
        y = np.array([classes.index(c) for c in langs], np.int64)
        rng = np.random.default_rng(seed)
        n, k = len(y), len(classes)
        order = rng.permutation(n)
        held = order[: n // CALIBRATE] if n >= 4 * CALIBRATE else order[:0]
        train = order[len(held) :]
        table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        weights, bias = rng.normal(0, 0.1, (WIDTH, k)).astype(np.float32), np.zeros(k, np.float32)

        def block(rows: np.ndarray) -> np.ndarray:
            f = np.zeros((len(rows), BUCKETS), np.float32)
            for r, i in enumerate(rows):
                at, count = features[i]
                f[r, at] = count / max(1, count.sum())
            return f

        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            mixed = rng.permutation(train)
            for b in range(0, len(mixed), BATCH):
                rows = mixed[b : b + BATCH]
                f = block(rows)
                v = f @ table
                g = softmax(v @ weights + bias)
                g[np.arange(len(rows)), y[rows]] -= 1
                g /= len(rows)
                back = g @ weights.T
                weights -= rate * 0.1 * (v.T @ g)
                bias -= rate * 0.01 * g.sum(axis=0)
                table -= rate * (f.T @ back)
        scores = (table @ weights).astype(np.float64)
        model = cls(classes, scores, bias.astype(np.float64), 1.0, 0.0)
        if len(held):
            z = np.array([model.logits(*features[i]) for i in held])
            loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(held)), y[held]], 1e-300)).mean()
            model.temperature = float(min(np.geomspace(0.02, 20, 121), key=loss))
            p = softmax(z / model.temperature)
            right = p.argmax(axis=1) == y[held]
            if right.any():
                model.reject_below = float(min(0.6, 0.9 * np.quantile(p.max(axis=1)[right], LOSS)))
        return model

    def logits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return count @ self.scores[at] / max(1, count.sum()) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability, rejected."""
        if text is None or not _letter(text):
            return UNKNOWN, 0.0, True
        if not self.classes:
            return UNKNOWN, 0.0, False
        count = gram_counts(text)
        p = softmax((count @ self.scores / max(1, count.sum()) + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.classes[k], float(min(1.0, p[k])), bool(p[k] < self.reject_below)


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fit on a bounded sample of the rows with a text and a language. The texts stay on the executors; what comes to the
    driver is at most 6 bytes x BUCKETS for each sampled text."""
    bound_batches(docs.sparkSession)
    labelled = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    chosen = bounded_sample(labelled, sample, "doc_id", "text", distinct=True)

    @F.arrow_udf("struct<at:binary,count:binary>")
    def sparse(texts: pa.Array) -> pa.Array:
        at, count = [], []
        for t in texts:
            c = gram_counts(t.as_py())
            at.append(np.flatnonzero(c).astype("<u2").tobytes())
            count.append(c[c > 0].astype("<u4").tobytes())
        return pa.StructArray.from_arrays([pa.array(at, pa.binary()), pa.array(count, pa.binary())], ["at", "count"])

    rows = chosen.select("nth", "lang", sparse("text").alias("f")).orderBy("nth", "lang").limit(sample).select("lang", "f.*").collect()
    features = [(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["count"], "<u4")) for r in rows]
    if not rows:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    return LanguageModel.fit(features, [r["lang"] for r in rows])


_LOADED: dict[str, LanguageModel] = {}


def predictor(spark, model: LanguageModel):
    """Column function text -> struct(lang_pred, score, rejected)."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x classes numbers
    key = hashlib.sha256(model.scores.tobytes()).hexdigest()

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = shared.value
        found = [_LOADED[key].predict(t.as_py()) for t in texts]
        cols = list(zip(*found)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], ["lang_pred", "score", "rejected"])

    return predict


HELD_OUT = 5


def held_out() -> Column:
    return F.coalesce(fold("doc_id", HELD_OUT) == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score and rejected. Held-out documents are not learned from."""
    held = held_out()
    model = train(docs.where(~held))
    guess = predictor(docs.sparkSession, model)
    return docs.select("doc_id", held.alias("held_out"), guess("text").alias("r")).select("doc_id", "held_out", "r.*")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The documents whose language is not rejected, with all their columns."""
    model = train(docs.where(~held_out()))
    return docs.where(~predictor(docs.sparkSession, model)("text")["rejected"])
