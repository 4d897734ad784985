"""Ordinal regression: ordered thresholds, gradients, held-out grades."""

import math
import re
import zlib

import numpy as np

from seqloom.llm import ordinal, queries


def test_fit_orders_grades():
    r = np.random.default_rng(0)
    grade = r.integers(0, 3, 900)
    x = [np.unique(np.concatenate([r.integers(100, 2000, 20), [10 + g]])) for g in grade]
    model = ordinal.OrdinalModel.fit(x, grade)
    assert (np.diff(model.thresholds) > 0).all()
    z = np.array([model.score(i) for i in x])
    means = [z[grade == g].mean() for g in range(3)]
    assert means[0] < means[1] < means[2]
    above = model.above(z)
    assert (above[:, 0] >= above[:, 1]).all()
    expected = above.sum(axis=1)
    assert np.mean(np.round(expected) == grade) > 0.9


def test_query(spark):
    d = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: 0 if not r["quality"] else 1 if r["toxic"] else 2 for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op8_quality_classifier(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    kept = {g: np.mean([r["kept"] for r in rows if labels.get(r["doc_id"]) == g]) for g in range(3)}
    assert kept[2] > 0.99 and kept[1] < 0.5 and kept[0] < 0.05
    for r in rows[:300]:
        assert 0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = ordinal.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = docs.join(labels.where("doc_id % 3 = 0"), "doc_id").select("text", "quality", "toxic").collect()
    clean = [model.above(model.score(ordinal.features(r["text"])))[-1] >= model.select for r in rows if r["quality"] and not r["toxic"]]
    low = [model.above(model.score(ordinal.features(r["text"])))[-1] >= model.select for r in rows if not r["quality"]]
    assert np.mean(clean) > 0.98 and np.mean(low) < 0.05


def test_odd_documents(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = ordinal.rate(odd_docs, none).collect()
    assert len(rows) == odd_docs.count() and all(r["kept"] and r["expected_grade"] is None and r["tail_probability"] == 1 for r in rows)
    some = spark.createDataFrame([(3, 1, None), (4, 0, 1), (5, 1, 1), (6, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = ordinal.rate(odd_docs, some).collect()
    assert len(rows) == odd_docs.count() and all(r["expected_grade"] is not None for r in rows)
    assert ordinal.rate(odd_docs.limit(0), some).count() == 0


def plain_features(text):
    """The buckets of a text, from its words and traits one by one."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    if not words:
        return set()
    names = set()
    for w in words:
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), w)
        names |= {b"w:" + c for c in re.findall(rb"[a-z\x80-\xff]+", low)}
        tail = re.search(rb"[^a-z0-9\x80-\xff.,]+$", low)
        if tail:
            names.add(b"t:" + tail[0])
        if len(w) > 1 and re.search(rb"[A-Z]", w) and not re.search(rb"[a-z]", w):
            names.add(b"u:")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    traits = {
        b"repeated": sum(a == b for a, b in zip(words, words[1:])) / n,
        b"distinct": len(set(words)) / n,
        b"dup_lines": 1 - len(set(lines)) / max(len(lines), 1),
        b"symbols": min(1.0, len(re.findall(rb"[#*$%&|<>!]", raw)) / n),
        b"upper": len(re.findall(rb"[A-Z]", raw)) / len(raw),
        b"short": float(n < 20),
    }
    names |= {b"trait:%s:%d" % (t, k) for t, x in traits.items() for k in range(1, 6) if x >= k / 10}
    return {zlib.crc32(x) % ordinal.BUCKETS for x in names}


def test_every_grade_by_hand(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = ordinal.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = ordinal.rate(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        z = sum(model.weights[b] for b in plain_features(texts[r["doc_id"]]))
        above = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        each = [1 - above[0], above[0] - above[1], above[1]]
        assert abs(r["expected_grade"] - sum(above)) < 1e-9 and abs(r["tail_probability"] - above[1]) < 1e-9
        assert each[r["grade"]] > max(each) - 1e-9 and r["kept"] == (r["tail_probability"] >= model.select)


def test_fit_lowers_the_loss_to_a_stationary_point():
    """The likelihood's slope by the thresholds, taken numerically, is near zero where the fit ends."""
    r = np.random.default_rng(4)
    grade = r.integers(0, 3, 1500)
    x = [np.array([7 if r.random() < (0.8, 0.5, 0.1)[g] else 8]) for g in grade]
    model = ordinal.OrdinalModel.fit(x, grade)

    def loss(thresholds):
        above = 1 / (1 + np.exp(thresholds - np.array([[model.score(i)] for i in x])))
        each = np.stack([1 - above[:, 0], above[:, 0] - above[:, 1], above[:, 1]], axis=1)
        return -np.log(each[np.arange(len(x)), grade]).mean()

    for k in range(2):
        step = np.eye(2)[k] * 1e-4
        assert abs(loss(model.thresholds + step) - loss(model.thresholds - step)) / 2e-4 < 0.03
