"""Quality rules: counts against brute force, monotone trees, held-out verdicts."""

import re

import numpy as np
import pytest

from seqloom.llm import quality, queries
from tests.llm.conftest import TEXTS

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


@pytest.mark.parametrize("text", [*TEXTS, "a b c a b c", "a a a a", "a a a", "x\nx\n x\nx", "a b c d a b c", "\x1c \x85 a"])
def test_counts(text):
    assert quality.statistics(text)[0] == brute(text)


def test_trees_obey_their_constraints():
    r = np.random.default_rng(1)
    x = r.random((3000, len(quality.FEATURES)))
    falling = [quality.FEATURES.index(f) for f in quality.FALLING]
    y = ((x[:, falling[0]] + np.sin(9 * x[:, 1]) + x[:, 0] + 0.3 * r.normal(size=3000)) < 1.3).astype(float)
    model = quality.Trees.fit(x, y, falling)
    assert ((model.score(x) > 0.5) == y).mean() > 0.8
    for j in falling:
        low, high = x[:400].copy(), x[:400].copy()
        high[:, j] += r.random(400)
        assert (model.score(low) >= model.score(high) - 1e-12).all()
    assert len(model.score(x[:0])) == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op2_quality_rules(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    judged = [(r["kept"], good[r["doc_id"]]) for r in rows if r["doc_id"] in good and not r["base_failed"]]
    assert np.mean([k for k, g in judged if g]) > 0.98 and np.mean([k for k, g in judged if not g]) < 0.1


def test_odd_documents(spark, odd_docs):
    labels = spark.createDataFrame([(3, 1, 0), (None, 0, 0), (4, None, 1), (99, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.assess(odd_docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd_docs.collect())
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in rows:
        assert r["n_words"] == brute(texts[r["doc_id"]])[0] and r["kept"] == (not r["base_failed"])  # nothing to learn from
    kept = quality.drop_low_quality(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality.assess(odd_docs.limit(0), labels.limit(0)).count() == 0


def walk(trees, t, x, k=0):
    """The leaf's value, node after node."""
    f = trees.feature[t, k]
    return trees.value[t, k] if f < 0 else walk(trees, t, x, 2 * k + 1 + (x[f] > trees.cut[t, k]))


def test_every_verdict_by_hand(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    trees = quality.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = quality.assess(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        x = quality.statistics(texts[r["doc_id"]])[1]
        p = 1 / (1 + np.exp(-trees.base - sum(walk(trees, t, x) for t in range(quality.TREES))))
        assert abs(p - r["quality"]) < 1e-9 and r["kept"] == (not r["base_failed"] and r["quality"] >= trees.threshold)


def test_held_out(spark):
    """Learned from two thirds of the labels: of the clean documents that pass the base rule, the trees lose few."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.judge(spark, quality.train(docs, labels.where("doc_id % 3 <> 0")))("text").alias("r")
    rows = docs.join(labels.where("doc_id % 3 = 0"), "doc_id").select("quality", rows).select("quality", "r.*").collect()
    good = [r for r in rows if r["quality"]]
    assert np.mean([not r["kept"] and not r["base_failed"] for r in good]) < 0.02
    assert np.mean([r["kept"] for r in rows if not r["quality"]]) < 0.1
