"""Language identification: held-out accuracy and odd texts."""

import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from seqloom.llm import langid, queries


def test_query(spark):
    d = "/root/testdata/sf0.1"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op4_language_id(spark, d).collect()
    assert len(rows) == len(langs)
    for r in rows[:500]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    right = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(right) > 0.99
    assert np.mean([r["rejected"] for r in rows]) < 0.01


def test_grams():
    a = langid.gram_buckets("Ab, ab")
    assert sorted(a.tolist()) == sorted(np.tile(langid.gram_buckets("ab"), 2).tolist())
    assert len(langid.gram_buckets("")) == 0 and len(langid.gram_buckets("12 !")) == 0
    # " a", "ab", "b ", " ab", "ab ", " ab "
    assert len(langid.gram_buckets("ab")) == 6


def test_odd_documents(spark, odd_docs):
    rows = langid.identify(odd_docs).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        if texts[r["doc_id"]] is None or not any(c.isalpha() for c in texts[r["doc_id"]]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] == "en"
    kept = langid.drop_unidentified(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(not r["rejected"] for r in rows)
    unlabelled = odd_docs.drop("lang").selectExpr("*", "CAST(NULL AS string) AS lang")
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.identify(odd_docs.limit(0)).count() == 0


def test_rejection_is_calibrated():
    r = np.random.default_rng(0)
    texts = ["".join(r.choice(list("abcdefg "), 60)) if k % 2 else "".join(r.choice(list("mnopqrs "), 60)) for k in range(400)]
    features = [(np.flatnonzero(c), c[c > 0]) for c in map(langid.gram_counts, texts)]
    model = langid.LanguageModel.fit(features, ["b" if k % 2 else "a" for k in range(400)])
    assert [model.predict(t)[0] for t in texts[:20]] == ["a", "b"] * 10
    assert 0 < model.reject_below <= 0.6
    assert not any(model.predict(t)[2] for t in texts)


def plain_score(model, text):
    """The probabilities of a text, one n-gram after the other."""
    words = re.findall(rb"[a-z\x80-\xff]+", text.lower().encode())
    total, grams = [0.0] * len(model.classes), 0
    for w in words:
        w = b" " + w + b" "
        for n in (2, 3, 4):
            for i in range(len(w) - n + 1):
                h = w[i]
                for b in w[i + 1 : i + n]:
                    h = (h * 0x01000193 + b) % 2**32
                bucket = (h * 0x9E3779B1) % 2**32 >> (32 - langid.BUCKETS_LOG2)
                total = [t + s for t, s in zip(total, model.scores[bucket])]
                grams += 1
    z = [(t / max(1, grams) + b) / model.temperature for t, b in zip(total, model.bias)]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_every_prediction_by_hand(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [r for r in langid.identify(docs).collect() if len(texts[r["doc_id"]] or "") < 3000]
    assert len(rows) > 100
    for r in rows:
        text = texts[r["doc_id"]]
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        p = plain_score(model, text)
        assert r["lang_pred"] == model.classes[p.index(max(p))] and abs(r["score"] - max(p)) < 1e-6
        assert r["rejected"] == (r["score"] < model.reject_below)


def test_stage_without_labels_keeps_lettered_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    lettered = sum(any(c.isalpha() for c in r["text"] or "") for r in docs.collect())
    assert langid.drop_unidentified(docs).count() == lettered > 0
    assert all(r["held_out"] is not None for r in langid.identify(spark.createDataFrame([(None, "a")], "doc_id bigint, text string").withColumn("lang", F.lit("en"))).collect())
