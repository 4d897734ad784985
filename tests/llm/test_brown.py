"""Class bigrams: base scores against brute force, exchange moves against the likelihood, held-out perplexity."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import brown, queries

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), "\n"]


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


def check(docs, rows):
    """``docs``: (key, text)."""
    counts = Counter(w for k, t in docs if not held(k) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(k), held(k), len(ws := tokens(t)), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for k, t in docs)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9, atol=1e-5)
    assert all(math.isfinite(r["score"]) and r["score"] <= 1e-9 for r in rows)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rows = queries.op1_brown_ngrams(spark, d).collect()
    check(docs, rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


@pytest.mark.parametrize("head", [0, 3, 100_000])
def test_odd_documents(spark, odd_docs, monkeypatch, head):
    monkeypatch.setattr(brown, "HEAD", head)
    check([(r["doc_id"], r["text"]) for r in odd_docs.collect()], brown.score_documents(odd_docs).collect())
    assert brown.score_documents(odd_docs.limit(0)).count() == 0


def test_no_training_rows(spark):
    key = next(k for k in range(100) if held(k))
    rows = brown.score_documents(spark.createDataFrame([(key, "a b")], "doc_id bigint, text string")).collect()
    check([(key, "a b")], rows)
    assert rows[0]["base_score"] == 0


def likelihood(pairs, own):
    size = own.max() + 1
    table = np.zeros((size, size))
    np.add.at(table, (own[:, None], own[None, :]), pairs)
    f = lambda x: float(np.where(x > 0, x * np.log(np.maximum(x, 1)), 0).sum())
    return f(table) - f(table.sum(axis=0)) - f(table.sum(axis=1))


def test_exchange_raises_the_likelihood():
    r = np.random.default_rng(0)
    words, classes, fixed = 24, 4, 3
    kind = r.integers(0, 4, words)
    pairs = r.poisson(np.where((kind[:, None] + 1) % 4 == kind[None, :], 9.0, 0.3))
    pairs = np.pad(pairs, (0, fixed)) + np.pad(r.poisson(2, (fixed, fixed)), (words, 0))
    start = np.concatenate([np.arange(words) % classes, np.arange(fixed) + classes])
    own = brown.exchange_classes(pairs, words, classes)
    assert (own[words:] == np.arange(fixed) + classes).all() and own[:words].max() < classes
    found = likelihood(pairs, own)
    assert found > likelihood(pairs, start)
    for w in range(words):  # no single move is better
        for c in range(classes):
            moved = own.copy()
            moved[w] = c
            assert likelihood(pairs, moved) <= found + 1e-6


def test_perplexity_is_a_probability():
    """Transitions and emissions sum to one over classes, and over known words and one unknown a class."""
    head = [(b"a", 4), (b"b", 3), (b"c,", 2)]
    own = np.concatenate([[0, 1, 0], 2 + np.arange(brown.FORMS + 1)])
    size = 2 + brown.FORMS + 1
    table = np.random.default_rng(1).poisson(2, (size, size)).astype(float)
    model = brown.ClassModel(head, own, 3, table, np.zeros(brown.FORMS), 10, 4, 1)
    assert np.allclose((10**model.step).sum(axis=1), 1)


def trained_by_kind(spark, monkeypatch, **sizes):
    """Words of two kinds by turns, some of them rare; the classes of all words and the words' counts."""
    for name, value in sizes.items():
        monkeypatch.setattr(brown, name, value)
    r = np.random.default_rng(3)
    draw = lambda kind, new: new if r.random() < 0.02 else f"{kind}{r.integers(4)}"
    texts = [" ".join(x for _ in range(40) for x in (draw("a", "left"), draw("b", "right" + "x" * 70))) for _ in range(60)] + ["a0 once b1"]
    trained, rest = brown.train(spark.createDataFrame([(t.encode(),) for t in texts], "text binary"))
    model = trained()
    classes = {w: int(model.word_class[i]) for w, i in model.word_id.items()}
    table = {bytes(x["word"]): (x["n"], x["class"]) for x in rest.collect()}
    assert not classes.keys() & table.keys()
    counts = Counter(w for t in texts for w in t.encode().split())
    assert counts.keys() == classes.keys() | table.keys() and all(counts[w] == n for w, (n, _) in table.items())
    return model, classes | {w: c for w, (_, c) in table.items()}, table


@pytest.mark.parametrize("head", [3, 9, 65_000])
def test_words_beyond_the_clustered_learn_their_class(spark, monkeypatch, head):
    """Words used as others are join their class, in the head or not; only words of one occurrence keep their form."""
    model, classes, table = trained_by_kind(spark, monkeypatch, CLUSTERED=3, CLASSES=2, SINGLE=4, HEAD=head, BLOCK=2, AT_ONCE=50)
    a, b = classes[b"a0"], classes[b"b0"]
    assert a != b and {a, b} == {0, 1}
    assert all(classes[b"a%d" % k] == a and classes[b"b%d" % k] == b for k in range(4))
    assert classes[b"left"] == a and classes[b"right" + b"x" * 70] == b and b"right" + b"x" * 70 in table
    if b"once" in table:
        assert classes[b"once"] == model.first_form + brown.form_of(b"once")


def test_tied_words_fill_the_head(spark, monkeypatch):
    """More words of one count than the head takes: it is filled all the same, and they are exchanged."""
    monkeypatch.setattr(brown, "HEAD", 500)
    monkeypatch.setattr(brown, "CLUSTERED", 40)
    words = [f"w{k}" for k in range(3000)]
    counts = spark.createDataFrame([(w.encode(), 7) for w in words], "word binary, n bigint")
    assert 350 <= len(brown.head_words(counts, 500)) <= 500
    assert len(brown.head_words(counts, 3000)) == 3000 and brown.head_words(counts, 0) == []
    counts = counts.union(spark.createDataFrame([(b"often", 900), (b"long" * 40, 10_000)], "word binary, n bigint"))
    assert brown.head_words(counts, 10)[0] == (b"often", 900)
    texts = [(" ".join(words[k : k + 30]).encode(),) for k in range(0, 3000, 30)] * 2
    trained, rest = brown.train(spark.createDataFrame(texts, "text binary"))
    assert (trained().word_class < brown.CLASSES).all() and len(trained().word_class) >= 350
    assert all(x["class"] < brown.CLASSES for x in rest.collect())


def whole(contexts, own):
    size = int(own.max()) + 1
    out = np.zeros((2, len(own), size), np.int64)
    for r in contexts.collect():
        part = np.frombuffer(r["counts"], "<i8").reshape(2, -1, size)
        out[:, r["block"] : r["block"] + part.shape[1]] = part
    return out


def test_contexts_by_hand(spark):
    r = np.random.default_rng(2)
    listed = {b"w%d" % k: k for k in range(5)}
    texts = [" ".join(r.choice([*(f"w{k}" for k in range(5)), "other.", "x9"], r.integers(0, 30))) for _ in range(50)] + [None, ""]
    df = spark.createDataFrame([(t.encode() if t is not None else None,) for t in texts], "text binary").repartition(3)
    own = np.concatenate([[0, 1, 0, 1, 1], 2 + np.arange(brown.FORMS + 1)])
    contexts = brown.class_contexts(df.mapInArrow(brown._number(listed), "ids binary, rest binary"), own, int(own.max()) + 1)
    got = whole(contexts, own)
    want = np.zeros_like(got)
    for t in texts:
        ids = [5 + brown.FORMS, *(listed.get(w, 5 + brown.form_of(w)) for w in brown.words_of((t or "").encode())), 5 + brown.FORMS]
        for x, y in zip(ids, ids[1:]):
            want[0, x, own[y]] += 1
            want[1, y, own[x]] += 1
    assert (got == want).all()
    transitions = brown.class_transitions(contexts, own, got.shape[2])
    assert transitions.sum() == want[0].sum() and (transitions.sum(axis=0) == want[0].sum(axis=0)).all()
    gains = brown.Gains(transitions, 2)
    assert brown.best_classes(contexts, gains, got.shape[2], 5).tolist() == (want[1, :5] @ gains.before + want[0, :5] @ gains.after).argmax(axis=1).tolist()


def test_rounds_end_when_they_gain_little(spark, monkeypatch):
    texts = spark.createDataFrame([("a x b y a x b y c z".encode(),)] * 40, "text binary")
    listed = {w: i for i, w in enumerate([b"a", b"b", b"c", b"x", b"y", b"z"])}
    sequences = texts.mapInArrow(brown._number(listed), "ids binary, rest binary").cache()
    start = np.concatenate([np.arange(6) % 2, 2 + np.arange(brown.FORMS + 1)])
    seen = brown.exchange_rounds(sequences, start, 6, 2, 12)[2]
    assert len(seen) < 13 and max(seen[-2:]) < seen[-3] + brown.GAIN * abs(seen[-3])
    monkeypatch.setattr(brown, "GAIN", -10.0)
    assert len(brown.exchange_rounds(sequences, start, 6, 2, 5)[2]) == 6


def test_rounds_write_no_tables(spark, monkeypatch):
    """Class contexts are added up where classes are chosen; they are not written and read again."""
    texts = spark.createDataFrame([("a x b y c x".encode(),), ("b x a y".encode(),)] * 20, "text binary").repartition(3)
    sequences = texts.mapInArrow(brown._number({w: i for i, w in enumerate([b"a", b"b", b"c", b"x", b"y"])}), "ids binary, rest binary").cache()
    own = np.concatenate([np.arange(5) % 2, 2 + np.arange(brown.FORMS + 1)])
    size = int(own.max()) + 1
    monkeypatch.setattr(brown, "BLOCK", 2)
    contexts = brown.class_contexts(sequences, own, size)
    transitions = brown.class_transitions(contexts, own, size)
    want = brown.best_classes(contexts, brown.Gains(transitions, 2), size, 5)
    written = []
    monkeypatch.setattr(brown, "stage_table", lambda df, label, **_: written.append(label) or df)
    found, last, seen = brown.exchange_rounds(sequences, own, 5, 2, 1)
    assert not written and len(seen) == 2 and seen[0] == brown.log_likelihood(transitions)
    moved = own.copy()
    moved[:5:2] = want[::2]
    assert seen[1] == brown.log_likelihood(brown.class_transitions(brown.class_contexts(sequences, moved, size), moved, size))
    assert (found == (own if seen[0] >= seen[1] else moved)).all() and brown.log_likelihood(last) == max(seen)


def test_sums_come_a_block_at_a_time():
    """So that neither Python nor the JVM holds all blocks of a task in one batch."""
    table = np.arange(2 * 10 * 3, dtype=np.int32).reshape(2, 10, 3)
    out = list(brown._add_blocks(10, 3, 2, 4)(iter([*brown._dealt(table, 4), *brown._dealt(table, 4)])))
    assert [b.column(0).to_pylist() for b in out] == [[0], [4], [8]]
    for b, k in zip(out, (0, 4, 8)):
        assert b.column(1).to_pylist() == [(2 * table[:, k : k + 4]).astype("<i8").tobytes()]
    assert not list(brown._add_blocks(10, 3, 2, 4)(iter([])))


def test_rounds_raise_the_likelihood(spark, small):
    texts = spark.read.parquet(f"{small}/documents.parquet").selectExpr("CAST(text AS binary) AS text")
    words = Counter(w for t in texts.collect() for w in brown.words_of(t["text"] or b""))
    head = [w for w, _ in words.most_common(2000)]
    sequences = texts.mapInArrow(brown._number({w: i for i, w in enumerate(head)}), "ids binary, rest binary").cache()
    start = np.concatenate([np.arange(2000) % 8, 8 + np.arange(brown.FORMS + 1)])
    own, transitions, seen = brown.exchange_rounds(sequences, start, 2000, 8)
    assert (own[2000:] == start[2000:]).all() and own[:2000].max() < 8
    assert brown.log_likelihood(transitions) == max(seen) > seen[0]
    after, before = whole(brown.class_contexts(sequences, own, len(transitions)), own)
    table = np.zeros_like(transitions)
    np.add.at(table, own, after)
    assert (table == transitions).all() and after.sum() == before.sum()


def test_scores_by_hand(spark, small):
    """``score`` of every document from the classes and counts, and how many tokens are in learned classes."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    trained, rest = brown.train(df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).select(F.col("text").cast("binary").alias("text")))
    model = trained()
    classes = {w: int(model.word_class[i]) for w, i in model.word_id.items()} | {bytes(r["word"]): r["class"] for r in rest.collect()}
    tokens_of = lambda t: brown.words_of((t or "").encode())
    counts = Counter(w for k, t in docs if not held(k) for w in tokens_of(t))
    ends = sum(not held(k) for k, _ in docs)
    class_of = lambda w: classes.get(w, model.first_form + brown.form_of(w))
    size = model.end + 1
    steps, words = np.zeros((size, size)), np.bincount([*classes.values(), model.end], minlength=size)
    for k, t in docs:
        if not held(k):
            path = [model.end, *map(class_of, tokens_of(t)), model.end]
            for x, y in zip(path, path[1:]):
                steps[x, y] += 1
    into = steps.sum(axis=0)
    p = (into + 1) / (into.sum() + size)
    for r in brown.score_documents(df).collect():
        path = [model.end, *map(class_of, ws := tokens_of(dict(docs)[r["doc_id"]])), model.end]
        score = sum(math.log10((steps[x, y] + brown.BETA * p[y]) / (steps[x].sum() + brown.BETA)) for x, y in zip(path, path[1:]))
        for w, c in zip([*ws, None], path[1:]):
            score += math.log10(((ends if w is None else counts[w]) + brown.DELTA) / (into[c] + brown.DELTA * (words[c] + 1)))
        assert abs(score - r["score"]) < 1e-6 * max(1, abs(score))
    learned = sum(n for w, n in counts.items() if classes[w] < model.first_form)
    assert learned >= 0.8 * sum(counts.values())


def test_classes_of_rare_words_from_a_stream():
    """Words whose rows are spread over batches of any size, against sums over all their bigrams."""
    r = random.Random(1)
    for trial in range(40):
        classes, size = 5, 5 + brown.FORMS + 1
        gains = brown.Gains(np.random.RandomState(trial).randint(0, 50, (size, size)).astype(float), classes)
        rows, want = [], {}
        for word in [b"w%03d" % k for k in range(r.randint(1, 60))]:
            parts = [np.array([[r.randrange(size), r.randrange(size)] for _ in range(r.choice([1, 2, 5, 40]))], np.uint8) for _ in range(r.choice([1, 1, 2, 7]))]
            for p in parts:
                rows.append((word, len(p), p.tobytes() if len(p) <= gains.single else gains.of(p).sum(axis=0).astype("<f8").tobytes()))
            want[word] = sum(map(len, parts)), gains.of(np.concatenate(parts)).sum(axis=0)
        step = r.choice([1, 2, 3, 1000])
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + step]), (pa.binary(), pa.int64(), pa.binary()))], ["word", "n", "bigrams"])
            for k in range(0, len(rows), step)
        ]
        got = [x for b in brown._choose_classes(gains, classes)(iter(batches)) for x in b.to_pylist()]
        assert [x["word"] for x in got] == sorted(want)
        for x in got:
            n, total = want[x["word"]]
            assert x["n"] == n
            if n == 1:
                assert x["class"] == classes + brown.form_of(x["word"])
            else:
                assert total[x["class"]] >= total.max() - 1e-9
    assert not list(brown._choose_classes(gains, classes)(iter([])))
