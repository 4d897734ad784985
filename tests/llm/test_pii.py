"""Personal data: base spans against the contract's expressions, redaction, the label model."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from seqloom.llm import pii, queries


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


digits = lambda m: re.sub("[^0-9]", "", m)
RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def brute(text):
    found = sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(RULES) for m in re.finditer(p, text or "") if ok(m[0]))
    return [f"{name}:{a}:{e}" for a, _, e, name in found]


HARD = [
    "a@b.c_d@e.f x@y.z", "a@b.c@d.e", "1.2.3.4.5.6.7.8 999.1.2.3.4 256.1.1.1 001.002.003.004", "4111 1111 1111 1111-", "4111-1111-1111-1111 22",
    "+1 (578) 555-6437 4918187128635271", "+123456789012345678", "é🙂 a.b@c.de é +49 30 1234567", "1" * 50, "x" * 50_000 + "@a.b", "+1" * 50, "12 " * 20_000, None, "",
    "@a.b", "a@b", "4111111111111111.", "a" * 30 + "@-.-", "1.2.3", "1-2-3-4-5-6-7-8-9-0-1-2", "0 " * 12, "+1 2345678 9", "+1(23)456-789-01-", "1  2", "a@b..c", "+1++1234567890",
    "n@a.b " * 300, "12345678901234567890 1234567890123", "0.0.0.0256", "..1.2.3.4..", "4111 1111  1111 1111 111",
]


def test_hard_texts(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id bigint, text string")
    found = pii.find_personal_data(docs).select("doc_id", pii.written("base").alias("base"), pii.written("spans").alias("spans")).collect()
    assert len(found) == len(HARD)
    for r in found:
        want = brute(HARD[r["doc_id"]])
        assert r["base"] == ",".join(want), HARD[r["doc_id"]]
        assert set(want) <= set(r["spans"].split(",")) | {""} - {""} or not want


def test_random_texts(spark):
    import random

    r = random.Random(4)
    texts = ["".join(r.choice("0123456789.@+- (a") for _ in range(r.randint(0, 120))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in pii.find_personal_data(docs).select("doc_id", pii.written("base").alias("base")).collect():
        assert row["base"] == ",".join(brute(texts[row["doc_id"]])), texts[row["doc_id"]]


def test_query(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in queries.op6_personal_data(spark, d).collect():
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _, _ in RULES] == [sum(w.startswith(k) for w in want) for k, _, _ in RULES]
        assert set(want) <= set(filter(None, r["spans"].split(",")))


def test_redaction(spark):
    texts = ["mail a@b.com or +1 (578) 555-6437.", "🙂 é a@b.com🙂", "clean text", None, "", "a@b.com"]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, found string, spans int")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "mail [EMAIL] or [PHONE].", 1: "🙂 é [EMAIL]🙂", 2: "clean text", 3: None, 4: "", 5: "[EMAIL]"}


def test_no_python_on_executors(spark):
    docs = spark.createDataFrame([(1, "a@b.com")], "doc_id bigint, text string")
    plan = pii.redact(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_label_model():
    good, bad = (1, 1, 1, 1, 1), (-1, -1, 0, -1, -1)
    rows = [(good, 100.0), (bad, 100.0), ((0, 1, 0, 1, 1), 20.0), ((0, -1, 0, -1, 1), 20.0)]
    p = pii.expectation_maximisation(rows)
    assert p[0] > 0.95 and p[1] < 0.05 and p[2] > 0.5 > p[3]
    weights = pii.span_classifier([(0, v, 0, n) for v, n in rows], p)
    z = lambda v: sum(weights.get(f, 0) for f in pii._features(0, v, 0))
    assert z(good) > 0 > z(bad)
    assert pii.expectation_maximisation([]) == [] and pii.span_classifier([], []) == {}


def test_odd_documents(spark, odd_docs):
    rows = pii.find_personal_data(odd_docs).collect()
    assert len(rows) == odd_docs.count() and not any(r["base"] for r in rows)
    assert pii.redact(odd_docs).columns == odd_docs.columns
    assert sorted(str(r["text"]) for r in pii.redact(odd_docs).collect()) == sorted(str(r["text"]) for r in odd_docs.collect())
    assert pii.find_personal_data(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("text,kind", [('x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', "secret"), ("call 555-123-4567 now", "phone")])
def test_added_spans(spark, text, kind):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([text, *["write to a.b@mail.com today"] * 20])], "doc_id bigint, text string")
    row = pii.find_personal_data(docs).where("doc_id = 0").select(pii.written("spans").alias("s"), "base").first()
    assert row["s"].startswith(kind) and not row["base"]


def test_long_secret(spark):
    value = "Ab3/" * 75
    text = f'x api_key={value} y'
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([text, *["write to a.b@mail.com today"] * 20])], "doc_id bigint, text string")
    row = pii.find_personal_data(docs).where("doc_id = 0").select(pii.written("spans").alias("s")).first()
    assert row["s"] == f"secret:2:{10 + len(value)}"
    assert pii.redact(docs).where("doc_id = 0").first()["text"] == "x [SECRET] y"


def test_spans_by_hand(spark):
    """Added spans are the candidates that the classifier takes and that touch no base span; redaction joins what overlaps."""
    import random

    r = random.Random(8)
    words = ["a.b@mail.com", "+1 (578) 555-6437", "555-123-4567", "4111 1111 1111 1111", "10.0.0.1", "token=abcd1234abcd", "Dr. Anna Smith", "and", "version 1.2.3.4", "12345678901234567", "password: a.b@mail.com", "é🙂", "call 2345678901 or"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 60, 700]))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = pii.candidates(docs, ["doc_id"]).cache()
    weights = pii.train(found)
    rows = {x["doc_id"]: x for x in pii.decide(found, weights).collect()}
    redacted = {x["doc_id"]: x["text"] for x in pii.redact(docs).collect()}
    added = 0
    for k, text in enumerate(texts):
        base = [(x["start"], x["kind"], x["end"]) for x in rows[k]["found"] if x["rule"] == 1 and x["contract"]]
        more = []
        for x in rows[k]["found"]:
            votes = tuple(x[name] for name in pii.LABELERS)
            z = sum(weights.get(f, 0.0) for f in pii._features(x["kind"], votes, x["size"]))
            if not (x["rule"] == 1 and x["contract"]) and x["rule"] >= 0 and z > 0 and not any(b[0] < x["end"] and x["start"] < b[2] for b in base):
                more.append((x["start"], x["kind"], x["end"]))
        added += len(more)
        want = sorted(base + more)
        assert [tuple(x) for x in rows[k]["spans"]] == want
        out, at = "", 0
        for start, kind, end in want:
            if start >= at:
                out += text[at:start] + f"[{pii.KINDS[kind].upper()}]"
            at = max(at, end)
        assert redacted[k] == out + text[at:]
    assert added > 50


def test_many_spans_in_one_text(spark):
    """The work is near linear in the spans of a text."""
    import time

    took = {}
    for n in (2000, 16_000, 32_000):
        docs = spark.createDataFrame([(1, "".join(f"n{k}@mail.com Dr. Anna Smith " for k in range(n)))], "doc_id bigint, text string")
        began = time.perf_counter()
        row = pii.find_personal_data(docs).select(F.size("base").alias("n"), F.size("spans").alias("m")).first()
        assert row["n"] == n and row["m"] in (n, 2 * n)
        text = pii.redact(docs).first()["text"]
        assert text.count("[EMAIL]") == n
        took[n] = time.perf_counter() - began
    print(took)
    assert took[32_000] < 3 * took[16_000] + 2
