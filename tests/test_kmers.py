"""k-mer counting by packed numbers: codes, super-k-mers, counts against a plain count, and the plan."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqloom.functions import kmer_codes as codes
from seqloom.operators import kmers as operator
from seqloom.operators.kmers import kmers

ODD = [None, "", "A", "acgtnACGT", "N" * 40, "ACGTU-ACGTACGTACGTACGTACG", "é" * 3 + "ACGTACGTACGTACGTACGTA", "A" * 300, "ACGT" * 60, "TTTTTTTTTTTTTTTTA", "acgtACGTacgtACGT"]


def plain(seqs, k):
    found = Counter()
    for s in seqs:
        for i in range(len(s or "") - k + 1):
            w = s[i : i + k]
            if set(w) <= set("acgtACGT"):
                found[w.upper()] += 1
    return found


def some(seed, n, length=80):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("ACGTNacgt"), rng.integers(0, length), p=[0.22, 0.22, 0.22, 0.22, 0.02, 0.025, 0.025, 0.025, 0.025])) for _ in range(n)]


@pytest.mark.parametrize("k", range(1, 17))
def test_numbers_of_windows(k, seqs=tuple(some(1, 50)) + tuple(ODD)):
    column = pa.array(seqs, pa.string())
    letters = Counter()
    for size in (7, 1 << 20):
        letters = Counter()
        for w in codes.pieces(column, k, size):
            for x in w.numbers().tolist():
                letters["".join("ACGT"[(x >> (2 * i)) & 3] for i in range(k))] += 1
        assert letters == plain(seqs, k)
    sliced = pa.array(["ACGTACGTACGTACGTACGT", *seqs], pa.string()).slice(1)
    assert sum(len(w.numbers()) for w in codes.pieces(sliced, k)) == sum(letters.values())


@pytest.mark.parametrize("k", [13, 14, 15, 16])
def test_super_kmers_hold_every_window_in_its_bucket(k):
    seqs = some(2, 60, 200) + ODD
    found, where = Counter(), {}
    for w in codes.pieces(pa.array(seqs, pa.string()), k, 64):
        buckets, words = codes.super_kmers(w, 32)
        for b, word in zip(buckets.tolist(), words):
            numbers, times = codes.numbers_of(np.array([word]), np.array([1]), k)
            assert 1 <= len(numbers) <= codes.RUN
            for x in numbers.tolist():
                found[x] += 1
                assert where.setdefault(x, b) == b  # a k-mer is in one bucket, wherever it stands
    want = Counter({sum("ACGT".index(c) << (2 * i) for i, c in enumerate(w)): n for w, n in plain(seqs, k).items()})
    assert found == want


@pytest.mark.parametrize("k", [1, 3, 8, 12, 13, 16])
def test_counts(spark, monkeypatch, k):
    monkeypatch.setattr(operator, "HELD", 500)
    monkeypatch.setattr(operator, "SORTED", 300)
    seqs = some(3, 300, 120) + ODD + ["ACGTTGCATGCAACGTTGCATTGACA"] * 200
    df = spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(3)
    found = {r["kmer"]: r["frequency"] for r in kmers(df, k, dense=False).collect()}
    assert found == dict(plain(seqs, k))
    for r in kmers(df, k, dense=False).limit(50).collect():
        assert r["rank"] == sum("ACGT".index(c) << (2 * i) for i, c in enumerate(r["kmer"]))


def test_one_read_of_a_million_bases(spark):
    rng = np.random.default_rng(4)
    long = "".join(rng.choice(list("ACGT"), 1_000_000))
    df = spark.createDataFrame([(s,) for s in ["ACGTA", long, "ACGTA"]], "seq string").coalesce(1)
    assert kmers(df, 5).agg({"frequency": "sum"}).first()[0] == 1_000_000 - 4 + 2
    assert kmers(df, 14).agg({"frequency": "sum"}).first()[0] == 1_000_000 - 13


def test_no_window_is_a_row_in_the_plan(spark):
    df = spark.createDataFrame([(s,) for s in some(5, 10)], "seq string")
    for k in (3, 9, 16):
        plan = kmers(df, k, dense=False)._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("copies", [1, 50])
def test_what_is_dealt_is_less_than_the_letters(spark, copies):
    """Two bytes a window at most, and repeated reads once a task."""
    seqs = some(6, 2000, 200) * copies
    rows = spark.createDataFrame([(s,) for s in seqs], "seq string").coalesce(1).mapInArrow(operator._dealt(16), "bucket int, once binary, more binary, times binary").collect()
    dealt = sum(len(r["once"]) + len(r["more"]) + len(r["times"]) for r in rows)
    windows = sum(plain(seqs, 16).values())
    assert dealt < 2.2 * windows if copies == 1 else dealt < 0.1 * windows


def test_empty(spark):
    df = spark.createDataFrame([], "seq string")
    assert kmers(df, 16).count() == 0 and kmers(df, 2).agg({"frequency": "sum"}).first()[0] == 0
