"""SimHash groups against all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import simhash
from seqloom.llm.components import connected_components


def brute_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, budget=2):
    """Least row reachable, for a list of unsigned fingerprints."""
    a = np.array(prints, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= budget
    label = np.arange(len(a))
    while True:
        new = np.where(near, label[None, :], len(a)).min(axis=1)
        if np.array_equal(new, label):
            return label.tolist()
        label = new


TEXTS = [None, "", " \t\n", "One", "one", "one two", "A b c d", "a  B\nc d", "x " * 5000, "x " * 5000, "ÀÉ à é İ words", "tail"]


def test_fingerprints():
    for t in TEXTS:
        assert simhash.fingerprint_of(t) == brute_fingerprint(t)


def clustered(n, seed):
    r = np.random.default_rng(seed)
    centres = r.integers(0, 2**63, 5, dtype=np.uint64)
    out = []
    for _ in range(n):
        x = int(r.choice(centres))
        for b in r.integers(0, 64, r.integers(0, 6)):
            x ^= 1 << int(b)
        out.append(x)
    return out


@pytest.mark.parametrize("subtrie", [8, 4096])
def test_links_lose_nothing(spark, subtrie):
    prints = sorted(set(clustered(600, 3)) | {0, 1, 3, 7, 2**64 - 1})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print bigint")
    groups = {r["node"] % (1 << 64): r["root"] for r in connected_components(simhash.hamming_links(df, subtrie=subtrie)).collect()}
    want = brute_components(prints)
    for i, p in enumerate(prints):
        for j in (want[i],):
            q = prints[j]
            assert groups.get(p, p) == groups.get(q, q)
    assert len({groups.get(p, p) for p in prints}) == len(set(want))


def test_trie_walk():
    for seed in range(5):
        bits = np.array(sorted(set(clustered(300, seed))), np.uint64)
        root = simhash.walk_tries(bits, np.array([0]), 0)
        assert root.tolist() == brute_components(bits.tolist())


def test_components_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(5, 5)], "u bigint, v bigint")
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert roots == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)}
    assert connected_components(edges.limit(0)).count() == 0


def test_groups_and_dedup(spark):
    rows = [(k, t, "clash", k) for k, t in enumerate(TEXTS)] + [(3, "One", "clash", 99), (None, "solo text that is alone", "clash", 7), (0, None, "clash", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, print string, component_id int")
    got = simhash.near_duplicates(docs).collect()
    prints = [brute_fingerprint(r[1]) for r in rows]
    label = brute_components(prints)
    ids = [r[0] for r in rows]
    want = sorted((str(ids[i]), str(min((ids[k] for k in range(len(rows)) if label[k] == label[i] and ids[k] is not None), default=None))) for i in range(len(rows)))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_hexadecimal(spark):
    df = spark.createDataFrame([(0,), (-1,), (255,)], "p bigint")
    assert [r[0] for r in df.select(simhash.hexadecimal(F.col("p"))).collect()] == ["0" * 16, "f" * 16, "00000000000000ff"]
