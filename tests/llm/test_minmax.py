import random

import numpy as np
import pytest

from seqloom.llm import minmax
from seqloom.llm.common import documents


def brute(rows, width=minmax.WIDTH, percent=minmax.PERCENT):
    """{place of the row: (n_shingles, component)} by comparing all pairs of different sets through their shingles."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        common = {}
        for x in s:
            for other in holders[x]:
                if other < k:
                    common[other] = common.get(other, 0) + 1
        for other, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[other]) - n):
                a, b = find(k), find(other)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return [(len(s), doc_id if not s else least.get(find(k))) for k, (s, (doc_id, _)) in enumerate(zip(sets, rows))]


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minmax.near_duplicates(df, **options).collect())
    want = sorted((d is None, d, n, c, d is not None and d == c) for (d, _), (n, c) in zip(rows, brute(rows)))
    assert found == want
    return found


def edited(rng, words, share):
    return [f"e{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


def families(seed, count, copies, length=60, most=0.1):
    rng = random.Random(seed)
    rows = []
    for f in range(count):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.randrange(5, length))]
        rows += [(len(rows) + k, " ".join(edited(rng, base, rng.random() * most) if k else base)) for k in range(copies)]
    rng.shuffle(rows)
    return rows


def test_query_against_brute_force(spark, small):
    from seqloom.llm.queries import op13_minmax_near_dedup

    rows = [tuple(r) for r in documents(spark, small).select("doc_id", "text").collect()]
    found = sorted(tuple(r) for r in op13_minmax_near_dedup(spark, small).collect())
    assert found == sorted((d, n, c, d == c) for (d, _), (n, c) in zip(rows, brute(rows)))
    assert any(not kept for *_, kept in found)


def test_families_of_near_copies(spark):
    found = check(spark, families(1, 40, 8))
    assert 40 < sum(kept for *_, kept in found) < 320


def test_short_sets_at_the_threshold(spark):
    # 4 of 5 shingles in common is 0.8 exactly; 3 of 4, and 3 of 5, are below.
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "p q r s t u"), (4, "p q r s t u v"), (5, "A B C D E F G"), (6, "x y"), (7, "X\ty"), (8, "x y z")]
    found = check(spark, rows)
    assert [r[3] for r in found] == [1, 1, 3, 4, 1, 6, 6, 8]


def test_large_clusters_are_split_and_whole(spark, monkeypatch):
    """One dense family, one whose copies are similar to few others, in groups of 16: blocks, pivots and the rest."""
    monkeypatch.setattr(minmax, "GROUP", 16)
    monkeypatch.setattr(minmax, "PIVOTS", 4)
    rng = random.Random(5)
    rows = families(2, 1, 150, most=0.03)
    base = [f"v{k}" for k in range(80)]
    chain = [(1000 + k, " ".join(base[: 40 + k // 4] + [f"q{k % 4}"])) for k in range(120)]
    far = [(2000 + k, " ".join(edited(rng, base, 0.15))) for k in range(100)]
    check(spark, rows + chain + far)


def test_bounded_shingles_split_too(spark, monkeypatch):
    monkeypatch.setattr(minmax, "GROUP_SHINGLES", 300)
    check(spark, families(4, 3, 30))


@pytest.mark.parametrize("seed", range(3))
def test_intersections_and_links_of_a_group(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 300), replace=False), rng.integers(0, 1 << 62, rng.integers(0, 40)).astype(np.uint64)])) for _ in range(150)]
    found = minmax.intersections(sets)
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (found == want)[~np.eye(len(sets), dtype=bool)].all() or (found - want == np.diag(np.diag(found - want))).all()
    i, j = minmax.linked(sets, 60)
    assert len(set(i)) == len(i) and (j < i).all()


def test_signature_is_unbiased_over_pairs():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        a, b, c = (rng.integers(0, 1 << 63, 100, dtype=np.uint64) for _ in range(3))
        one, two = minmax.signature(np.concatenate([a, b])), minmax.signature(np.concatenate([a, c]))
        errors.append((one == two).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < (2 / 9 / 128) ** 0.5 * 1.15  # of 128 independent minima


def test_similar_sets_share_a_band():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(5, 200))
        found = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        other = found[: n - n // 5]
        assert set(minmax.band_keys(found)) & set(minmax.band_keys(other))


def test_odd_documents(spark, odd_docs):
    found = minmax.near_duplicates(odd_docs).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = sorted((str(d), n, str(c)) for (d, _), (n, c) in zip(rows, brute(rows)))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in found)


def test_empty_table(spark, odd_docs):
    assert minmax.near_duplicates(odd_docs.limit(0)).collect() == []


def test_percent_below_the_bands_is_an_error(spark, odd_docs):
    with pytest.raises(ValueError):
        minmax.near_duplicates(odd_docs, percent=50)
