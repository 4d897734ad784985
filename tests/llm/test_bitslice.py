"""Bit-sliced search against plain inner products."""

import numpy as np
import pyarrow as pa
import pytest

from seqloom.llm import bitslice, queries


def plain(ids, x, key, q, k=5):
    m = min(x.shape[1], len(q))
    return sorted((-int(q[:m] @ x[i, :m]), int(ids[i])) for i in range(len(ids)) if ids[i] != key)[:k]


@pytest.mark.parametrize("seed", range(40))
def test_chunk(seed):
    r = np.random.default_rng(seed)
    n, dims, width = r.integers(1, 300), r.integers(1, 6), r.choice([0, 1, 3, 1000])
    x, ids = r.integers(-width, width + 1, (n, dims)), r.permutation(n * 2)[:n]
    chunk = bitslice.Chunk(**bitslice.slice_rows(ids, list(x)))
    for key, q in ((ids[0], x[0]), (-1, r.integers(-9, 9, dims)), (-1, np.zeros(dims, np.int64)), (-1, r.integers(-9, 9, dims + 2))):
        keys, scores = chunk.top(int(key), q, 5)
        assert sorted(zip((-scores).tolist(), keys.tolist())) == plain(ids, x, key, q)


def test_signed_digits():
    q = np.arange(-300, 300)
    d = bitslice.signed_digits(q)
    assert (d @ (1 << np.arange(d.shape[1])) == q).all() and not (d[:, 1:] * d[:, :-1]).any()


def test_quantise():
    got = bitslice.quantise(pa.array([[0.5, -0.001], None, [None, 1.0], [float("nan")], [float("inf")], [], [1e30]], pa.list_(pa.float64())))
    assert got[0].tolist() == [128, -1] and got[5].tolist() == [] and [g is None for g in got] == [False, True, True, True, True, False, True]


def test_query(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.floor(256 * np.array([r["embedding"] for r in rows], np.float64)).astype(np.int64)
    found = {}
    for r in queries.op9_exact_top_k(spark, d).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    assert sorted(found) == [i for i in ids.tolist() if i % 50 == 0]
    for key, own in found.items():
        assert [(s, v) for _, s, v in sorted(own)] == plain(ids, x, key, x[np.flatnonzero(ids == key)[0]])


@pytest.mark.parametrize("block", [1, 4096])
def test_odd_vectors(spark, block):
    rows = [(0, [1.0, 2.0], "r"), (1, None, "r"), (2, [None, 1.0], "r"), (3, [float("nan"), 1.0], "r"), (4, [1.0, 2.0], "r"), (4, [1.0, 2.0], "r"), (50, [-1.0, 0.5], None), (None, [9.0, 9.0], "r"), (100, [], "r"), (150, None, "r")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    index = bitslice.build_index(df, "vec_id", "embedding", size=2)
    got = sorted(tuple(r) for r in bitslice.search(index, df.where("vec_id % 50 = 0"), "vec_id", "embedding", block=block).collect())
    one = 256 * 256
    want = [(0, 1, 4, 5 * one), (0, 2, 4, 5 * one), (0, 3, 50, 0), (0, 4, 100, 0), (50, 1, 0, 0), (50, 2, 4, 0), (50, 3, 4, 0), (50, 4, 100, 0)]
    assert got == want + [(100, 1, 0, 0), (100, 2, 4, 0), (100, 3, 4, 0), (100, 4, 50, 0)]
    empty = bitslice.build_index(df.limit(0), "vec_id", "embedding")
    assert bitslice.search(empty, df.limit(0), "vec_id", "embedding").count() == 0


@pytest.mark.parametrize("seed", range(10))
def test_wide_chunk(seed):
    r = np.random.default_rng(seed)
    ids = r.permutation(200)[:100]
    rows = [np.array([int(r.integers(-(2**62), 2**62)) >> int(r.integers(0, 62)) for _ in range(3)]) for _ in ids]
    rows[0][:2] = -(2**63), 2**63 - 1
    chunk = bitslice.Chunk(**bitslice.slice_rows(ids, rows))
    for q in (rows[0], rows[1], np.array([1, -2, 3]), np.array([2**63 - 1, -(2**63), 0])):
        keys, scores = chunk.top(int(ids[1]), q, 5)
        want = sorted((-sum(int(a) * int(b) for a, b in zip(q, x)), int(i)) for i, x in zip(ids, rows) if i != ids[1])[:5]
        assert sorted(zip((-scores).tolist(), keys.tolist())) == want


def test_large_components_as_sql(spark):
    """Vectors of over 2**26 after scaling, as query and as candidate, give what the query's SQL gives."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, [float(k % 7), -0.5 * k, 1.0]) for k in range(20)] + [(50, [3e6, -2.5, 1e5]), (51, [262_145.0, 1.0, 0.0]), (52, [-4e6, 2.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = bitslice.search(bitslice.build_index(df, "vec_id", "embedding"), df.where("vec_id % 50 = 0"), "vec_id", "embedding").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.OP9).fetchall())
    assert {r["query_id"] for r in got} == {0, 50} and 50 in {r["vec_id"] for r in got}


@pytest.mark.parametrize("far,fails", [(3e16, True), (1e30, True), (1e308, True), (-1e13, False), (-3e16, False)])
def test_what_does_not_fit(spark, far, fails):
    """Only a component or a reported score beyond the longs is an error."""
    df = spark.createDataFrame([(k, [100.0 + k]) for k in range(7)] + [(9, [far])], "vec_id bigint, embedding array<double>")
    search = lambda k: bitslice.search(bitslice.build_index(df, "vec_id", "embedding", size=1), df.where("vec_id = 0"), "vec_id", "embedding", k).collect()
    if not fails:
        assert [r["vec_id"] for r in sorted(search(5), key=lambda r: r["rank"])] == [6, 5, 4, 3, 2]
    if fails or far == -3e16:
        with pytest.raises(Exception, match="fit a long"):
            search(7)


def test_query_blocks_by_number_and_by_bytes(spark, monkeypatch):
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(k, r.normal(0, 1, 6).tolist()) for k in range(120)], "vec_id bigint, embedding array<double>")
    index, queries_ = bitslice.build_index(df, "vec_id", "embedding"), df.where("vec_id % 10 = 0")
    found = lambda **o: sorted(map(tuple, bitslice.search(index, queries_, "vec_id", "embedding", **o).collect()))
    once = found()
    assert len(once) == 60 and found(block=1) == once and found(block=5) == once
    monkeypatch.setattr(bitslice, "QUERY_BYTES", 100)
    assert found() == once
