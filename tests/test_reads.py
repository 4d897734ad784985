"""Operators over reads: fixtures, independent models and metamorphic relations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequences
from seqloom.functions.hashing import murmur3, record_hash
from seqloom.functions.patterns import UnsupportedPattern, java_pattern
from seqloom.operators import align, grep, kmers, quality, sampling, sorting, uniq
from seqloom.operators.ranking import global_rank
from seqloom.schema import READ_SCHEMA


def make(spark, seqs, quals=None, ids=None, files=None):
    rows = []
    for i, s in enumerate(seqs):
        rows.append((files[i] if files else "f", i, ids[i] if ids else f"r{i}", s, "", quals[i] if quals else "I" * len(s)))
    return spark.createDataFrame(rows, READ_SCHEMA)


@pytest.fixture(scope="module")
def some(spark):
    r = random.Random(5)
    seqs = ["".join(r.choice("ACGTNacgt") for _ in range(r.randint(0, 30))) for _ in range(120)] + ["", "A", "ACGT"]
    quals = ["".join(chr(r.randint(33, 126)) for _ in s) for s in seqs]
    return seqs, quals, make(spark, seqs, quals).cache()


# ---------------------------------------------------------------- grep


def test_trim(spark):
    df = make(spark, ["AATTGG"], ["abcdef"])
    cut = lambda **o: [tuple(r) for r in grep.grep(df, "TT", **o).select("seq", "qual").collect()]
    assert cut(trim_before=True) == [("TTGG", "cdef")]
    assert cut(trim_before=True, trim_match=True) == [("GG", "ef")]
    assert cut(trim_after=True) == [("AATT", "abcd")]
    assert cut(trim_after=True, trim_match=True) == [("AA", "ab")]
    assert cut(trim_match=True) == [("AATTGG", "abcdef")]
    assert [tuple(r) for r in grep.grep(df, "", trim_after=True).select("seq").collect()] == [("",)]


def test_trim_of_short_quality(spark):
    assert grep.grep(make(spark, ["AATTGG"], ["ab"]), "TT", trim_before=True).first()["qual"] == ""


def test_grep_rules(spark, some):
    df = some[2]
    for options in ({"trim_before": True, "trim_after": True}, {"on": "id", "trim_after": True}, {"invert": True, "trim_before": True}, {"on": "qual"}):
        with pytest.raises(ValueError):
            grep.grep(df, "A", **options)
    with pytest.raises(ValueError):
        grep.grep(df, None)
    assert grep.grep(df, "ac").count() + grep.grep(df, "ac", invert=True).count() == df.count()
    a, b = grep.grep_split(df, "ac", invert=True)
    assert a.count() == grep.grep(df, "AC", invert=True).count() and a.count() + b.count() == df.count()
    assert grep.grep(df, "ac", case_sensitive=True).count() < grep.grep(df, "ac").count()
    files = spark.createDataFrame([("f",), ("empty",)], "source_file string")
    assert {r[0]: r[1] for r in grep.grep_count(df, "ac", files=files).collect()} == {"f": grep.grep(df, "ac").count(), "empty": 0}


def test_constructs_of_the_dialect(spark):
    for bad in ("(?R)", "(?1)", "(a(?1))", "(a|(b(?1)))", r"(a\Kb)", "(?(1)a)", "(?(R)a)", "(*FAIL)", "[[:nope:]]", r"\2(a)", "(?&x)", "(?P>x)"):
        with pytest.raises(UnsupportedPattern):
            java_pattern(bad)
    df = make(spark, ["a\rb", "zz", "p:"])
    assert grep.grep(df, "a.b").count() == 1
    assert [r["seq"] for r in grep.grep(df, "^[[:alpha:]]+$").collect()] == ["zz"]
    assert grep.grep(df, r"\\K").count() == 0


# ---------------------------------------------------------------- histograms


def test_kmers(spark, some):
    got = {r["kmer"]: r["frequency"] for r in kmers.kmers(make(spark, ["ACGNACG"]), 2).collect()}
    assert len(got) == 16 and got["AC"] == 2 and got["CG"] == 2 and sum(got.values()) == 4
    order = [r["kmer"] for r in kmers.kmers(make(spark, ["AC"]), 2).orderBy(kmers.kmer_order()).collect()]
    assert order[:5] == ["AA", "CA", "GA", "TA", "AC"]
    assert kmers.kmers(make(spark, ["AC"]), 3).agg(F.sum("frequency")).first()[0] == 0
    want = {}
    for s in some[0]:
        for i in range(len(s) - 3):
            w = s[i : i + 4].upper()
            if set(w) <= set("ACGT"):
                want[w] = want.get(w, 0) + 1
    assert {r["kmer"]: r["frequency"] for r in kmers.kmers(some[2], 4, dense=False).collect()} == want
    for k in (0, 17):
        with pytest.raises(ValueError):
            kmers.kmers(some[2], k)


def test_uniq(spark, some):
    rows = uniq.uniq_ranked(some[2]).orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(len(set(some[0])))) and sum(r["copies"] for r in rows) == len(some[0])
    assert [(-r["copies"], r["seq"]) for r in rows] == sorted((-r["copies"], r["seq"]) for r in rows)
    assert uniq.uniq_fasta(make(spark, ["AC", "AC"])).first()["value"] == ">unique-read-0000000 (2 copies)\nAC"


def test_quality_table(spark):
    df = make(spark, ["AC", "ACGTA"], ["!!", "!IIII"])
    got = {(r["pos"], r["qual"]): r["n"] for r in quality.qual_table(df).collect()}
    assert got == {(0, 33): 2, (1, 33): 1, (1, 73): 1, (2, 73): 1, (3, 73): 1, (4, 73): 1}
    assert quality.qual_table(df, dense=True).count() == 255 * 5
    assert quality.qual_table(df.limit(0), dense=True).count() == 0
    assert quality.qual_lines(df).where("qual = 33").first()["value"] == "2\t1\t0\t0\t0"


def test_quality_shift(spark):
    df = make(spark, ["ACG"], ["!I~"])
    assert quality.qual_adjust(df, 31).first()["qual"] == "@h~"
    assert quality.qual_adjust(df, -40).first()["qual"] == "\0" + chr(33) + chr(86)
    assert quality.qual_adjust(quality.qual_adjust(df, 0), 0).first()["qual"] == "!I~"
    with pytest.raises(ValueError):
        quality.qual_adjust(df, 200)


@pytest.mark.parametrize("quals,want", [(["!J", "!~"], "Illumina 1.8/Phred+33"), (["!~"], None), (["II"], "Sanger/Phred+33"), (["BB", "hh"], "Illumina 1.5/Phred+64"), ([""], "Sanger/Phred+33")])
def test_scale(spark, quals, want):
    got = quality.detect_scale(make(spark, ["A" * len(q) for q in quals], quals))
    assert got.first()["scale"] == want
    line = quality.scale_lines(got).first()["value"]
    assert line == f"f: {want}" if want else line == "f: Unknown scale ['!', '~']"


def test_scale_limit(spark):
    df = make(spark, ["A", "A"], ["I", "~"])
    assert quality.detect_scale(df, limit=1).first()["scale"] == "Sanger/Phred+33"


# ---------------------------------------------------------------- alignment


def textbook(query, read, d=align.MATRICES["default"]):
    code = align.base_codes()
    x, y = [int(code[ord(c)]) for c in read], [int(code[ord(c)]) for c in query]
    low = -(10**9)
    h = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    e = [[low] * (len(y) + 1) for _ in range(len(x) + 1)]
    f = [[low] * (len(y) + 1) for _ in range(len(x) + 1)]
    best = 0
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            e[i][j] = max(h[i - 1][j] - 4, e[i - 1][j] - 3)
            f[i][j] = max(h[i][j - 1] - 4, f[i][j - 1] - 3)
            h[i][j] = max(0, h[i - 1][j - 1] + int(d[y[j - 1], x[i - 1]]), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def test_alignment(spark):
    r = random.Random(1)
    reads = ["".join(r.choice("ACGTN") for _ in range(r.randint(0, 40))) for _ in range(60)] + ["", "A", "acgu"]
    df = make(spark, reads)
    for query in ("ACGT", "A", "N", "ACGTTGCAACGTAACC", reads[0][:12] + "ACCCA" + reads[0][12:] or "A"):
        code = align.base_codes()
        got = {x["seq"]: x["score"] for x in align.align(df, query, mode="textbook").collect()}
        assert got == {s: textbook(query, s) for s in reads}
        parity = {x["seq"]: x["score"] for x in align.align(df, query).collect()}
        first = lambda s: bool(s) and code[ord(s[0])] == code[ord(query[0])] < 4  # noqa: B023, E731
        assert parity == {s: max(textbook(query[1:], s), int(first(s))) for s in reads}
    got = [x["score"] for x in align.align(make(spark, ["ACGT"]), "ACGT").collect()]
    assert got == [3]
    mat = {x["seq"]: x["score"] for x in align.align(df, "ACGTTG", mode="textbook", matrix="mat50").collect()}
    assert mat == {s: textbook("ACGTTG", s, align.MATRICES["mat50"]) for s in reads}
    assert align.align(make(spark, ["AU"]), "AA", mode="textbook").first()["score"] == 2
    assert align.align(make(spark, ["AU"]), "AT", mode="textbook", rna=True).first()["score"] == 2
    with pytest.raises(ValueError):
        align.align(df, "")


# ---------------------------------------------------------------- sorting


def test_natural_order(spark):
    ids = ["a10", "a2", "a02", "a/1", "", "a99999999999999999999", "a9223372036854775807x"]
    df = make(spark, ["A"] * len(ids), ids=ids)
    assert [r["id1"] for r in sorting.sort_reads(df, "natural").collect()][:5] == ["", "a/1", "a2", "a02", "a10"]


def test_natural_key(spark):
    import re

    r = random.Random(8)
    ids = ["".join(r.choice(["a", "/", "0", "1", "9", "00", "92233720368547758", "x9"]) for _ in range(r.randint(0, 6))) for _ in range(500)]
    ids += ["9223372036854775807", "9223372036854775808", "9223372036854775806", "09223372036854775808", "1" * 40, "0" * 40, "z0"]
    rows = make(spark, ["A"] * len(ids), ids=ids).select("id1", sequences.natural_key("id1").alias("k")).collect()
    most = 2**63 - 1
    for row in rows:
        assert row["k"] == re.sub("[0-9]+", lambda m: f"{min(int(m[0]), most):019d}", row["id1"])


def test_sort_keys(spark, some):
    seqs, quals, df = some
    gc = lambda s: np.float32(sum(c in "gcGC" for c in s) / len(s)) if s else np.float32(0)
    got = [r["rec_no"] for r in sorting.sort_reads(df, "gc").collect()]
    assert got == sorted(range(len(seqs)), key=lambda i: (gc(seqs[i]), i))
    mean = lambda q: np.float32(sum(map(ord, q)) / len(q)) if q else np.float32(0)
    got = [r["rec_no"] for r in sorting.sort_reads(df, "mean_qual", reverse=True).collect()]
    assert got == sorted(range(len(seqs)), key=lambda i: (-mean(quals[i]), i))
    assert [r["seq"] for r in sorting.sort_reads(df, "seq").collect()] == sorted(seqs)
    shuffled = [r["rec_no"] for r in sorting.sort_reads(df, "random", seed=3).collect()]
    assert sorted(shuffled) == list(range(len(seqs))) != shuffled
    assert shuffled == [r["rec_no"] for r in sorting.sort_reads(df, "random", seed=3).collect()]
    assert sorted(r["rec_no"] for r in sorting.sort_reads(df, "random", exact=True).collect()) == sorted(shuffled)
    with pytest.raises(ValueError):
        sorting.sort_reads(df, "length")


def test_global_rank(spark, some):
    ranked = global_rank(some[2], sorting.sort_order("seq"), "n").collect()
    assert {r["rec_no"]: r["n"] for r in ranked} == {i: n for n, i in enumerate(sorted(range(len(some[0])), key=lambda i: (some[0][i], i)))}


def test_murmur3(spark):
    # Published test vectors of the 32-bit function.
    for text, seed, want in ((b"", 0, 0), (b"", 1, 0x514E28B7), (b"test", 0, 0xBA6BD213), (b"Hello, world!", 0, 0xC0363E43), (b"The quick brown fox jumps over the lazy dog", 0, 0x2E4FF723)):
        assert int(murmur3([text], np.array([seed], np.uint32))[0]) == want
    df = make(spark, ["ACG", "ACG", "ACT"], ids=["a", "a", "a"])
    h = [r["h"] for r in df.select(record_hash().alias("h")).collect()]
    assert h[0] == h[1] != h[2]


def test_scalars(spark):
    df = make(spark, ["ACGTN", ""], ["IIIII", ""])
    rows = df.select(sequences.gc_fraction("seq").alias("gc"), sequences.mean_quality("qual").alias("q"), sequences.reverse_complement("seq").alias("rc")).collect()
    assert [(round(r["gc"], 6), r["q"], r["rc"]) for r in rows] == [(0.4, 73.0, "NACGT"), (0.0, 0.0, "")]


# ---------------------------------------------------------------- sampling


def test_sample_sizes():
    assert [sampling.sample_size(10, 3), sampling.sample_size(10, 30), sampling.sample_size(10, 3, 0.25), sampling.sample_size(10, 3, 2.0), sampling.sample_size(10, 3, 2.0, True)] == [3, 10, 3, 10, 20]
    assert sampling.sample_size(10, 3, 0.0) == 3
    with pytest.raises(ValueError):
        sampling.sample_size(10, 3, -1)


@pytest.mark.parametrize("method", ["hash", "mt"])
def test_sample_partitions(some, method):
    df = some[2]
    for k in (0, 1, 17, 123, 500):
        a, b = sampling.sample_reads(df, k=k, method=method, seed=9)
        got = sorted(r["rec_no"] for r in a.collect())
        assert len(got) == min(k, 123) and sorted(got + [r["rec_no"] for r in b.collect()]) == list(range(123))
    a, b = sampling.sample_reads(df, k=20, method=method, replacement=True)
    assert a.count() == 20 and b.count() == 123 - len({r["rec_no"] for r in a.collect()})
    empty = sampling.sample_reads(df.limit(0), k=5, method=method)
    assert empty[0].count() == empty[1].count() == 0


def twister(seed):
    state = np.random.RandomState(seed)
    while True:
        yield int(state.randint(0, 2**32, dtype=np.uint32))


def test_generator():
    draws, n = twister(4357), 50
    xs = list(range(n))
    for i in range(n - 1, 0, -1):
        scale = (2**32 - 1) // (i + 1)
        while (r := next(draws) // scale) >= i + 1:
            pass
        xs[r], xs[i] = xs[i], xs[r]
    assert sampling.draw_indices(n, 10, False, 0).tolist() == sorted(xs[:10])


def test_paired(spark, some):
    one, two = sampling.sample_paired(some[2], some[2], k=10)
    assert sorted(r["rec_no"] for r in one.collect()) == sorted(r["rec_no"] for r in two.collect())
    with pytest.raises(ValueError):
        sampling.sample_paired(some[2], some[2].where("rec_no > 0"), k=10)


def test_rank_of_one_value(spark):
    """Rows that agree in the first key are numbered by the others, in several partitions."""
    df = make(spark, ["A"] * 3000, ids=["x"] * 3000).repartition(5)
    ranked = sorting.sort_positions(df, "seq", reverse=True).collect()
    assert all(r["position"] == r["rec_no"] for r in ranked) and len(ranked) == 3000


def test_first_reads(spark):
    r = random.Random(3)
    rows = [(f, n) for f, most in (("a", 5000), ("b", 300), ("c", 40)) for n in r.sample(range(10**9), most)]
    df = spark.createDataFrame(rows, "source_file string, rec_no bigint")
    for limit in (1, 50, 299, 300, 4999, 6000):
        found = {}
        for x in quality.first_reads(df, limit, bins=16).collect():
            found.setdefault(x["source_file"], set()).add(x["rec_no"])
        for f in "abc":
            own = sorted(n for g, n in rows if g == f)
            assert set(own[:limit]) <= found[f] and (len(own) <= limit or len(found[f]) <= limit + len(own) / 4)


def test_draws_in_blocks():
    """Blocks with rejected numbers taken out are what single draws give."""
    bounds = np.array([2**31 + 7, 3, 2**32 - 2, 10, 2**31 + 1] * 40, np.int64)
    state, want = np.random.RandomState(5), []
    for b in bounds:
        while (x := int(state.randint(0, 2**32, dtype=np.uint32)) // (0xFFFFFFFF // int(b))) >= b:
            pass
        want.append(x)
    assert sampling.uniform_integers(5, bounds).tolist() == want


@pytest.mark.parametrize("pattern,seq,hit", [("[A&&C]", "&", True), ("[A&&C]", "a", True), ("[A&&C]", "G", False), ("[[A]", "[", True), ("[[A]", "A", True), ("(?P<n>A)C", "ac", True), ("(?#c)A", "A", True), ("(?P<n>A)(?P=n)", "AA", True), ("[]A]", "]", True), ("[^]A]", "]", False), ("[\\]A]", "]", True), ("[[:alpha:]&]", "&", True)])
def test_dialect(spark, pattern, seq, hit):
    assert grep.grep(make(spark, [seq]), pattern).count() == int(hit)


@pytest.mark.parametrize("pattern", ["a(", "[A", "(?#c", "a{2,1}", "*a"])
def test_bad_patterns_fail_on_the_driver(spark, pattern):
    with pytest.raises(UnsupportedPattern, match="offset"):
        grep.grep(make(spark, ["A"]), pattern)


# ---------------------------------------------------------------- ragged batches, draws without a join


def plain_score(query, read, matrix):
    """Gotoh's recurrence, cell by cell."""
    best, m = 0, len(query)
    h, t = [0] * (m + 1), [-(10**6)] * (m + 1)
    for x in read:
        diagonal, u, new = 0, -(10**6), [0] * (m + 1)
        for j in range(1, m + 1):
            t[j] = max(h[j] - 4, t[j] - 3)
            u = max(new[j - 1] - 4, u - 3)
            new[j] = max(0, h[j - 1] + int(matrix[query[j - 1], x]), t[j], u)
            best = max(best, new[j])
        h = new
    return best


@pytest.mark.parametrize("piece", [1, 3, 17, 1 << 17])
def test_scores_however_letters_are_cut(piece):
    r = np.random.default_rng(1)
    for name in align.MATRICES:
        reads = [r.integers(0, 5, r.integers(0, 60)) for _ in range(40)] + [np.empty(0, np.int64)] + [np.tile([0, 1, 2, 3], 40)]
        query = r.integers(0, 5, 9)
        letters = np.concatenate(reads)
        starts = np.cumsum([0, *map(len, reads)])[:-1]
        found = align.local_scores(query, letters, starts, align.MATRICES[name], piece)
        assert found.tolist() == [plain_score(query.tolist(), x.tolist(), align.MATRICES[name]) for x in reads]


def test_one_long_read_among_short_ones_needs_little_memory():
    import tracemalloc

    r = np.random.default_rng(2)
    reads = [r.integers(0, 4, 1_000_000), *(r.integers(0, 4, 100) for _ in range(2047))]
    letters, starts = np.concatenate(reads), np.cumsum([0, *map(len, reads)])[:-1]
    query = r.integers(0, 4, 12)
    tracemalloc.start()
    found = align.local_scores(query, letters, starts, align.MATRICES["default"])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20
    assert found[0] >= 8 and found[5] == plain_score(query.tolist(), reads[5].tolist(), align.MATRICES["default"])


def test_hashes_of_ragged_batches():
    import tracemalloc

    r = random.Random(3)
    values = [r.randbytes(n) for n in (0, 1, 2, 3, 4, 5, 7, 8, 1000, 16_384, 16_385, 1_000_003, 20_001)] + [r.randbytes(r.randrange(200)) for _ in range(5000)]
    seeds = np.array([r.randrange(2**32) for _ in values], np.uint32)
    tracemalloc.start()
    found = murmur3(values, seeds)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20
    order = r.sample(range(len(values)), 60) + list(range(13))
    assert [int(murmur3([values[k]], seeds[k : k + 1])[0]) for k in order] == [int(found[k]) for k in order]
    from seqloom.functions import hashing

    for k in range(8, 13):  # a long string's words one after the other are what they are together
        assert hashing._folded_long(values[k], int(seeds[k])) == int(hashing._folded([values[k]], seeds[k : k + 1])[0])


def test_draws_of_blocks_add_up(monkeypatch):
    for n, size in ((1, 5), (7, 0), (1000, 1), (65_536, 500), (65_537, 70_000), (300_000, 3_000_000)):
        counts = [sampling.draws_of_block(n, size, 11, b) for b in range(-(-n // sampling.DRAW_BLOCK))]
        assert sum(map(len, counts)) == n and int(sum(c.sum() for c in counts)) == size
    monkeypatch.setattr(sampling, "DRAW_BLOCK", 10)
    total = np.zeros(95)
    for seed in range(400):
        total += np.concatenate([sampling.draws_of_block(95, 950, seed, b) for b in range(10)])
    expected = 400 * 950 / 95
    assert ((total - expected) ** 2 / expected).sum() < 95 + 5 * (2 * 95) ** 0.5  # chi-square, five deviations


def test_drawing_with_replacement_moves_no_read(spark, some):
    df = some[2]
    taken, rest = sampling.sample_reads(df, k=60, replacement=True, seed=4)
    for part in (taken, rest):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    rows = [r["rec_no"] for r in taken.collect()]
    assert len(rows) == 60 and rows != sorted(set(rows))
    assert sorted(set(rows)) == sorted(set(range(123)) - {r["rec_no"] for r in rest.collect()})
    again = sampling.sample_reads(df.repartition(5), k=60, replacement=True, seed=4)[0]
    assert sorted(r["rec_no"] for r in again.collect()) == sorted(rows)


@pytest.mark.parametrize("replacement", [False, True])
def test_mates_are_filtered_and_not_joined(spark, some, replacement):
    mates = some[2].withColumn("source_file", F.lit("mates"))
    one, two = sampling.sample_paired(some[2], mates, k=30, replacement=replacement, seed=2)
    assert sorted(r["rec_no"] for r in one.collect()) == sorted(r["rec_no"] for r in two.collect()) and two.count() == 30
    for part in (one, two):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_quality_table_of_long_reads(spark, monkeypatch):
    monkeypatch.setattr(quality, "POSITIONS", 4)
    monkeypatch.setattr(quality, "BLOCKS", 3)
    monkeypatch.setattr(quality, "PIECE", 11)
    r = random.Random(5)
    quals = ["".join(chr(r.choice([33, 60, 126, 200, 255])) for _ in range(r.randrange(70))) for _ in range(60)] + ["", "I" * 300]
    df = make(spark, ["A"] * len(quals), quals)
    want = {}
    for q in quals:
        for k, c in enumerate(q):
            if ord(c) <= 254:
                want[k, ord(c)] = want.get((k, ord(c)), 0) + 1
    assert {(r["pos"], r["qual"]): r["n"] for r in quality.qual_table(df).collect()} == want
    for plan in (quality.qual_table(df), quality.qual_table(df, dense=True)):
        assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()
    lines = {r["qual"]: r["value"].split("\t") for r in quality.qual_lines(df).collect()}
    assert len(lines) == 255 and all(len(x) == 300 for x in lines.values())
    assert {(k, q): int(n) for q, x in lines.items() for k, n in enumerate(x) if n != "0"} == want


def test_quality_table_of_a_million_positions(spark):
    df = make(spark, ["A", "C"], ["I" * 1_000_000, "II"])
    assert quality.qual_table(df).agg(F.count("*"), F.sum("n")).first()[:] == (1_000_000, 1_000_002)


def test_detection_is_one_pass_without_a_window(spark, some):
    plan = quality.detect_scale(some[2])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Scan") <= 2


@pytest.mark.parametrize("n, size, block", [(1, 1, 4), (5, 5, 2), (300, 7, 16), (5000, 40, 64), (5000, 4999, 1000), (100_000, 50, 1 << 20), (200_000, 3000, 10_000)])
def test_shuffling_backwards(n, size, block):
    """The places that a whole shuffle leaves in front."""
    for seed in (0, 7):
        places = np.arange(n)
        for i, j in zip(range(n - 1, 0, -1), sampling.uniform_integers(seed, np.arange(n, 1, -1)).tolist()):
            places[i], places[j] = places[j], places[i]
        assert sampling.draw_indices(n, size, False, seed, block).tolist() == sorted(places[:size].tolist())


def test_exact_draws_hold_little():
    import tracemalloc

    tracemalloc.start()
    found = sampling.draw_indices(10_000_000, 10_000, False, 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(found.tolist())) == 10_000 and most < 150 << 20
