"""Records and columns that are asked of the FASTQ source, small files together, and bounded plans."""

import pytest

from seqloom.operators import quality
from seqloom.sources import fastq

DATA = b"".join(b"@r%d\nACGTACGT\n+\nIIIIIIII\n" % i for i in range(500))


@pytest.fixture
def paths(tmp_path):
    (tmp_path / "a").write_bytes(DATA)
    (tmp_path / "b").write_bytes(DATA[:5000])
    return [str(tmp_path / "a"), str(tmp_path / "b")]


@pytest.mark.parametrize("sequential", [1 << 20, 0])
@pytest.mark.parametrize("start, stop, most", [(0, 20, 4), (300, 301, 2), (480, None, 3), (480, 485, 2), (0, 0, 4), (0, None, 99), (600, None, 4), (100, 103, 4)])
def test_splits_without_wanted_records_are_not_planned(spark, paths, monkeypatch, sequential, start, stop, most):
    monkeypatch.setattr(fastq, "SEQUENTIAL", sequential)
    some = fastq.read_fastq(spark, paths, split_bytes=777, records=(start, stop))
    assert some.rdd.getNumPartitions() <= most
    for path, n in zip(paths, (500, DATA[:5000].count(b"\n") // 4)):
        assert [r["rec_no"] for r in some.collect() if r["source_file"] == path] == list(range(n))[start:stop]


def test_filters_of_one_query_do_not_touch_another(spark, paths):
    """What the source must not do: hold on to a filter."""
    reads = fastq.read_fastq(spark, paths[:1], split_bytes=777)
    assert reads.where("rec_no < 10").union(reads.where("rec_no >= 400")).count() == 110
    assert reads.where("rec_no < 10").count() == 10 and reads.count() == 500


def test_detection_needs_the_beginnings_only(spark, paths):
    whole, some = fastq.read_fastq(spark, paths, split_bytes=777), fastq.read_fastq(spark, paths, split_bytes=777, records=(0, 10))
    assert some.rdd.getNumPartitions() == 2
    found = [sorted(map(tuple, quality.detect_scale(df, limit=10).collect())) for df in (whole, some)]
    assert found[0] == found[1] and {r[3] for r in found[0]} == {"Sanger/Phred+33"}


def test_nothing_behind_the_last_wanted_record_is_read():
    read = 0

    class Counting:
        def read(self, n):
            nonlocal read
            read += n
            return DATA[read - n : read]

    found = list(fastq.read_split(Counting(), fastq.FastqSplit("f", 0, -1, 0), chunk=100, start=3, stop=7))
    assert [x for b in found for x in b.column("rec_no").to_pylist()] == [3, 4, 5, 6] and read <= 300


def test_only_wanted_columns_are_made(spark, tmp_path):
    (tmp_path / "a").write_bytes(DATA)
    df = fastq.read_fastq(spark, str(tmp_path / "a"), columns=["qual", "seq"], split_bytes=777)
    assert df.columns == ["seq", "qual"] and df.distinct().count() == 1 and df.count() == 500
    assert fastq.read_fastq(spark, str(tmp_path / "a"), columns=["seq"], file_no=True).columns == ["seq", "file_no"]


def test_small_files_share_a_partition(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"{k:02d}").write_bytes(b"@f%d\nAC\n+\nII\n" % k)
    df = fastq.read_fastq(spark, [str(p) for p in sorted(tmp_path.iterdir())], split_bytes=150)
    assert 4 <= df.rdd.getNumPartitions() <= 6
    (tmp_path / "99").write_bytes(DATA)
    df = fastq.read_fastq(spark, [str(p) for p in sorted(tmp_path.iterdir())], split_bytes=150)
    assert [r["id1"] for r in df.collect()][:41] == [*(f"f{k}" for k in range(40)), "r0"]


def test_a_plan_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fastq, "MOST_RANGES", 10)
    (tmp_path / "a").write_bytes(DATA)
    df = fastq.read_fastq(spark, str(tmp_path / "a"), split_bytes=50)
    assert df.rdd.getNumPartitions() <= 10 and [r["rec_no"] for r in df.collect()] == list(range(500))
