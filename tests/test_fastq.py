"""The FASTQ source and sinks: parser rules, every split position, round trips, streams."""

import gzip
import io
import random

import pytest

from seqloom.schema import READ_SCHEMA
from seqloom.sources import fastq, files, sinks
from seqloom.streaming.reads import stream_fastq

CASES = {
    "basic": (b"@a\nACGT\n+\nIIII\n", [("a", "ACGT", "", "IIII")]),
    "nomark": (b"a\nAC\nx\nII\n", [("a", "AC", "x", "II")]),
    "double": (b"@@a\nAC\n++b\nII\n", [("@a", "AC", "+b", "II")]),
    "notail": (b"@a\nAC\n+\nII\n@b\nGG\n+\nJJ", [("a", "AC", "", "II")]),
    "crlf": (b"@a\r\nAC\r\n+\r\nII\r\n", [("a\r", "AC\r", "\r", "II\r")]),
    "blank": (b"\n@a\nAC\n+\nII\n", [("", "@a", "AC", "+")]),
    "latin": (b"@\xe9\nAC\n+\n\xff!\n", [("\xe9", "AC", "", "\xff!")]),
    "empty": (b"", []),
}


def rows(df):
    return [(r["id1"], r["seq"], r["id2"], r["qual"]) for r in df.orderBy("source_file", "rec_no").collect()]


@pytest.mark.parametrize("name", CASES)
def test_rules(spark, tmp_path, name):
    data, want = CASES[name]
    path = tmp_path / "x.fastq"
    path.write_bytes(data)
    assert rows(fastq.read_fastq(spark, str(path))) == want
    with gzip.open(tmp_path / "x.fastq.gz", "wb") as f:
        f.write(data)
    assert rows(fastq.read_fastq(spark, str(tmp_path / "x.fastq.gz"))) == want
    assert rows(fastq.read_fastq(spark, f"file://{path}")) == want


def test_lenient_tail(spark, tmp_path):
    (tmp_path / "x").write_bytes(CASES["notail"][0])
    assert len(rows(fastq.read_fastq(spark, str(tmp_path / "x"), strict_tail=False))) == 2


def cut_rows(data, size, chunk):
    out = []
    for start in range(0, len(data), size):
        split = fastq.FastqSplit("x", start, min(start + size, len(data)), data[:start].count(b"\n"))
        for b in fastq.read_split(io.BytesIO(data), split, chunk=chunk):
            out += [(r["rec_no"], r["id1"], r["seq"], r["id2"], r["qual"]) for r in b.to_pylist()]
    return out


def test_every_split():
    r = random.Random(3)
    data = b"".join(b"@%s\n%s\n+\n@%s\n" % (b"i" * r.randint(0, 4), b"A" * (n := r.randint(0, 9)), b"+" * n) for _ in range(12)) + b"@tail\nA"
    whole = cut_rows(data, len(data), 1 << 20)
    assert len(whole) == 12 and [w[0] for w in whole] == list(range(12))
    for size in range(1, len(data)):
        for chunk in (1, 5, 1 << 20):
            assert cut_rows(data, size, chunk) == whole, (size, chunk)


def test_split_job(spark, tmp_path):
    data = b"".join(b"@r%d\nACGTACGT\n+\nIIIIIIII\n" % i for i in range(500))
    (tmp_path / "a").write_bytes(data)
    (tmp_path / "b").write_bytes(data[:260])
    df = fastq.read_fastq(spark, [str(tmp_path / "a"), str(tmp_path / "b")], split_bytes=777)
    assert df.where("source_file like '%a'").count() == 500 and df.rdd.getNumPartitions() > 10
    assert sorted(r["rec_no"] for r in df.where("source_file like '%a'").collect()) == list(range(500))


def test_first_and_file_numbers(spark, tmp_path):
    data = b"".join(b"@r%d\nACGTACGT\n+\nIIIIIIII\n" % i for i in range(500))
    a, b = str(tmp_path / "z"), str(tmp_path / "y.gz")
    (tmp_path / "z").write_bytes(data)
    (tmp_path / "y.gz").write_bytes(gzip.compress(data[:260]))
    df = fastq.read_fastq(spark, [a, "none", b, a], missing="skip", split_bytes=777, file_no=True)
    assert [(r["file_no"], r["rec_no"]) for r in df.collect()] == [(0, k) for k in range(500)] + [(2, k) for k in range(10)] + [(3, k) for k in range(500)]
    assert [r["rec_no"] for r in fastq.read_fastq(spark, [a, b], split_bytes=777, records=(0, 12)).collect()] == [*range(12), *range(10)]
    # Nothing behind the chunk with the last wanted read is read.
    read = 0

    class Counting:
        def read(self, n):
            nonlocal read
            read += n
            return data[read - n : read]

    found = list(fastq.read_split(Counting(), fastq.FastqSplit("f", 0, -1, 0), chunk=100, stop=7))
    assert sum(x.num_rows for x in found) == 7 and read <= 300


def test_round_trip_of_many_files(spark, tmp_path):
    rows = [("f", k, f"id {k}", "ACGT" * (k % 9), "x" * (k % 2), "I" * (4 * (k % 9))) for k in range(400)]
    df = spark.createDataFrame(rows, READ_SCHEMA).repartitionByRange(5, "rec_no").sortWithinPartitions("rec_no")
    sinks.write_fastq(df, str(tmp_path / "out"))
    found = files.list_files(str(tmp_path / "out"))
    back = fastq.read_fastq(spark, found, split_bytes=500).collect()
    assert len(found) > 1 and [tuple(r)[2:] for r in back] == [r[2:] for r in rows]


def test_missing(spark, tmp_path):
    (tmp_path / "a").write_bytes(CASES["basic"][0])
    with pytest.raises(OSError):
        fastq.read_fastq(spark, [str(tmp_path / "a"), str(tmp_path / "none")])
    assert fastq.read_fastq(spark, [str(tmp_path / "a"), str(tmp_path / "none")], missing="skip").count() == 1
    assert fastq.read_fastq(spark, str(tmp_path / "none"), missing="skip").count() == 0


def test_round_trip(spark, tmp_path):
    (tmp_path / "a").write_bytes(CASES["double"][0] + CASES["latin"][0])
    df = fastq.read_fastq(spark, str(tmp_path / "a"))
    sinks.write_fastq(df.coalesce(1), str(tmp_path / "out"))
    parts = list((tmp_path / "out").glob("part-*"))
    assert b"".join(p.read_bytes() for p in parts) == CASES["double"][0] + CASES["latin"][0]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_fastq(df, str(tmp_path / "out"))
    sinks.write_fastq(df, str(tmp_path / "out"), overwrite=True)


def test_any_quality_is_written(spark, tmp_path):
    qual = bytes(range(33, 127)) + b" \\\"',\t#"
    for lead in (b'"', b"#", b" ", b"\\", b""):
        data = b"@ a \n" + lead + b"\n+\n" + lead + qual + b" \n"
        (tmp_path / "q").write_bytes(data)
        sinks.write_fastq(fastq.read_fastq(spark, str(tmp_path / "q")), str(tmp_path / "o"), overwrite=True)
        assert b"".join(p.read_bytes() for p in (tmp_path / "o").glob("part-*")) == data


def test_nul_ends_a_field(spark):
    df = spark.createDataFrame([("f", 0, "a", "AC", "", "I\0I")], "source_file string, rec_no bigint, id1 string, seq string, id2 string, qual string")
    assert sinks.fastq_text(df).first()["value"] == "@a\nAC\n+\nI"


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("basic", "notail", "empty", "nomark"):
        (folder / name).write_bytes(CASES[name][0])
    query = stream_fastq(spark, str(folder)).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["id1"] for r in spark.table("streamed").collect()) == ["a", "a", "a"]
