"""The command line on small files."""

from pathlib import Path

import pytest

from seqloom import cli
from seqloom.operators import grep, quality, uniq
from seqloom.operators.kmers import kmers
from seqloom.plans.shared import shared_dir
from seqloom.sources.fastq import read_fastq
from seqloom.sources.random_reads import random_reads
from seqloom.streaming.reads import stream_fastq


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.fq").write_bytes(b"@r10\nACGT\n+\nIIII\n@r2\nTTAC\n+\n!!II\n")
    (tmp_path / "b.fq").write_bytes(b"@r1\nACGT\n+\nBBhh\n")
    return str(tmp_path / "a.fq"), str(tmp_path / "b.fq")


def run(spark, capsysbinary, *args):
    assert cli.main(list(args)) == 0
    return capsysbinary.readouterr().out.decode()


def test_programs(spark, capsysbinary, files, tmp_path):
    a, b = files
    assert run(spark, capsysbinary, "grep", "-c", "acg", a, b) == "1\n1\n"
    assert run(spark, capsysbinary, "grep", "-b", "-t", "t", a) == "@r10\n\n+\n\n@r2\nTAC\n+\n!II\n"
    assert run(spark, capsysbinary, "grep", "-i", "R2", a) == "@r2\nTTAC\n+\n!!II\n"
    assert run(spark, capsysbinary, "grep", "-v", "acg", a) == "@r2\nTTAC\n+\n!!II\n"
    assert run(spark, capsysbinary, "kmers", "-k", "1", a) == "kmer\tfrequency\nA\t2\nC\t2\nG\t1\nT\t3\n"
    assert run(spark, capsysbinary, "match", "ACGT", a) == "ACGT\t3\nTTAC\t1\n"
    assert run(spark, capsysbinary, "uniq", a, b) == ">unique-read-0000000 (2 copies)\nACGT\n>unique-read-0000001 (1 copies)\nTTAC\n"
    assert run(spark, capsysbinary, "qual", b).splitlines()[66] == "1\t1\t0\t0"
    assert run(spark, capsysbinary, "qualadj", "1", b) == "@r1\nACGT\n+\nCCii\n"
    assert run(spark, capsysbinary, "qscale", a, b) == f"{a}: Sanger/Phred+33\n{b}: Illumina 1.5/Phred+64\n"
    (tmp_path / "e.fq").write_bytes(b"")
    assert run(spark, capsysbinary, "qscale", b, "none", str(tmp_path / "e.fq")).splitlines()[1] == f"{tmp_path}/e.fq: Unknown scale ['~', '!']"
    assert run(spark, capsysbinary, "grep", "-c", "acg", str(tmp_path / "e.fq"), "none", b) == "0\n1\n"
    assert run(spark, capsysbinary, "sort", "-n", a, b).split("\n")[0::4][:3] == ["@r1", "@r2", "@r10"]
    assert run(spark, capsysbinary, "sort", "-r", "-G", a).startswith("@r10")
    assert len(run(spark, capsysbinary, "sort", "-R", "--seed=3", a).splitlines()) == 8
    assert run(spark, capsysbinary, "grep", "acg", "none", b).endswith("BBhh\n")
    assert cli.main(["sort", "none"]) == 1 and cli.main(["grep", "-a", "-b", "x", a]) == 1


def test_order_of_files(spark, capsysbinary, files):
    a, b = files
    assert run(spark, capsysbinary, "grep", "ac", b, a).split("\n")[0::4][:3] == ["@r1", "@r10", "@r2"]
    assert run(spark, capsysbinary, "grep", "-c", "ac", b, a, b, "none", b) == "1\n2\n1\n1\n"
    assert run(spark, capsysbinary, "match", "ACGT", b, a, b).splitlines() == ["ACGT\t3", "ACGT\t3", "TTAC\t1", "ACGT\t3"]
    assert run(spark, capsysbinary, "qualadj", "0", b, a).split("\n")[0::4][:3] == ["@r1", "@r10", "@r2"]
    assert run(spark, capsysbinary, "sort", "-s", b, a).split("\n")[0::4][:3] == ["@r1", "@r10", "@r2"]
    assert run(spark, capsysbinary, "qscale", b, a, b).splitlines() == [f"{b}: Illumina 1.5/Phred+64", f"{a}: Sanger/Phred+33", f"{b}: Illumina 1.5/Phred+64"]


def test_standard_input_and_errors(spark, capsysbinary, files, monkeypatch):
    a, b = files
    for args in (["grep", "acg"], ["grep", "acg", "-"]):
        with open(a, "rb") as f:
            monkeypatch.setattr("sys.stdin", type("In", (), {"buffer": f}))
            assert run(spark, capsysbinary, *args) == "@r10\nACGT\n+\nIIII\n"
    with open(b, "rb") as f:
        monkeypatch.setattr("sys.stdin", type("In", (), {"buffer": f}))
        assert run(spark, capsysbinary, "qscale") == "stdin: Illumina 1.5/Phred+64\n"
    assert cli.main(["grep", "a(", a]) == 1 and b"offset" in capsysbinary.readouterr().err
    assert cli.main(["uniq", "-v", a, b]) == 0 and capsysbinary.readouterr().err == b"3 reads\n"
    assert cli.main(["sample"]) == 1
    assert not [p for p in (Path(shared_dir(spark)) / "seqloom").glob("stdin-*")]  # spooled input goes when it is done with


def test_progress(spark, tmp_path, capsysbinary):
    (tmp_path / "p.fq").write_bytes(b"@r\nACGT\n+\nIIII\n" * 500)
    reads = read_fastq(spark, str(tmp_path / "p.fq"), split_bytes=800)
    with cli.progress(reads, every=100) as counted:
        assert counted.count() == 500
    lines = capsysbinary.readouterr().err.decode().splitlines()
    assert lines[-1] == "500 reads" and all(x.endswith(" reads") for x in lines)


def test_sample(spark, capsysbinary, files, tmp_path):
    a, b = files
    assert len(run(spark, capsysbinary, "sample", "-n", "1", a).splitlines()) == 4
    prefix, rest = str(tmp_path / "s"), str(tmp_path / "c")
    run(spark, capsysbinary, "sample", "-p", "0.5", "-o", prefix, "-c", rest, a, a)
    text = lambda p: b"".join(x.read_bytes() for x in sorted((tmp_path / p).glob("part-*")))
    assert text("s.1.fastq") == text("s.2.fastq") and text("c.1.fastq") == text("c.2.fastq")
    assert sorted([text("s.1.fastq"), text("c.1.fastq")]) == [b"@r10\nACGT\n+\nIIII\n", b"@r2\nTTAC\n+\n!!II\n"]
    assert cli.main(["sample", "-o", prefix, a]) == 0 and cli.main(["sample", "-o", prefix, a]) == 1
    assert cli.main(["sample", a, b]) == 1


def test_random_reads(spark):
    rows = random_reads(spark, 300, min_length=0, max_length=20).collect()
    assert all(len(r["seq"]) == len(r["qual"]) <= 20 and len(r["id1"]) == 50 for r in rows)
    assert {c for r in rows for c in r["seq"]} == set("ACGTN") and {c for r in rows for c in r["qual"]} <= set(map(chr, range(33, 97)))
    again = random_reads(spark.newSession(), 300, min_length=0, max_length=20).repartition(7).orderBy("rec_no").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in rows]


def test_operators_on_a_stream(spark, files, tmp_path):
    for name, make, mode in (("g", lambda s: grep.grep(s, "acg"), "append"), ("u", uniq.uniq, "complete"), ("k", lambda s: kmers(s, 2, dense=False), "complete"), ("q", quality.qual_table, "complete")):
        query = make(stream_fastq(spark, f"{tmp_path}/*.fq")).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert spark.table("g").count() == 2 and spark.table("k").agg({"frequency": "sum"}).first()[0] == 9 and spark.table("q").agg({"n": "sum"}).first()[0] == 12
    assert {r["seq"]: r["copies"] for r in spark.table("u").collect()} == {"ACGT": 2, "TTAC": 1}
