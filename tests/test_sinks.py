"""What is written appears at once, and what was there stays until then."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from seqloom import cli
from seqloom.sources import fastq, files, sinks

DATA = b"@b\nACGT\n+\nIIII\n@a\nTTAC\n+\n!!II\n"


@pytest.fixture
def reads(spark, tmp_path):
    (tmp_path / "in").write_bytes(DATA)
    return fastq.read_fastq(spark, str(tmp_path / "in"))


def ids(spark, folder):
    return [r["id1"] for r in fastq.read_fastq(spark, files.list_files(str(folder))).collect()]


def failing(reads):
    return reads.withColumn("seq", F.when(F.col("id1") == "a", F.raise_error(F.lit("no"))).otherwise(F.col("seq")))


def test_a_failing_job_keeps_the_old_rows(spark, reads, tmp_path):
    out = tmp_path / "out"
    sinks.write_fastq(reads, str(out))
    with pytest.raises(Exception, match="no"):
        sinks.write_fastq(failing(reads), str(out), overwrite=True)
    assert ids(spark, out) == ["b", "a"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in", "out"]


def test_a_failing_job_leaves_no_new_folder(reads, tmp_path):
    with pytest.raises(Exception, match="no"):
        sinks.write_fastq(failing(reads), str(tmp_path / "out"))
    assert [p.name for p in tmp_path.iterdir()] == ["in"]
    with pytest.raises(Exception, match="no"):
        sinks.write_tsv(failing(reads), str(tmp_path / "out"))
    assert [p.name for p in tmp_path.iterdir()] == ["in"]


def test_a_folder_is_overwritten_by_what_is_read_from_it(spark, reads, tmp_path):
    out = str(tmp_path / "out")
    sinks.write_fastq(reads, out)
    for _ in range(2):
        sinks.write_fastq(fastq.read_fastq(spark, files.list_files(out)).orderBy("id1").coalesce(1), out, overwrite=True)
        assert ids(spark, out) == ["a", "b"]


def test_sorting_in_place_on_the_command_line(spark, capsysbinary, reads, tmp_path):
    out = str(tmp_path / "o")
    assert cli.main(["sort", str(tmp_path / "in"), "--out", out]) == 0
    assert cli.main(["sort", "-r", *files.list_files(out), "--out", out]) == 1  # exists
    assert cli.main(["sort", "-r", *files.list_files(out), "--out", out, "--overwrite"]) == 0
    assert ids(spark, out) == ["b", "a"]


def test_two_writers_cannot_both_win(spark, reads, tmp_path):
    out, ended = str(tmp_path / "out"), []

    def write():
        try:
            sinks.write_fastq(reads, out)
            ended.append("won")
        except FileExistsError:
            ended.append("gave way")
        except Exception as e:
            ended.append(repr(e))

    threads = [threading.Thread(target=write) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert ended.count("won") == 1 and ids(spark, out) == ["b", "a"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in", "out"]


def test_a_claim_keeps_others_out(reads, tmp_path):
    out = str(tmp_path / "out")
    with sinks._claimed(out):
        with pytest.raises(FileExistsError, match="being written"):
            sinks.write_fastq(reads, out, overwrite=True)
    sinks.write_fastq(reads, out)


def test_files_of_lost_attempts_are_dropped(tmp_path):
    """Only files of the attempts that Spark commits stay."""
    writer = sinks.LineWriter(str(tmp_path / "s"), False)
    os.makedirs(tmp_path / "s")
    for name in ("part-00000-x", "part-00000-y"):
        (tmp_path / "s" / name).write_bytes(b"x\n")
    writer.commit([sinks._Written("part-00000-y"), None])
    assert [p.name for p in (tmp_path / "s").iterdir()] == ["part-00000-y"]
    writer.abort([])
    assert not (tmp_path / "s").exists()


def test_tables_are_overwritten_at_the_end(spark, tmp_path):
    path = str(tmp_path / "t")
    for text in ("x", "y"):
        sinks.write_tsv(spark.createDataFrame([(text,)], "a string"), path, overwrite=True)
    assert [r["a"] for r in spark.read.option("sep", "\t").option("header", True).csv(path).collect()] == ["y"]
    with pytest.raises(FileExistsError):
        sinks.write_tsv(spark.range(1), path)
