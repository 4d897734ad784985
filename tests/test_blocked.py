"""Blocked gzip: members, finding them, splits at every border, and the sink."""

import gzip
import io
import random

import pytest

from seqloom.sources import blocked, fastq, files, sinks


def packed(text: bytes, size: int) -> bytes:
    out = io.BytesIO()
    writer = blocked.BlockedWriter(out)
    for k in range(0, len(text), size):
        writer._pack(text[k : k + size])
    writer.close()
    return out.getvalue()


def records(n, seed=1):
    r = random.Random(seed)
    return b"".join(b"@r%d\n%s\n+\n@%s\n" % (k, b"ACGT" * (m := r.randint(0, 9)), b"+I@J" * m) for k in range(n))


def test_any_gzip_reader_unpacks_what_is_written():
    text = records(30_000)
    out = io.BytesIO()
    writer = blocked.BlockedWriter(out)
    for k in range(0, len(text), 12_345):
        writer.write(text[k : k + 12_345])
    noise = random.Random(2).randbytes(200_000)
    writer.write(noise)
    writer.close()
    data = out.getvalue()
    assert gzip.decompress(data) == text + noise and data.endswith(blocked.END)
    assert b"".join(t for _, t in blocked.members(io.BytesIO(data), 0)) == text + noise
    assert blocked.is_blocked(data) and not blocked.is_blocked(gzip.compress(text)) and not blocked.is_blocked(b"")


def test_members_are_found_from_any_byte():
    text = records(60) + blocked.MAGIC * 3
    data = packed(text, 200)
    places = [p for p, _ in blocked.members(io.BytesIO(data), 0)]
    for at in range(len(data)):
        want = min((p for p in places if p >= at), default=None)
        assert blocked.find_member(io.BytesIO(data), at, len(data)) == want
        if want is not None and want > at:
            assert blocked.find_member(io.BytesIO(data), at, want) is None


def test_what_is_no_member_is_told():
    with pytest.raises(blocked.NotBlocked):
        list(blocked.members(io.BytesIO(packed(b"x" * 50, 10) + gzip.compress(b"y" * 100)), 0))
    with pytest.raises(blocked.NotBlocked):
        list(blocked.members(io.BytesIO(packed(b"xyz" * 50, 1000)[:30]), 0))


@pytest.mark.parametrize("member", [7, 33, 200])
def test_every_border(spark, tmp_path, member):
    """Ranges of every length, so of every border, give the plain file's records once each, in order."""
    text = records(25) + b"@tail\nAC"
    data = packed(text, member)
    want = [(r["rec_no"], r["id1"], r["seq"], r["id2"], r["qual"]) for b in fastq.read_split(io.BytesIO(text), fastq.FastqSplit("x", 0, -1, 0)) for r in b.to_pylist()]
    assert len(want) == 25
    for size in [*range(1, 60), *range(60, len(data), 97)]:
        found, lines, broken = [], 0, False
        for start in range(0, len(data), size):
            split = fastq.FastqSplit("x", start, min(start + size, len(data)), lines, 0, "blocked", broken)
            for b in fastq.read_split(io.BytesIO(data), split):
                found += [(r["rec_no"], r["id1"], r["seq"], r["id2"], r["qual"]) for r in b.to_pylist()]
            own = b"".join(fastq._texts(io.BytesIO(data), split, 1 << 20)[0])
            lines += own.count(b"\n")
            broken = broken if not own else not own.endswith(b"\n")
        assert found == want, size


def test_split_job_over_a_blocked_file(spark, tmp_path):
    text = records(5000)
    (tmp_path / "a.gz").write_bytes(packed(text, 3000))
    (tmp_path / "a").write_bytes(text)
    one = fastq.read_fastq(spark, str(tmp_path / "a.gz"), split_bytes=5000)
    assert one.rdd.getNumPartitions() > 5
    rows = lambda df: [(r["rec_no"], r["id1"], r["seq"], r["qual"]) for r in df.collect()]
    assert rows(one) == rows(fastq.read_fastq(spark, str(tmp_path / "a")))


def test_a_file_that_is_blocked_only_at_first_is_one_partition(spark, tmp_path):
    text = records(3000)
    (tmp_path / "a.gz").write_bytes(packed(text[:60_000], 3000)[: -len(blocked.END)] + gzip.compress(text[60_000:]))
    df = fastq.read_fastq(spark, str(tmp_path / "a.gz"), split_bytes=2000)
    assert df.rdd.getNumPartitions() == 1 and df.count() == 3000


def test_blocked_sink(spark, tmp_path):
    (tmp_path / "a").write_bytes(text := records(2000))
    df = fastq.read_fastq(spark, str(tmp_path / "a"), split_bytes=10_000)
    sinks.write_fastq(df, str(tmp_path / "out"), blocked=True)
    names = files.list_files(str(tmp_path / "out"))
    assert len(names) > 1 and all(n.endswith(".gz") for n in names)
    assert b"".join(gzip.decompress(open(n, "rb").read()) for n in names) == text
    assert fastq.read_fastq(spark, names, split_bytes=1000).count() == 2000
