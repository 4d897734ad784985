"""Command line: ``python -m seqloom.cli PROGRAM ...``. Results are folders of text files (``--out``), or go to standard
output where there is none; errors end with status 1."""

from __future__ import annotations

import argparse
import sys
import threading
import time
from contextlib import contextmanager, nullcontext

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import align, grep, kmers, quality, sampling, sorting, uniq
from seqloom.plans.deploy import ship
from seqloom.plans.shared import shared_path
from seqloom.schema import SAMPLE_READS, SAMPLE_SEED, SCALE_READS
from seqloom.sources.fastq import CHUNK_BYTES, read_fastq
from seqloom.sources.files import file_system, open_file
from seqloom.sources.sinks import fastq_text, write_lines

VERSION = "0.1"
#: Fixed value. Reads after which progress is printed.
PROGRESS_READS = 100_000


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqloom", description="Operators over FASTQ files.")
    top.add_argument("-V", "--version", action="version", version=VERSION)
    programs = top.add_subparsers(dest="program", required=True)

    def program(name: str, help_: str) -> argparse.ArgumentParser:
        p = programs.add_parser(name, help=help_)
        p.add_argument("--out", help="folder to write, instead of standard output")
        p.add_argument("--overwrite", action="store_true")
        return p

    p = program("grep", "reads that match a regular expression")
    p.add_argument("-i", "--id", action="store_true", help="match the identifier")
    p.add_argument("-v", "--invert-match", action="store_true")
    p.add_argument("-m", "--mismatches", help="folder for the reads that are not selected")
    p.add_argument("-c", "--count", action="store_true")
    p.add_argument("-a", "--trim-after", action="store_true")
    p.add_argument("-b", "--trim-before", action="store_true")
    p.add_argument("-t", "--trim-match", action="store_true")
    p.add_argument("pattern")
    p.add_argument("files", nargs="*", help="files, or - (or none) for standard input")
    p = program("kmers", "k-mer histogram")
    p.add_argument("-k", "--size", type=int, default=1)
    p.add_argument("files", nargs="*", help="files, or - (or none) for standard input")
    p = program("match", "local alignment scores")
    p.add_argument("query")
    p.add_argument("files", nargs="*", help="files, or - (or none) for standard input")
    p = program("uniq", "distinct sequences with counts")
    p.add_argument("-v", "--verbose", action="store_true", help="print how many reads are done, each 100,000 and at the end")
    p.add_argument("files", nargs="*", help="files, or - (or none) for standard input")
    p = program("qual", "quality counts by position")
    p.add_argument("files", nargs="*", help="files, or - (or none) for standard input")
    p = program("qualadj", "shifted qualities")
    p.add_argument("offset", type=int)
    p.add_argument("files", nargs="*", help="files, or - (or none) for standard input")
    p = program("qscale", "quality scale of each file")
    p.add_argument("files", nargs="*", help="files, or - (or none) for standard input")
    p = program("sort", "sorted reads")
    p.add_argument("-r", "--reverse", action="store_true")
    p.add_argument("-S", "--buffer-size", help="accepted; Spark sizes and spills its own buffers")
    p.add_argument("--temporary-directory", help="accepted; see spark.local.dir")
    p.add_argument("--seed", nargs="?", const="time", help="of -R; without a value, from the clock")
    for flags, by in (("-i --id", "id"), ("-n --idn", "natural"), ("-s --seq", "seq"), ("-R --random", "random"), ("-G --gc", "gc"), ("-M --mean-qual", "mean_qual")):
        p.add_argument(*flags.split(), dest="by", action="store_const", const=by)
    p.add_argument("files", nargs="*", help="files, or - (or none) for standard input")
    p = program("sample", "random reads of a file, or of two in lockstep")
    p.add_argument("-n", type=int, default=SAMPLE_READS)
    p.add_argument("-p", type=float, help="share of the reads")
    p.add_argument("-o", "--output", help="prefix of the folders to write: P.fastq, or P.1.fastq and P.2.fastq")
    p.add_argument("-c", "--complement-output", help="the same for the reads that are not drawn")
    p.add_argument("-r", "--with-replacement", action="store_true")
    p.add_argument("-s", "--seed", type=int, default=SAMPLE_SEED)
    p.add_argument("--method", choices=("hash", "mt"), help="by default mt, the exact generator, up to its bound, and hash beyond")
    p.add_argument("files", nargs="*", help="files, or - (or none) for standard input")
    return top


def emit(lines: DataFrame, out: str | None, overwrite: bool) -> None:
    """``value`` of each row, in order."""
    if out:
        write_lines(lines, out, overwrite)
    else:
        for row in lines.select("value").toLocalIterator():
            sys.stdout.buffer.write(row["value"].encode("latin-1") + b"\n")
        sys.stdout.flush()


def _readable(path: str) -> bool:
    try:
        with open_file(path):
            return True
    except OSError:
        return False


def spool(spark: SparkSession, stream) -> str:
    """Standard input as a file in the shared folder, copied in pieces; it can be read in splits and more than once."""
    path = shared_path(spark, "stdin")
    system, inner = file_system(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    with system.open_output_stream(inner) as f:
        while data := stream.read(CHUNK_BYTES):
            f.write(data)
    return path


def inputs_of(args, spark: SparkSession) -> tuple[list[str], dict[str, str]]:
    """Files to read, and how those are called that were spooled."""
    named, paths, spooled = args.files or ["-"], [], None
    for f in named:
        if f == "-":
            spooled = spooled or spool(spark, sys.stdin.buffer)
        paths.append(spooled if f == "-" else f)
    return paths, {} if spooled is None else {spooled: "stdin"}


def _sample(args, spark: SparkSession) -> None:
    if not 1 <= len(args.files) <= 2:
        raise ValueError("sample takes one file or two")
    inputs = [read_fastq(spark, f) for f in args.files]
    method = args.method or ("mt" if inputs[0].count() <= sampling.UNASKED and args.n <= sampling.GENERATOR_DRAWS else "hash")
    options = {"k": args.n, "fraction": args.p, "replacement": args.with_replacement, "seed": args.seed, "method": method}
    if len(inputs) == 2 and (a := inputs[0].count()) != (b := inputs[1].count()):
        raise ValueError(f"the inputs have different numbers of reads ({a} and {b})")
    taken, rest = sampling.sample_reads(inputs[0], **options)
    mates = sampling.sample_paired(*inputs, **options)[1] if len(inputs) == 2 else None
    for prefix, parts in ((args.output, [taken, mates]), (args.complement_output, [rest, inputs[1].join(rest.select("rec_no"), "rec_no", "left_semi") if mates is not None else None])):
        if prefix is None and parts[0] is not taken:
            continue
        for k, part in enumerate(p for p in parts if p is not None):
            name = None if prefix is None else f"{prefix}.fastq" if mates is None else f"{prefix}.{k + 1}.fastq"
            emit(fastq_text(part.orderBy("rec_no")), name, args.overwrite)


@contextmanager
def progress(reads: DataFrame, every: int = PROGRESS_READS):
    """The reads, counted as tasks end (a task that is run again counts again); each time ``every`` more are done their number is
    printed, and at the end that of all."""
    spark = reads.sparkSession
    done, ended, shown = spark.sparkContext.accumulator(0), threading.Event(), 0

    def count(batches):
        for b in batches:
            done.add(b.num_rows)
            yield b

    def show(last: bool = False) -> None:
        nonlocal shown
        if done.value // every > shown or last:
            shown = done.value // every
            print(f"{done.value} reads", file=sys.stderr, flush=True)

    def watch() -> None:
        while not ended.wait(0.2):
            show()

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield reads.mapInArrow(count, reads.schema)
    finally:
        ended.set()
        watcher.join()
        show(last=True)


def run(args, spark: SparkSession) -> None:
    ship(spark)
    if args.program == "sample":
        return _sample(args, spark)
    paths, names = inputs_of(args, spark)
    try:
        _run(args, spark, paths, names)
    finally:
        for spooled in names:
            system, inner = file_system(spooled)
            system.delete_file(inner)


def _run(args, spark: SparkSession, paths: list[str], names: dict[str, str]) -> None:
    # What passes reads on keeps the order of the partitions, which is that of files and records: nothing is sorted.
    records = (0, SCALE_READS if args.program == "qscale" else None)
    columns = {"kmers": ["seq"], "match": ["seq"], "uniq": ["seq"], "qual": ["qual"], "qscale": ["source_file", "rec_no", "qual"]}.get(args.program)
    reads = read_fastq(spark, paths, missing="error" if args.program == "sort" else "skip", records=records, file_no=True, columns=columns)

    def by_file(table: DataFrame) -> DataFrame:
        """``table`` (file_no, ...) for each file that can be read, in their order."""
        files = spark.createDataFrame([(k, names.get(p, p)) for k, p in enumerate(paths) if _readable(p)], "file_no int, file string")
        return files.join(table, "file_no", "left").orderBy("file_no")

    if args.program == "grep":
        on = "id" if args.id else "seq"
        numbered = reads.withColumn("source_file", F.col("file_no").cast("string"))
        if args.mismatches:
            rest = grep.grep_split(reads, args.pattern, on, args.invert_match)[1]
            write_lines(fastq_text(rest), args.mismatches, overwrite=True)
        if args.count:
            counts = grep.grep_count(numbered, args.pattern, on, args.invert_match).withColumn("file_no", F.col("source_file").cast("int"))
            lines = by_file(counts.drop("source_file")).select(F.coalesce("n", F.lit(0)).cast("string").alias("value"))
        else:
            lines = fastq_text(grep.grep(reads, args.pattern, on, args.invert_match, args.trim_before, args.trim_after, args.trim_match))
    elif args.program == "kmers":
        table = kmers.kmers(reads, args.size).orderBy("rank")
        head = spark.createDataFrame([("kmer\tfrequency",)], "value string")
        lines = head.union(table.select(F.concat_ws("\t", "kmer", F.col("frequency").cast("string"))))
    elif args.program == "match":
        lines = reads.select(F.concat_ws("\t", "seq", align.align_score("seq", args.query).cast("string")).alias("value"))
    elif args.program == "uniq":
        with progress(reads) if args.verbose else nullcontext(reads) as counted:
            emit(uniq.uniq_fasta(counted).orderBy("n"), args.out, args.overwrite)
        return
    elif args.program == "qual":
        lines = quality.qual_lines(reads).orderBy("qual")
    elif args.program == "qualadj":
        lines = fastq_text(quality.qual_adjust(reads, args.offset))
    elif args.program == "qscale":
        numbered = reads.withColumn("source_file", F.col("file_no").cast("string"))
        found = quality.detect_scale(numbered).withColumn("file_no", F.col("source_file").cast("int")).drop("source_file")
        named = by_file(found).select(F.col("file").alias("source_file"), F.coalesce("lo", F.lit(126)).alias("lo"), F.coalesce("hi", F.lit(33)).alias("hi"), "scale")
        lines = quality.scale_lines(named).select("value")  # no reads, no range
    else:
        seed = None if args.seed is None else time.time_ns() & 0xFFFFFFFF if args.seed == "time" else int(args.seed)
        lines = fastq_text(sorting.sort_reads(reads, args.by or "id", args.reverse, seed, exact=True))
    emit(lines, args.out, args.overwrite)


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("seqloom").getOrCreate()
    try:
        run(args, spark)
    except (ValueError, OSError, PySparkException) as e:
        print(f"seqloom {args.program}: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
