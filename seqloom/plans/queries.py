"""The registered queries over the reads, one or more for each operator, with the SQL that checks them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.hashing import RECORD_SEED, record_hash
from seqloom.functions.sequences import gc_fraction, mean_quality, reverse_complement
from seqloom.operators import align as alignment
from seqloom.operators import grep as selection
from seqloom.operators import quality, sampling, sorting, uniq
from seqloom.operators.kmers import kmers
from seqloom.operators.ranking import global_rank
from seqloom.plans.reads import READS_SQL, reads
from seqloom.plans.shared import shared_path
from seqloom.sources.fastq import read_fastq
from seqloom.sources.files import list_files
from seqloom.sources.sinks import fastq_text, write_fastq
from seqloom.sources.random_reads import random_reads_for

PATTERN, QUERY, K, SEED = "ac[gt]{2}a", "ACGTTGCAAC", 500, 4357
#: Bytes of a range in round trips; reads that the limited scale detection looks at.
SPLIT, FEW = 50_000, 40
#: Numbers of reads that the exact generator's draws are written down for.
SIZES = (1000, 10_000)
#: A group called again, and a match that is said to begin late, with what they amount to.
CALLS, CALLED, KEPT, KEPT_BEFORE = r"(?<b>[ac])g(?&b)", "[ac]g[ac]", r"gc\Kta", ("gc", "ta")


def _columns(df: DataFrame) -> DataFrame:
    return df.select("source_file", "rec_no", "id1", "seq", "id2", "qual")


def _grep(**options):
    return lambda spark, d: _columns(selection.grep(reads(spark, d), options.get("pattern", PATTERN), **{k: v for k, v in options.items() if k != "pattern"}))


def _sorted(by: str, reverse: bool = False):
    return lambda spark, d: sorting.sort_positions(reads(spark, d), by, reverse, columns=["rec_no"])


def _sample(part: int, **options):
    return lambda spark, d: sampling.sample_reads(reads(spark, d), **({"k": K, "seed": SEED} | options))[part].select("rec_no", "seq", "qual")


def _mates(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).withColumns({"seq": reverse_complement("seq"), "qual": F.reverse("qual")})


def _paired(spark: SparkSession, d: str) -> DataFrame:
    one, two = sampling.sample_paired(reads(spark, d), _mates(spark, d), k=K, seed=SEED)
    return one.select("rec_no", "seq").join(two.select("rec_no", F.col("seq").alias("mate_seq")), "rec_no")


def _replacement_total(spark: SparkSession, d: str) -> DataFrame:
    """Reads drawn with replacement, and all reads: those drawn at all and the rest."""
    taken, rest = sampling.sample_reads(reads(spark, d), k=K, seed=SEED, replacement=True)
    counted = taken.select(F.lit(1).alias("drawn"), "rec_no").unionByName(rest.select(F.lit(0).alias("drawn"), "rec_no"))
    by_read = counted.groupBy("rec_no").agg(F.sum("drawn").alias("times"))
    return by_read.agg(F.sum("times").alias("drawn"), F.count("*").alias("reads"))


def _written(spark: SparkSession, some: DataFrame, blocked: bool = False) -> list[str]:
    """Reads in their order as FASTQ files in the shared folder."""
    path = shared_path(spark, "written")
    write_fastq(some, path, blocked=blocked)
    return list_files(path)


def _roundtrip(blocked: bool = False):
    """Written by the sink and read by the source, files in many ranges; ids are the records' own."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        found = read_fastq(spark, _written(spark, reads(spark, d).orderBy("rec_no"), blocked), split_bytes=SPLIT // (8 if blocked else 1))
        return found.select("id1", "seq", "id2", "qual")

    return query


def _sorted_files(spark: SparkSession, d: str) -> DataFrame:
    """Sorted and written as blocked gzip; the place of each read in the files one after the other."""
    found = read_fastq(spark, _written(spark, sorting.sort_reads(reads(spark, d), "seq", reverse=True), True), split_bytes=SPLIT // 8, file_no=True, columns=["rec_no", "id1", "seq"])
    return global_rank(found, [F.asc("file_no"), F.asc("rec_no")], "place").select("id1", "seq", "place")


def _in_place(spark: SparkSession, d: str) -> DataFrame:
    """Written once; not written again; then replaced by what is read from it, sorted. The place of each read at the end."""
    path = shared_path(spark, "written")
    write_fastq(reads(spark, d), path)
    try:
        write_fastq(reads(spark, d), path)
        raise AssertionError("an existing folder was overwritten")
    except FileExistsError:
        pass
    found = read_fastq(spark, list_files(path), split_bytes=SPLIT)
    write_fastq(found.orderBy("seq", "id1"), path, overwrite=True)
    found = read_fastq(spark, list_files(path), split_bytes=SPLIT, file_no=True, columns=["rec_no", "id1", "seq"])
    return global_rank(found, [F.asc("file_no"), F.asc("rec_no")], "place").select("id1", "seq", "place")


def _first_of_files(spark: SparkSession, d: str) -> DataFrame:
    """The first reads of the first written file, of which no more is read."""
    files = _written(spark, reads(spark, d).orderBy("rec_no"))
    return read_fastq(spark, files[:1], split_bytes=SPLIT, records=(0, FEW), columns=["rec_no", "id1", "qual"])


def _file_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of each read in the concatenation of the written files, one of which is given twice."""
    files = _written(spark, reads(spark, d).orderBy("rec_no"))
    found = read_fastq(spark, [files[0], *files], split_bytes=SPLIT, file_no=True)
    placed = global_rank(found, [F.asc("file_no"), F.asc("rec_no")], "place")
    again = found.where("file_no = 0").count()
    return placed.where(F.col("place") >= again).select("id1", "seq", (F.col("place") - again).alias("place"))


def _varied(spark: SparkSession, d: str) -> DataFrame:
    """Reads of all scales and of none: one more byte for those of two files."""
    more = F.when(F.col("source_file") == "purchase.fastq", "J").when(F.col("source_file") == "view.fastq", "~").otherwise("")
    return reads(spark, d).withColumn("qual", F.concat("qual", more))


def queries() -> dict:
    out = {
        "scan_reads": lambda spark, d: reads(spark, d),
        "grep_seq": _grep(),
        "grep_id": _grep(pattern="7 CL", on="id"),
        "grep_invert": _grep(invert=True),
        "grep_trim_before": _grep(trim_before=True),
        "grep_trim_before_match": _grep(trim_before=True, trim_match=True),
        "grep_trim_after": _grep(trim_after=True),
        "grep_trim_after_match": _grep(trim_after=True, trim_match=True),
        "grep_mismatches": lambda spark, d: selection.grep_split(reads(spark, d), PATTERN)[1].select("rec_no"),
        "grep_count_by_file": lambda spark, d: selection.grep_count(reads(spark, d), PATTERN),
        "uniq_counts": lambda spark, d: uniq.uniq(reads(spark, d)),
        "uniq_fasta": lambda spark, d: uniq.uniq_fasta(reads(spark, d)),
        "qual_table": lambda spark, d: quality.qual_table(reads(spark, d)),
        "qual_table_dense": lambda spark, d: quality.qual_table(reads(spark, d), dense=True),
        "qual_lines": lambda spark, d: quality.qual_lines(reads(spark, d)),
        "qual_adjust_up": lambda spark, d: quality.qual_adjust(reads(spark, d), 31).select("rec_no", "qual"),
        "qual_adjust_down": lambda spark, d: quality.qual_adjust(reads(spark, d), -31).select("rec_no", "qual"),
        "detect_scale": lambda spark, d: quality.detect_scale(reads(spark, d), numbered=False),
        "scale_lines": lambda spark, d: quality.scale_lines(quality.detect_scale(reads(spark, d), numbered=False)),
        "gc_mean_qual": lambda spark, d: reads(spark, d).select("rec_no", gc_fraction("seq").alias("gc"), mean_quality("qual").alias("mean_qual")),
        "align_parity": lambda spark, d: reads(spark, d).select("rec_no", alignment.align_score("seq", QUERY).alias("score")),
        "align_textbook": lambda spark, d: reads(spark, d).select("rec_no", alignment.align_score("seq", QUERY, "textbook").alias("score")),
        "match_lines": lambda spark, d: reads(spark, d).select("rec_no", F.concat_ws("\t", "seq", alignment.align_score("seq", QUERY).cast("string")).alias("value")),
        "kmers_lines": lambda spark, d: kmers(reads(spark, d), 2).select("rank", F.concat_ws("\t", "kmer", F.col("frequency").cast("string")).alias("value")),
        "grep_count_invert": lambda spark, d: selection.grep_count(reads(spark, d), PATTERN, invert=True),
        "random_reads": lambda spark, d: random_reads_for(reads(spark, d), seed=SEED, min_length=20, max_length=60, id_length=12).drop("source_file"),
        "align_mat50": lambda spark, d: reads(spark, d).select("rec_no", alignment.align_score("seq", QUERY, "textbook", "mat50").alias("score")),
        "sample_replacement_total": _replacement_total,
        "pattern_calls": _grep(pattern=CALLS),
        "grep_keep": _grep(pattern=KEPT, trim_before=True),
        "record_hash": lambda spark, d: reads(spark, d).select("rec_no", record_hash().alias("hash")),
        "sample_hash": _sample(0),
        "sample_complement": _sample(1),
        "sample_fraction": _sample(0, fraction=0.1),
        "sample_mt": _sample(0, method="mt"),
        "sample_with_replacement": _sample(0, method="mt", replacement=True),
        "sample_with_replacement_hash": _sample(0, replacement=True),
        "sample_truncated_complement": lambda spark, d: sampling.truncated_complement(*sampling.sample_reads(reads(spark, d), k=K, seed=SEED)).select("rec_no"),
        "sample_paired": _paired,
        "shuffle_hash": _sorted("random"),
        "sort_reads_by_file": _file_order,
        "detect_scale_varied": lambda spark, d: quality.detect_scale(_varied(spark, d), numbered=False),
        "detect_scale_limit": lambda spark, d: quality.detect_scale(_varied(spark, d), limit=FEW, numbered=False),
        "concat_files": lambda spark, d: reads(spark, d).unionByName(_mates(spark, d)).groupBy("source_file").agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases")),
        "print_fastq": lambda spark, d: fastq_text(reads(spark, d)),
        "roundtrip_fastq": _roundtrip(),
        "roundtrip_fastq_gz": _roundtrip(blocked=True),
        "sort_reads": _sorted_files,
        "overwrite_in_place": _in_place,
        "shuffle_seed": lambda spark, d: sorting.sort_positions(reads(spark, d), "random", seed=7, columns=["rec_no"]),
        "scan_first_reads": _first_of_files,
    }
    for k in (1, 3):
        out[f"kmers_{k}"] = lambda spark, d, k=k: kmers(reads(spark, d), k)
    out["kmers_4_dense"] = lambda spark, d: kmers(reads(spark, d), 4, dense=True)
    out["kmers_9_sparse"] = lambda spark, d: kmers(reads(spark, d), 9, dense=False)
    out["kmers_16"] = lambda spark, d: kmers(reads(spark, d), 16)
    for by, name in (("id", "id"), ("natural", "idn"), ("seq", "seq"), ("gc", "gc"), ("mean_qual", "mean_qual")):
        out[f"sort_{name}"] = _sorted(by)
    out["sort_reverse"] = _sorted("seq", reverse=True)
    return out


# ---------------------------------------------------------------- the same in SQL

_WITH = f"WITH reads AS ({READS_SQL})\n"
_ALL = "source_file, rec_no, id1, seq, id2, qual"
_RE = PATTERN
_NATURAL = "array_to_string(list_transform(regexp_extract_all(id1, '[0-9]+|[^0-9]'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 19, '0') ELSE x END), '')"
_GC = "CAST(CASE WHEN length(seq) = 0 THEN 0 ELSE length(regexp_replace(seq, '[^GCgc]', '', 'g')) / length(seq) END AS FLOAT)"
_MEAN = "CAST(list_sum(list_transform(string_split(qual, ''), lambda x: ascii(x))) / length(qual) AS FLOAT)"


def _position(order: str) -> str:
    return f"{_WITH} SELECT rec_no, row_number() OVER (ORDER BY {order}, source_file, rec_no) - 1 AS position FROM reads"


def _trim(seq: str, qual: str) -> str:
    return f"{_WITH}, m AS (SELECT *, regexp_extract(seq, '(?i){_RE}') AS hit FROM reads WHERE regexp_matches(seq, '{_RE}', 'i')), p AS (SELECT *, instr(seq, hit) AS place FROM m) SELECT source_file, rec_no, id1, {seq} AS seq, id2, {qual} AS qual FROM p"


def _cut(part: str) -> tuple[str, str]:
    return part.format(c="seq"), part.format(c="qual")


def _kmers(k: int, dense: bool) -> str:
    digit = "+".join(f"(instr('ACGT', substr(kmer, {i + 1}, 1)) - 1) * CAST({4**i} AS BIGINT)" for i in range(k))
    letters = "||".join(f"substr('ACGT', CAST((rank // {4**i}) % 4 AS INT) + 1, 1)" for i in range(k))
    counted = f"{_WITH}, w AS (SELECT substr(upper(seq), CAST(i AS INT), {k}) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM reads WHERE length(seq) >= {k})), c AS (SELECT kmer, count(*) AS frequency, {digit} AS rank FROM w WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY kmer)"
    if not dense:
        return f"{counted} SELECT kmer, frequency, CAST(rank AS BIGINT) AS rank FROM c"
    return f"{counted}, every AS (SELECT range AS rank FROM range({4**k})), named AS (SELECT rank, {letters} AS kmer FROM every) SELECT n.kmer, coalesce(c.frequency, 0) AS frequency, n.rank FROM named n LEFT JOIN c ON c.rank = n.rank"


def _align(query: str, parity: bool, pair: str = "CASE WHEN substr(seq, i + 1, 1) = 'N' THEN 0 WHEN substr(seq, i + 1, 1) = y THEN 1 ELSE -2 END") -> str:
    """The recurrence as a recursive CTE: one step a read position, the gap along the query as a window maximum; ``pair`` is the score of
    the read's letter and the query's, y."""
    used = query[1:] if parity else query
    first = f"CASE WHEN substr(seq, 1, 1) = '{query[0]}' THEN 1 ELSE 0 END" if parity else "0"
    return f"""WITH RECURSIVE reads AS ({READS_SQL}),
q AS (SELECT i AS j, substr('{used}', CAST(i AS INT), 1) AS y FROM range(1, {len(used) + 1}) t(i)),
s AS (SELECT DISTINCT seq FROM reads),
dp AS (
    SELECT seq, 0 AS i, j, 0 AS h, -1000000 AS t FROM s, q
    UNION ALL
    SELECT seq, i, j, greatest(h0, coalesce(max(h0 + 3 * j) OVER (PARTITION BY seq ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 4 - 3 * (j - 1), 0)) AS h, t
    FROM (
        SELECT seq, i + 1 AS i, j, greatest(h - 4, t - 3) AS t,
               greatest(0, h - 4, t - 3, coalesce(lag(h) OVER (PARTITION BY seq ORDER BY j), 0) + {pair}) AS h0
        FROM dp JOIN q USING (j) WHERE i < length(seq)
    )
),
best AS (SELECT seq, max(h) AS h FROM dp GROUP BY seq)
SELECT rec_no, CAST(greatest(h, {first}) AS INT) AS score FROM reads JOIN best USING (seq)"""


def _matrix(name: str) -> str:
    cells = [f"WHEN '{x}{y}' THEN {alignment.MATRICES[name][i][j]}" for i, x in enumerate("ACGTN") for j, y in enumerate("ACGTN")]
    return f"CASE y || substr(seq, i + 1, 1) {' '.join(cells)} END"


def _random() -> str:
    draw = lambda salt, at, below: f"(CAST('0x' || substr(md5('{SEED}.{salt}.' || rec_no || '.' || {at}), 1, 7) AS BIGINT) % {below})"
    text = lambda n, letter: f"array_to_string(list_transform(range(1, {n} + 1), lambda i: {letter}), '')"
    base = f"CASE WHEN {draw('seq', 'i', 1000)} < 280 THEN 'A' WHEN {draw('seq', 'i', 1000)} < 490 THEN 'C' WHEN {draw('seq', 'i', 1000)} < 700 THEN 'G' WHEN {draw('seq', 'i', 1000)} < 900 THEN 'T' ELSE 'N' END"
    letter = lambda salt, below: f"chr(CAST(33 + {draw(salt, 'i', below)} AS INT))"
    return f"{_WITH}, n AS (SELECT rec_no, 20 + {draw('length', '0', 41)} AS n FROM reads) SELECT rec_no, {text('12', letter('id', 94))} AS id1, {text('n', base)} AS seq, '' AS id2, {text('n', letter('qual', 64))} AS qual FROM n"


def _record_hash() -> str:
    """The hash word by word and field by field: a step a table, as no expression can be named. Numbers stay below 2**64."""
    whole, number = 1 << 32, lambda x: f"CAST({x} AS UBIGINT)"
    turned = lambda x, by: f"(({x} * {number(1 << by)}) % {number(whole)} + {x} // {number(1 << (32 - by))})"
    times = lambda x, by: f"(({x} * {number(by)}) % {number(whole)})"
    scrambled = lambda words: f"list_transform(list_transform({words}, lambda k: {times('k', 0xCC9E2D51)}), lambda k: {times(turned('k', 15), 0x1B873593)})"
    letter = lambda c, at: f"coalesce(CAST(ascii(nullif(substr({c}, CAST({at} AS INT), 1), '')) AS UBIGINT), 0)"
    word = lambda c, w: "(" + " + ".join(f"{letter(c, f'4 * {w} + {j + 1}')} * {number(256**j)}" for j in range(4)) + ")"
    step = f"({turned('xor(h, k)', 13)} * 5 + {number(0xE6546B64)}) % {number(whole)}"
    tables, last = [f"h AS (SELECT *, {number(RECORD_SEED)} AS h FROM reads)"], "h"
    for c in ("id1", "seq", "id2", "qual"):
        words = f"list_transform(range(length({c}) // 4), lambda w: {word(c, 'w')})"
        rest = f"list_extract({scrambled(f'[{word(c, f"(length({c}) // 4)")}]')}, 1)"
        for k, value in enumerate((
            f"list_reduce(list_prepend(h, {scrambled(words)}), lambda h, k: {step})",
            f"xor(xor(h, {rest}), CAST(length({c}) AS UBIGINT))",
            times(f"xor(h, h // {number(1 << 16)})", 0x85EBCA6B),
            times(f"xor(h, h // {number(1 << 13)})", 0xC2B2AE35),
            f"xor(h, h // {number(1 << 16)})",
        )):
            tables.append(f"{c}_{k} AS (SELECT * EXCLUDE (h), {value} AS h FROM {last})")
            last = f"{c}_{k}"
    return f"{_WITH}, {', '.join(tables)} SELECT rec_no, CAST(h AS BIGINT) AS hash FROM {last}"


def _shuffled(n: int, replacement: bool) -> list[int]:
    """What the generator draws of ``n`` reads, number by number: a whole shuffle, or draws."""
    state = np.random.RandomState(SEED)

    def below(bound: int) -> int:
        while (x := int(state.randint(0, 2**32, dtype=np.uint32)) // (0xFFFFFFFF // bound)) >= bound:
            pass
        return x

    if replacement:
        return [below(n) for _ in range(min(K, n))]
    places = list(range(n))
    for i in range(n - 1, 0, -1):
        j = below(i + 1)
        places[i], places[j] = places[j], places[i]
    return places[:K]


def _generated(replacement: bool) -> str:
    """The numbers are written into the text for the sizes that the tables have."""
    lists = " ".join(f"WHEN {n} THEN {_shuffled(n, replacement)}" for n in SIZES)
    return f"{_WITH}, d AS (SELECT unnest(CASE count(*) {lists} END) AS rec_no FROM reads) SELECT rec_no, seq, qual FROM d JOIN reads USING (rec_no)"


def _shifted(offset: int) -> str:
    return f"{_WITH} SELECT rec_no, array_to_string(list_transform(string_split(qual, ''), lambda x: chr(CAST(greatest(0, least(126, ascii(x) + {offset})) AS INT))), '') AS qual FROM reads"


_QUAL = f"{_WITH}, l AS (SELECT qual, unnest(range(0, length(qual))) AS pos FROM reads), c AS (SELECT CAST(pos AS INT) AS pos, CAST(ascii(substr(qual, CAST(pos + 1 AS INT), 1)) AS INT) AS qual, count(*) AS n FROM l GROUP BY ALL)"
_DENSE = f"{_QUAL}, g AS (SELECT CAST(p.range AS INT) AS pos, CAST(b.range AS INT) AS qual FROM range((SELECT max(length(qual)) FROM reads)) p, range(255) b), d AS (SELECT g.pos, g.qual, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON c.pos = g.pos AND c.qual = g.qual)"
def _scale(limit: int = 100_000, more: str = "''") -> str:
    return f"""{_WITH}, v AS (SELECT source_file, rec_no, qual || {more} AS qual FROM reads), r AS (
    SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY rec_no) AS nth,
           list_min(list_transform(string_split(qual, ''), lambda x: ascii(x))) AS lo, list_max(list_transform(string_split(qual, ''), lambda x: ascii(x))) AS hi FROM v
), g AS (
    SELECT source_file, nth, least(126, min(lo) OVER w) AS lo, greatest(33, max(hi) OVER w) AS hi FROM r WHERE nth <= {limit}
    WINDOW w AS (PARTITION BY source_file ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), b AS (
    SELECT *, (CASE WHEN lo >= 33 AND hi <= 73 THEN 1 ELSE 0 END) + (CASE WHEN lo >= 33 AND hi <= 74 THEN 2 ELSE 0 END) + (CASE WHEN lo >= 66 AND hi <= 104 THEN 4 ELSE 0 END)
              + (CASE WHEN lo >= 64 AND hi <= 104 THEN 8 ELSE 0 END) + (CASE WHEN lo >= 59 AND hi <= 104 THEN 16 ELSE 0 END) AS bits FROM g
), k AS (
    SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY CASE WHEN bit_count(bits) <= 1 THEN 0 ELSE 1 END, CASE WHEN bit_count(bits) <= 1 THEN nth ELSE -nth END) AS pick FROM b
), f AS (
    SELECT source_file, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi,
           CASE WHEN bits & 1 > 0 THEN 'Sanger/Phred+33' WHEN bits & 2 > 0 THEN 'Illumina 1.8/Phred+33' WHEN bits & 4 > 0 THEN 'Illumina 1.5/Phred+64'
                WHEN bits & 8 > 0 THEN 'Illumina 1.3/Phred+64' WHEN bits & 16 > 0 THEN 'Solexa/Solexa+64' END AS scale FROM k WHERE pick = 1
)"""

_SCALE, _MORE = _scale(), "CASE source_file WHEN 'purchase.fastq' THEN 'J' WHEN 'view.fastq' THEN '~' ELSE '' END"
_RANKED = f"{_WITH}, k AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || rec_no), source_file, rec_no) AS nth FROM reads)"
_UNIQ = f"{_WITH}, u AS (SELECT seq, count(*) AS copies FROM reads GROUP BY seq)"
_MATE = "reverse(translate(seq, 'ACGT', 'TGCA'))"


def oracle_sql() -> dict[str, str]:
    hit = f"regexp_matches(seq, '{_RE}', 'i')"
    out = {
        "scan_reads": f"{_WITH} SELECT {_ALL} FROM reads",
        "grep_seq": f"{_WITH} SELECT {_ALL} FROM reads WHERE {hit}",
        "grep_id": f"{_WITH} SELECT {_ALL} FROM reads WHERE regexp_matches(id1, '7 CL', 'i')",
        "grep_invert": f"{_WITH} SELECT {_ALL} FROM reads WHERE NOT {hit}",
        "grep_trim_before": _trim(*_cut("substr({c}, place)")),
        "grep_trim_before_match": _trim(*_cut("substr({c}, place + length(hit))")),
        "grep_trim_after": _trim(*_cut("substr({c}, 1, place - 1 + length(hit))")),
        "grep_trim_after_match": _trim(*_cut("substr({c}, 1, place - 1)")),
        "grep_mismatches": f"{_WITH} SELECT rec_no FROM reads WHERE NOT {hit}",
        "grep_count_by_file": f"{_WITH} SELECT source_file, count(*) FILTER (WHERE {hit}) AS n FROM reads GROUP BY source_file",
        "uniq_counts": f"{_UNIQ} SELECT seq, copies FROM u",
        "uniq_fasta": f"{_UNIQ}, n AS (SELECT *, row_number() OVER (ORDER BY copies DESC, seq) - 1 AS n FROM u) SELECT n, '>unique-read-' || lpad(CAST(n AS VARCHAR), 7, '0') || ' (' || copies || ' copies)' || chr(10) || seq AS value FROM n",
        "qual_table": f"{_QUAL} SELECT pos, qual, n FROM c",
        "qual_table_dense": f"{_DENSE} SELECT pos, qual, n FROM d",
        "qual_lines": f"{_DENSE} SELECT qual, string_agg(CAST(n AS VARCHAR), chr(9) ORDER BY pos) AS value FROM d GROUP BY qual",
        "qual_adjust_up": _shifted(31),
        "qual_adjust_down": _shifted(-31),
        "detect_scale": f"{_SCALE} SELECT source_file, lo, hi, scale FROM f",
        "scale_lines": f"{_SCALE} SELECT source_file, source_file || ': ' || coalesce(scale, 'Unknown scale [''' || chr(lo) || ''', ''' || chr(hi) || ''']') AS value FROM f",
        "gc_mean_qual": f"{_WITH} SELECT rec_no, {_GC} AS gc, {_MEAN} AS mean_qual FROM reads",
        "align_parity": _align(QUERY, True),
        "align_textbook": _align(QUERY, False),
        "match_lines": f"{_align(QUERY, True).rpartition('SELECT rec_no,')[0]} SELECT rec_no, seq || chr(9) || greatest(h, CASE WHEN substr(seq, 1, 1) = '{QUERY[0]}' THEN 1 ELSE 0 END) AS value FROM reads JOIN best USING (seq)",
        "kmers_lines": f"SELECT rank, kmer || chr(9) || frequency AS value FROM ({_kmers(2, True)})",
        "grep_count_invert": f"{_WITH} SELECT source_file, count(*) FILTER (WHERE NOT {hit}) AS n FROM reads GROUP BY source_file",
        "sample_hash": f"{_RANKED} SELECT rec_no, seq, qual FROM k WHERE nth <= {K}",
        "sample_complement": f"{_RANKED} SELECT rec_no, seq, qual FROM k WHERE nth > {K}",
        "sample_fraction": f"{_RANKED} SELECT rec_no, seq, qual FROM k WHERE nth <= floor(0.1 * (SELECT count(*) FROM reads) + 0.5)",
        "sample_truncated_complement": f"{_RANKED} SELECT rec_no FROM k WHERE nth > {K} AND rec_no < (SELECT max(rec_no) FROM k WHERE nth <= {K})",
        "sample_paired": f"{_RANKED} SELECT rec_no, seq, {_MATE} AS mate_seq FROM k WHERE nth <= {K}",
        "shuffle_hash": _position(f"md5('{RECORD_SEED}' || chr(10) || id1 || chr(10) || seq || chr(10) || id2 || chr(10) || qual)"),
        "sort_reads_by_file": f"{_WITH} SELECT id1, seq, row_number() OVER (ORDER BY rec_no) - 1 AS place FROM reads",
        "detect_scale_varied": f"{_scale(more=_MORE)} SELECT source_file, lo, hi, scale FROM f",
        "detect_scale_limit": f"{_scale(FEW, _MORE)} SELECT source_file, lo, hi, scale FROM f",
        "concat_files": f"{_WITH} SELECT source_file, 2 * count(*) AS n, CAST(2 * sum(length(seq)) AS BIGINT) AS bases FROM reads GROUP BY source_file",
        "print_fastq": f"{_WITH} SELECT '@' || id1 || chr(10) || seq || chr(10) || '+' || id2 || chr(10) || qual AS value FROM reads",
        "roundtrip_fastq": f"{_WITH} SELECT id1, seq, id2, qual FROM reads",
        "random_reads": _random(),
        "record_hash": _record_hash(),
        "sample_mt": _generated(False),
        "sample_with_replacement": _generated(True),
        "align_mat50": _align(QUERY, False, _matrix("mat50")),
        "sample_replacement_total": f"{_WITH} SELECT CAST({K} AS BIGINT) AS drawn, count(*) AS reads FROM reads",
        "pattern_calls": f"{_WITH} SELECT {_ALL} FROM reads WHERE regexp_matches(seq, '{CALLED}', 'i')",
        "grep_keep": f"{_WITH}, m AS (SELECT *, instr(seq, regexp_extract(seq, '(?i){''.join(KEPT_BEFORE)}')) + {len(KEPT_BEFORE[0])} AS place FROM reads WHERE regexp_matches(seq, '{''.join(KEPT_BEFORE)}', 'i')) SELECT source_file, rec_no, id1, substr(seq, place) AS seq, id2, substr(qual, place) AS qual FROM m",
        "roundtrip_fastq_gz": f"{_WITH} SELECT id1, seq, id2, qual FROM reads",
        "sort_reads": f"{_WITH} SELECT id1, seq, row_number() OVER (ORDER BY seq DESC, source_file, rec_no) - 1 AS place FROM reads",
        "overwrite_in_place": f"{_WITH} SELECT id1, seq, row_number() OVER (ORDER BY seq, id1) - 1 AS place FROM reads",
        "shuffle_seed": _position("md5('7' || chr(10) || id1 || chr(10) || seq || chr(10) || id2 || chr(10) || qual)"),
        "scan_first_reads": f"{_WITH}, n AS (SELECT id1, qual, row_number() OVER (ORDER BY rec_no) - 1 AS rec_no FROM reads) SELECT rec_no, id1, qual FROM n WHERE rec_no < {FEW}",
        "kmers_1": _kmers(1, True),
        "kmers_3": _kmers(3, True),
        "kmers_4_dense": _kmers(4, True),
        "kmers_9_sparse": _kmers(9, False),
        "kmers_16": _kmers(16, False),
        "sort_id": _position("id1"),
        "sort_idn": _position(f"{_NATURAL}, length(id1)"),
        "sort_seq": _position("seq"),
        "sort_gc": _position(_GC),
        "sort_mean_qual": _position(_MEAN),
        "sort_reverse": _position("seq DESC"),
    }
    return out
