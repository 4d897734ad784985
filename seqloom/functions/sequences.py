"""Column functions over sequences, qualities and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gc_fraction(seq: Column | str) -> Column:
    """Share of G and C in either case; 0 for an empty sequence."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    share = F.length(F.regexp_replace(seq, "[^GCgc]", "")) / F.length(seq)
    return F.when(F.length(seq) == 0, F.lit(0.0)).otherwise(share).cast("float")


def mean_quality(qual: Column | str) -> Column:
    """Mean of the raw quality bytes; 0 for an empty string."""
    qual = F.col(qual) if isinstance(qual, str) else qual
    total = F.aggregate(F.transform(F.split(qual, ""), F.ascii), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(qual) == 0, F.lit(0.0)).otherwise(total / F.length(qual)).cast("float")


def shift_quality(qual: Column | str, offset: int) -> Column:
    """Each byte moved by ``offset`` and held within 0 to 126: one lookup a byte."""
    if not -128 <= offset <= 127:
        raise ValueError("the offset has to be within -128 to 127")
    qual = F.col(qual) if isinstance(qual, str) else qual
    source = "".join(map(chr, range(1, 256)))
    # Bytes from 128 on are negative to the command line's signed characters.
    target = "".join(chr(max(0, min(126, (b if b < 128 else b - 256) + offset))) for b in range(1, 256))
    if "\0" not in target:
        return F.translate(qual, source, target)
    # translate() reads NUL in the target as "delete": those bytes go through an unused character.
    held = F.translate(qual, source, target.replace("\0", "Ā"))
    return F.regexp_replace(held, "Ā", "\0")


_LARGEST = str(2**63 - 1)
#: A run of digits beyond the largest signed 64-bit number, once padded to 19 digits.
_BEYOND = "|".join(["[0-9]{20,}"] + [f"{_LARGEST[:k]}[{int(d) + 1}-9][0-9]{{{18 - k}}}" for k, d in enumerate(_LARGEST) if d != "9"])


def natural_key(text: Column | str) -> Column:
    """Orders digit runs by value and everything else by byte: each run is padded to 19 digits, runs beyond a signed
    64-bit number count as its largest value. Use with the length as a second key: of equal values the one with more
    leading zeros comes later."""
    text = F.col(text) if isinstance(text, str) else text
    padded = F.regexp_replace(text, "([0-9]+)", "0" * 19 + "$1")
    trimmed = F.regexp_replace(padded, "0*([0-9]{19,})(?![0-9])", "$1")
    return F.regexp_replace(trimmed, f"(?<![0-9])(?:{_BEYOND})(?![0-9])", _LARGEST)


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def packed_kmer(number: Column, k: int) -> Column:
    """The k-mer of a packed number, first base in the lowest bits."""
    return F.concat(*[F.substring(F.lit("ACGT"), (F.shiftright(number, 2 * i).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(k)])
