"""Constructs that Java lacks equal patterns written by hand."""

import re

import pytest

from seqloom.functions.patterns import UnsupportedPattern, java_pattern, translated
from seqloom.operators import grep
from tests.test_reads import make

SEQS = ["ACGT", "AACC", "CACA", "GATTACA", "AXA", "BXB", "AXB", "ABAB", "ABBA", "aabb", "A{2", "A.C", "NNN", "", "TTAGGG", "AGAG", "CC", "A1", "xyzzy", "ACACGT", "GCGC", "A\\K", "CTG", "foobar", "barfoo"]


def hits(spark, pattern):
    return [r["seq"] for r in grep.grep(make(spark, SEQS), pattern).orderBy("rec_no").collect()]


@pytest.mark.parametrize(
    "pattern, by_hand",
    [
        (r"(a|b)x(?1)", "(?:a|b)x(?:a|b)"),
        (r"(?<p>[ac]+)g(?&p)", "[ac]+g[ac]++"),
        (r"(?P<p>ac)(?P>p)", "acac"),
        (r"(ab)(?-1)", "abab"),
        (r"(?+1)(ab)", "abab"),
        (r"\g<1>(ca)|\g'1'", "caca|ca"),
        (r"(?|(a)x|(b)x)\1", "axa|bxb"),
        (r"(?|(ab)|(a)(b))\1", "abab|aba"),
        (r"(?|a(c)|g(c))\1*(?:a|g)", "acc*[ag]|gcc*[ag]"),
        (r"^(a)?(?(1)[bx].*|c.)$", "^(?:a[bx].*|c.)$"),
        (r"^(?<q>a)?(?(<q>)c|t)", "^(?:ac|t)"),
        (r"^(?(?=.t)g|c)a", "^(?:(?=.t)g|(?!.t)c)a"),
        (r"(?(?!a)c|a)g", "(?:c|a)g"),
        (r"(?(DEFINE)(?<x>ca))g(?&x)|a(?&x)$|(?&x)$", "ca$"),
        (r"(a)(b)\g{-1}\g{-2}", "abba"),
        (r"(.)(.)\g2\g1", "(.)(.)\\2\\1"),
        (r"(?P<n>a)x(?P=n)|\k<n>9", "axa"),
        (r"(?'n'a)b\k'n'", "aba"),
        (r"\Qa.c\E", r"a\.c"),
        (r"a{2", r"a\{2"),
        (r"a{,1}", "nothing"),
        (r"\x41\101", "aa"),
        (r"^\N+c$", "^.+c$"),
        (r"((a)c\2)(?1)?", "aca(?:aca)?"),
        (r"(?#note)ac(?#more)", "ac"),
        (r"(?i)AC(?-i:GT)", "ACGT"),
        (r"foo\Kbar", "foobar"),
    ],
)
def test_equals_what_is_written_by_hand(spark, pattern, by_hand):
    want = [s for s in SEQS if re.search(by_hand.replace("++", "+"), s, re.I)]
    assert hits(spark, pattern) == want
    assert want or by_hand in ("nothing",) or pattern.startswith("(?<p>")


@pytest.mark.parametrize("pattern, before, after, rest", [(r"ga\Kt", "TTACA", "GAT", "TACA"), (r"ga\Kt|zz", "TTACA", "GAT", "TACA"), (r"x\Ky|(t)\K\1", "TACA", "GATT", "ACA"), (r"a\Kt\Kt", "TACA", "GATT", "ACA"), (r"(?:ga)+\K", "TTACA", "GA", "TTACA")])
def test_the_match_begins_where_it_is_said_to(spark, pattern, before, after, rest):
    df = make(spark, ["GATTACA"], ["abcdefg"])
    cut = lambda **o: grep.grep(df, pattern, **o).first()
    assert cut(trim_before=True)["seq"] == before and len(cut(trim_before=True)["qual"]) == len(before)
    assert cut(trim_after=True)["seq"] == after
    assert cut(trim_before=True, trim_match=True)["seq"] == rest
    assert cut(trim_after=True, trim_match=True)["seq"] == "GATTACA"[: 7 - len(before)]


def test_what_java_has_is_left_as_it_is(spark):
    for p in ("a", "a|b", "(a(b))", "(?:a)*?b+", "^a.{2,3}+$", "[a-c]", r"\d\w\b", "(?=a)(?!b)(?<=c)(?<!d)(?>e)"):
        assert java_pattern(p) == "(?id)" + p
    assert translated(r"a\Kb").keeps == (1,) and translated("a(b)").keeps == ()


@pytest.mark.parametrize("pattern", ["(", ")", "(?<a", "(?(x)", "(?(1)a|b|c)(d)", "a\\", "(?Zx)", "(?P<n>a"])
def test_errors_name_their_place(spark, pattern):
    with pytest.raises(UnsupportedPattern, match="offset"):
        java_pattern(pattern)
