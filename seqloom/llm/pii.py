"""Personal data: weak supervision in DataFrame and SQL functions only.

Candidate spans come from regular expressions. Five labelers vote on each (for, against or not at
all): the strict rule of the kind, a gazetteer, the words before it, its borders and its shape.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is;
the resulting probabilities train a logistic span classifier, which is applied as a SQL expression.
The strict (base) spans always stay; the classifier adds others that do not touch them.

What comes to the driver are the counts of vote patterns: at most kinds x 3^5 x lengths numbers, of
all candidates of the corpus. No Python runs on executors.
A text may hold any number of spans: running sums and maxima are taken over runs of RUN items, and no
array or text grows item by item, so that the work stays near linear in the spans of a text.
Defined results: a null or empty text has no spans; a null doc_id stays null; repeated rows are
searched alike; an empty table gives an empty result; other columns are ignored (or, by ``redact``, kept).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import stage_table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "name")
LABELERS = ("rule", "gazetteer", "context", "borders", "shape")
LENGTHS = (12, 18, 30)

#: The contract's patterns; every repetition is possessive and starts where a run starts, which finds the same leftmost
#: matches without trying each start within a run (``\\G``: where the match before ended).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: Runs of 12 to 19 digits; shorter and longer ones fail as a whole.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
#: A card number among other digits, for instance after a telephone number, where the contract's pattern fails as a whole.
DIGITS = r"(?<![0-9.+-])(?:[0-9]{12,19}+|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9.-])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
NATIONAL = r"(?<![0-9.-])(?:\+?[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"
SECRET = r"(?i)(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\x22']?[A-Za-z0-9+/_-]{8,}+"
NAME = r"(?<![A-Za-z])(?:Mrs?|Ms|Dr|Prof)\.? [A-Z][a-z]{1,30}+(?: [A-Z][a-z]{1,30}+)?"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Gazetteers, fixed values.
DOMAINS = "com|org|net|edu|gov|info|biz|io|de|fr|es|uk|eu|it|nl|at|ch"
GIVEN = "James|Mary|John|Anna|Peter|Maria|Paul|Laura|Thomas|Julia|Michael|Sarah|David|Emma|Daniel|Sophie|Carlos|Carmen|Hans|Claire|Pierre"
COUNTRY_CODES = "1|7|20|27|30|31|32|33|34|36|39|4[013-9]|5[1-8]|6[0-6]|81|82|84|86|9[0-58]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38"
CUES = "e-?mail|contact|write to|phone|tel|call|mobile|fax|ip|host|server|address|card|visa|payment|password|token|secret|login|user|name|dear|by"
COUNTER_CUES = "version|release|chapter|section|isbn|issn|order|page|figure|table|serial|part"


def _q(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _found(pattern: str, guard: str) -> tuple[str, str]:
    """SQL: the matches, leftmost and non-overlapping, and the pieces between them. Texts that fail the cheap guard are
    not searched."""
    p = _q(pattern)
    return f"IF({guard}, regexp_extract_all(text, {p}, 0), array())", f"IF({guard}, split(text, {p}, -1), array())"


#: Items of an array that are folded together.
RUN = 128
_SPAN = "array<struct<start:bigint,end:bigint,m:string,before:string,after:string>>"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for the value, which is computed once a row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _before(a: str, fold: str, zero: str) -> str:
    """SQL: for each item of the array named ``a`` the fold of all items before it; ``fold`` is over p and q."""
    step, run = f"(p, q) -> {fold}", f"CAST(i div {RUN} AS INT)"
    whole = f"transform(sequence(0, CAST((size({a}) - 1) div {RUN} AS INT)), i -> aggregate(slice({a}, i * {RUN} + 1, {RUN}), {zero}, {step}))"
    ahead = f"transform(runs, (u, i) -> aggregate(slice(runs, 1, i), {zero}, {step}))"
    return _let(whole, "runs", _let(ahead, "ahead", f"transform({a}, (u, i) -> aggregate(slice({a}, {run} * {RUN} + 1, i % {RUN}), element_at(ahead, {run} + 1), {step}))"))


def _positions(m: str, s: str) -> str:
    """SQL: structs (start, end, m, before, after) by code points; the lengths of the pieces give the positions."""
    rows = f"zip_with(zip_with({m}, slice({s}, 1, size({m})), (m, b) -> named_struct('m', m, 'b', b)), slice({s}, 2, size({m})), (x, c) -> named_struct('m', x.m, 'b', x.b, 'c', c))"
    span = "(x, a) -> named_struct('start', a + length(x.b), 'end', a + length(x.b) + length(x.m), 'm', x.m, 'before', right(x.b, 24), 'after', left(x.c, 1))"
    widths = "transform(rows, x -> CAST(length(x.b) + length(x.m) AS BIGINT))"
    found = _let(rows, "rows", _let(widths, "widths", f"zip_with(rows, {_before('widths', 'p + q', '0L')}, {span})"))
    return f"IF(size({m}) > 0, {found}, CAST(array() AS {_SPAN}))"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str) -> str:
    """Digits padded to 19: every second one from the right, an even place from the left, is doubled (its digits added)."""
    d = f"lpad({_digits(x)}, 19, '0')"
    terms = [f"CAST(substring({d}, {k}, 1) AS INT)" if k % 2 else f"CAST(translate(substring({d}, {k}, 1), '0123456789', '0246813579') AS INT)" for k in range(1, 20)]
    return f"({' + '.join(terms)}) % 10 = 0"


def _vote(yes: str, no: str = "false") -> str:
    return f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END"


#: name: (kind, pattern, guard, strict rule, gazetteer, shape), SQL over a match x. A strict rule of NULL never votes.
_DIGIT = "text RLIKE '[0-9]'"
_SOURCES = {
    "email": ("email", EMAIL, "contains(text, '@')", "true", f"lower(x.m) RLIKE '[.](?:{DOMAINS})$'", "length(regexp_extract(x.m, '^[^@]*', 0)) > 1"),
    "ip": ("ip", IP, _DIGIT, f"x.m RLIKE '^{OCTET}(?:[.]{OCTET}){{3}}$'", "x.m RLIKE '^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])[.]'", "NOT x.m RLIKE '^0*([0-9]+)[.]0*\\\\1[.]0*\\\\1[.]0*\\\\1$'"),
    "card": ("card", CARD, _DIGIT, _luhn("x.m"), f"x.m RLIKE '^(?:{ISSUERS})'", "NOT x.m RLIKE '^([0-9])(?:[ -]?\\\\1)+$'"),
    "digits": ("card", DIGITS, _DIGIT, _luhn("x.m"), f"x.m RLIKE '^(?:{ISSUERS})'", "NOT x.m RLIKE '^([0-9])\\\\1+$'"),
    "phone": ("phone", PHONE, "contains(text, '+')", f"length({_digits('x.m')}) BETWEEN 9 AND 15", f"{_digits('x.m')} RLIKE '^(?:{COUNTRY_CODES})'", "NOT x.m RLIKE '([0-9])(?:[^0-9]*\\\\1){6}'"),
    "national": ("phone", NATIONAL, _DIGIT, "NULL", f"{_digits('x.m')} RLIKE '^[2-9]'", "NOT x.m RLIKE '([0-9])(?:[^0-9]*\\\\1){6}'"),
    "secret": ("secret", SECRET, "text RLIKE '[=:]'", "NULL", "lower(x.m) RLIKE '^(?:password|passwd|token|secret|api)'", "x.m RLIKE '[=:].*[0-9]' AND x.m RLIKE '[=:].*[A-Za-z]'"),
    "name": ("name", NAME, "text RLIKE '[DMP]r'  OR contains(text, 'Ms')", "NULL", f"x.m RLIKE '(?:{GIVEN})'", "x.m RLIKE ' [A-Z][a-z]+ [A-Z]'"),
}


def candidates(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``found``: structs (start, kind number, end, the labelers' votes, whether the contract's pattern found it, length class), sorted."""
    out = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = []
    for name, (kind, pattern, guard, rule, gazetteer, shape) in _SOURCES.items():
        matches, pieces = _found(pattern, guard)
        out = out.withColumn(f"__m_{name}", F.expr(matches)).withColumn(f"__s_{name}", F.expr(pieces))
        strict = "0" if rule == "NULL" else _vote(rule, "true")
        context = _vote(f"lower(x.before) RLIKE '(?<![a-z])(?:{CUES})[^a-z0-9]*$'", f"lower(x.before) RLIKE '(?<![a-z])(?:{COUNTER_CUES})[^a-z0-9]*$'")
        borders = _vote("NOT x.before RLIKE '[A-Za-z0-9]$' AND NOT x.after RLIKE '[A-Za-z0-9]'", "true")
        size = "CASE " + " ".join(f"WHEN x.end - x.start <= {n} THEN {k}" for k, n in enumerate(LENGTHS)) + f" ELSE {len(LENGTHS)} END"
        fields = {"start": "x.start", "kind": str(KINDS.index(kind)), "end": "x.end", "rule": strict, "contract": str(name in BASE_KINDS).lower(), "gazetteer": _vote(gazetteer, "true"), "context": context, "borders": borders, "shape": _vote(shape, "true"), "size": size}
        struct = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        parts.append(f"transform({_positions(f'__m_{name}', f'__s_{name}')}, x -> {struct})")
    found = F.expr(f"sort_array(concat({', '.join(parts)}))")
    return out.select(*keep, found.alias("found"))


# ---------------------------------------------------------------- the label model, on the driver


def expectation_maximisation(rows: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> list[float]:
    """``rows``: votes and how often they occur. Returns the probability of each row that its spans are personal data."""
    names = range(len(LABELERS))
    p = [0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for v, _ in rows]
    for _ in range(rounds):
        total = sum(n for _, n in rows)
        prior = (sum(n * q for q, (_, n) in zip(p, rows)) + 1) / (total + 2)
        table = {}
        for side in (0, 1):
            mass = [n * (q if side else 1 - q) for q, (_, n) in zip(p, rows)]
            for k in names:
                for vote in (-1, 0, 1):
                    # One imagined span a vote, two on the side a labeler means: few spans cannot turn it round.
                    lean = 2.0 if vote == (1 if side else -1) else 1.0
                    table[side, k, vote] = (sum(m for m, (v, _) in zip(mass, rows) if v[k] == vote) + lean) / (sum(mass) + 4)
        new = []
        for v, _ in rows:
            z = math.log(prior / (1 - prior)) + sum(math.log(table[1, k, v[k]] / table[0, k, v[k]]) for k in names)
            new.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
        if max((abs(a - b) for a, b in zip(p, new)), default=0.0) < 1e-9:
            break
        p = new
    return p


def _features(kind: int, votes: tuple[int, ...], size: int) -> list[str]:
    return ["bias", f"kind{kind}", f"size{size}", *(f"{name}{v}" for name, v in zip(LABELERS, votes))]


def span_classifier(rows: list[tuple[int, tuple[int, ...], int, float]], soft: list[float], rounds: int = 400) -> dict[str, float]:
    """Logistic regression on kind, length class and votes; ``rows``: (kind, votes, size, count), ``soft``: their targets."""
    weights: dict[str, float] = {}
    square: dict[str, float] = {}
    total = sum(r[3] for r in rows) or 1
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for (kind, votes, size, n), y in zip(rows, soft):
            names = _features(kind, votes, size)
            z = sum(weights.get(f, 0.0) for f in names)
            g = (1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) - y) * n / total
            for f in names:
                slope[f] = slope.get(f, 0.0) + g
        for f, g in slope.items():
            g += 1e-4 * weights.get(f, 0.0)
            square[f] = square.get(f, 1e-12) + g * g
            weights[f] = weights.get(f, 0.0) - 0.3 * g / math.sqrt(square[f])
    return weights


def train(found: DataFrame) -> dict[str, float]:
    """Weights of the span classifier from the vote patterns of all candidates."""
    votes = [f"x.{name}" for name in LABELERS]
    counted = found.select(F.explode("found").alias("x")).groupBy("x.kind", *votes, "x.size").agg(F.count("*").alias("n"))
    rows = sorted((r["kind"], tuple(r[name] for name in LABELERS), r["size"], float(r["n"])) for r in counted.collect())
    by_votes: dict[tuple[int, ...], float] = {}
    for _, v, _, n in rows:
        by_votes[v] = by_votes.get(v, 0.0) + n
    patterns = sorted(by_votes.items())
    p = dict(zip((v for v, _ in patterns), expectation_maximisation(patterns)))
    return span_classifier(rows, [p[v] for _, v, _, _ in rows])


def _accepted(weights: dict[str, float]) -> str:
    """SQL over a candidate x: the classifier is for it, and it does not break the strict rule of its kind."""

    def chosen(field: str, stem: str, values) -> str:
        return f"CASE x.{field} " + " ".join(f"WHEN {v} THEN {weights.get(f'{stem}{v}', 0.0)!r}D" for v in values) + " ELSE 0.0D END"

    terms = [f"{weights.get('bias', 0.0)!r}D", chosen("kind", "kind", range(len(KINDS))), chosen("size", "size", range(len(LENGTHS) + 1))]
    terms += [chosen(name, name, (-1, 0, 1)) for name in LABELERS]
    return f"x.rule >= 0 AND ({' + '.join(terms)}) > 0"


_BASE = "x.rule = 1 AND x.contract"


def _apart(more: str, base: str) -> str:
    """SQL: the spans of ``more`` that share no character with one of ``base``, both sorted by start. Those of ``base`` that
    begin before a span ends come first; it is apart if none of them reaches beyond its start. One sorted array of ends
    and starts counts them, a running maximum tells how far they reach."""
    ends = "sort_array(concat(transform(more, (x, i) -> named_struct('at', x.end, 'side', 0, 'nth', i)), transform(base, (x, i) -> named_struct('at', x.start, 'side', 1, 'nth', i))))"
    own = f"filter(transform({ends}, (x, i) -> named_struct('side', x.side, 'nth', x.nth, 'i', i)), x -> x.side = 0)"
    counts = f"sort_array(transform({own}, (x, k) -> named_struct('nth', x.nth, 'n', x.i - k)))"
    reach = _let("concat(transform(base, x -> x.end), array(0L))", "stops", _before("stops", "greatest(p, q)", "-1L"))
    kept = _let(reach, "reach", f"filter(zip_with(more, {counts}, (x, y) -> IF(element_at(reach, y.n + 1) > x.start, NULL, x)), x -> x IS NOT NULL)")
    return _let(base, "base", _let(more, "more", f"IF(size(more) = 0 OR size(base) = 0, more, {kept})"))


def decide(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds ``base`` and ``spans``: structs (start, kind number, end), sorted."""
    slim = "x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end)"
    out = found.withColumn("base", F.expr(f"transform(filter(found, x -> {_BASE}), {slim})"))
    more = f"transform(filter(found, x -> NOT ({_BASE}) AND {_accepted(weights)}), {slim})"
    return out.withColumn("spans", F.expr(f"sort_array(concat(base, {_apart(more, f'transform(filter(found, x -> {_BASE}), {slim})')}))"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, ``base`` and ``spans``. The candidates are a small table in the shared folder; texts are
    read once."""
    found = stage_table(candidates(docs, ["doc_id"]), "spans")
    return decide(found, train(found)).select("doc_id", "base", "spans")


def redacted_text(text: str, spans: str) -> str:
    """SQL: the text with each span replaced by its kind in brackets; of overlapping spans the first gives the kind."""
    kinds = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    reach = _let("transform(spans, x -> x.end)", "stops", _before("stops", "greatest(p, q)", "0L"))
    shown = f"filter(zip_with(spans, {reach}, (x, a) -> named_struct('from', a, 'to', x.start, 'kind', x.kind)), x -> x.to >= x.from)"
    # A place in a text is found from its start: the text of a run is cut out first, then what is kept between its spans.
    cut = "substring({t}, CAST({a} + 1 AS INT), CAST({n} AS INT))"
    inner = cut.format(t="piece", a="x.from - run[0].from", n="x.to - x.from")
    piece = cut.format(t=text, a="run[0].from", n="element_at(run, -1).to - run[0].from")
    joined = _let(piece, "piece", f"array_join(transform(run, x -> concat({inner}, element_at({kinds}, x.kind + 1))), '')")
    runs = f"transform(sequence(0, CAST((size(shown) - 1) div {RUN} AS INT)), i -> {_let(f'slice(shown, i * {RUN} + 1, {RUN})', 'run', joined)})"
    done = _let(shown, "shown", f"concat(array_join({runs}, ''), substring({text}, CAST(array_max(transform(spans, x -> x.end)) + 1 AS INT)))")
    return f"IF(size({spans}) > 0, {_let(spans, 'spans', done)}, {text})"


def redact(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``; in ``text`` each span is replaced by its kind in brackets. Overlapping spans become one.
    Rows and their candidates are written to the shared folder, so that the expressions run once over the texts."""
    names = {c: f"__{k}" for k, c in enumerate(docs.columns)}
    own = docs.toDF(*names.values())
    text = names[next(c for c in docs.columns if c == "text")]
    found = stage_table(candidates(own, list(names.values()), text), "texts-spans")
    redacted = decide(found, train(found)).withColumn("__redacted", F.expr(redacted_text(text, "spans")))
    return redacted.select(*[F.col("__redacted" if alias == text else alias).alias(c) for c, alias in names.items()])
