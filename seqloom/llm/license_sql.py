"""The license scan as SQL, comparing every block with every template; the check on the filtered join."""

from __future__ import annotations

from seqloom.llm.licenses import PHRASES, TEMPLATES, need_of, words_of

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(column: str) -> str:
    return f"regexp_extract_all(translate({column}, '{_UPPER}', '{_LOWER}'), '{_WORD}')"


def _places(phrase: str) -> str:
    """0-based places where the phrase's words stand in ``w``."""
    hit = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split()))
    return f"list_filter(range(len(w)), lambda i: {hit})"


def _list(words: set[bytes]) -> str:
    return "CAST([" + ", ".join(repr(w.decode()) for w in sorted(words)) + "] AS VARCHAR[])"


def license_scan_sql() -> str:
    """A template's best block begins at one of its words, so that only blocks from there on are compared."""
    templates = []
    for k, (label, family, text, telling) in enumerate(TEMPLATES):
        words = set(words_of(text))
        templates.append(f"({k}, '{label}', '{family}', {_list(words)}, {_list(set(words_of(telling)))}, {need_of(len(words))}, {2 * len(words_of(text))})")
    places = ", ".join(f"{_places(p)} AS p_{label}" for p, label in PHRASES)
    both = " || ".join(f"p_{label}" for _, label in PHRASES)
    labels = "[" + ", ".join(f"CASE WHEN len(p_{label}) > 0 THEN '{label}' END" for _, label in PHRASES) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, {_words("text")} AS w FROM d),
p AS (SELECT row, doc_id, len(w) AS n_words, {places} FROM w),
b AS (SELECT row, doc_id, n_words, {both} AS places, list_filter({labels}, lambda x: x IS NOT NULL) AS base FROM p),
t(t, label, family, words, telling, need, span) AS (VALUES {", ".join(templates)}),
c AS (SELECT row, w, t.* FROM (SELECT row, w, list_distinct(w) AS own FROM w), t WHERE len(list_intersect(own, words)) >= need AND len(list_intersect(own, telling)) = len(telling)),
s AS (SELECT row, label, family, words, telling, need, w[k + 1 : k + span] AS block FROM (SELECT *, unnest(range(len(w))) AS k FROM c) WHERE list_contains(words, w[k + 1])),
m AS (
    SELECT row, label, family, len(list_intersect(list_distinct(block), words)) AS shared, len(words) AS size, need FROM s
    WHERE len(list_intersect(list_distinct(block), telling)) = len(telling)
),
f AS (SELECT row, label, shared / size AS share FROM m WHERE shared >= need QUALIFY row_number() OVER (PARTITION BY row, family ORDER BY shared / size DESC, size DESC, label DESC) = 1),
g AS (SELECT row, list(DISTINCT label) AS met, max(share) AS best FROM f GROUP BY row)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
       CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base || coalesce(met, []))), ',') AS labels,
       CAST(CASE WHEN len(places) > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM b LEFT JOIN g USING (row)
"""
