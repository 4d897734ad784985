"""License scans: an exact set-similarity join of text blocks with license templates.

A template's blocks are the runs, across lines, of twice its own number of words (a shorter text is
one block). A block meets the template if it holds at least THRESHOLD of the template's distinct
words - all of them, if these are under SHORT, as 4 of 5 everyday words tell no license - and among
them the words that a short template cannot do without. Wider blocks would gather a short template's words
from unrelated lines. Templates of one family of licenses share most of their words: a text has the label of
the one of which it holds the largest share, of equal shares the longer one.

The join works on windows, wide and near enough that every block of any template lies within one.
Words are ordered by their frequency in the whole corpus, rarest first. The prefix filter asks for a
shared word among the first ``|T| - need + 1`` of the template, the length filter for ``need``
template words in the window, the positional filter for enough words left after the first shared
one; in what passes all blocks are compared exactly. The templates are a parameter and small; the
corpus is never indexed.

Besides, the places of fixed phrases are counted (base labels).
Defined results: a null or empty text has no words, no labels and score 0; without documents the
result is empty; repeated rows are scanned alike; a null doc_id stays null; equal containments give one score;
texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import bound_batches

#: Share of a template's distinct words that a block has to hold; all of them are asked of templates with under SHORT.
THRESHOLD, SHORT = 0.8, 10
#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Public notices by label and family of licenses, with the words that short ones cannot do without. Of a family's notices
#: the one that is held best names a text: a longer one before a shorter one that it includes.
TEMPLATES = (
    ("agpl-notice", "gnu", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", ""),
    ("agpl-notice", "gnu", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "gnu affero public"),
    ("apache-notice", "apache", "Licensed under the Apache License, Version 2.0", "apache"),
    ("apache-notice", "apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "compliance license"),
    ("apache-notice", "apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ""),
    ("bsd-notice", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution source binary"),
    ("bsd-2-notice", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ""),
    ("bsd-3-notice", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ""),
    ("cc-notice", "cc", "Licensed under CC BY-NC 4.0", "cc"),
    ("cc-by-notice", "cc", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons"),
    ("cc-by-nc-notice", "cc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons noncommercial"),
    ("cc-by-sa-notice", "cc", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons sharealike"),
    ("cc-by-nd-notice", "cc", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "creative commons noderivatives"),
    ("cc0-notice", "cc", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work", "cc0 waived"),
    ("epl-notice", "epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License which is available at", "eclipse public"),
    ("gpl-notice", "gnu", "This work is licensed under the GNU General Public License, version 3", "gnu public"),
    ("gpl-notice", "gnu", "you can redistribute it and/or modify it under the terms of the GNU General Public License", "gnu public"),
    ("gpl-notice", "gnu", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu public"),
    ("gpl-notice", "gnu", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", ""),
    ("isc-notice", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "fee granted"),
    ("lgpl-notice", "gnu", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", ""),
    ("lgpl-notice", "gnu", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "gnu lesser public"),
    ("mit-notice", "mit", "Released under the MIT License", "mit"),
    ("mit-notice", "mit", "Licensed under the MIT License", "mit"),
    ("mit-notice", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "hereby granted copy"),
    ("mit-notice", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ""),
    ("mit-warranty", "warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ""),
    ("mpl-notice", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", "mozilla"),
    ("mpl-notice", "mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at", "mpl"),
    ("reserved-notice", "reserved", "Copyright All rights reserved", "rights reserved"),
    ("spdx-notice", "spdx", "SPDX License Identifier", "spdx"),
    ("unlicense-notice", "unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ""),
)
#: Bytes of words after A-Z are lower-cased: digits, a-z and all bytes of other characters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def phrase_starts(words: list[bytes], phrase: tuple[bytes, ...]) -> list[int]:
    out, at, n = [], -1, len(phrase)
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if tuple(words[at : at + n]) == phrase:
            out.append(at)


def need_of(distinct: int, threshold: float = THRESHOLD) -> int:
    """Distinct words that a block has to share with a template."""
    return distinct if distinct < SHORT else max(1, -int(-threshold * distinct // 1))


class TemplateIndex:
    """Inverted index of the templates' prefixes, words in order of corpus frequency."""

    def __init__(self, templates, counts: dict[bytes, int], threshold: float = THRESHOLD):
        sets = [((label, family), sorted(set(words_of(text))), frozenset(words_of(telling)), 2 * len(words_of(text))) for label, family, text, telling in templates]
        known = {w for _, ws, _, _ in sets for w in ws}
        self.place = {w: k for k, w in enumerate(sorted(known, key=lambda w: (counts.get(w, 0), w)))}
        self.known = frozenset(known)
        #: Every run of up to ``step`` words lies within one of the windows of twice that length, one every ``step`` words.
        self.step = max((span for *_, span in sets), default=1)
        self.templates, self.prefix = [], {}
        for label, ws, telling, span in sets:
            ordered = sorted(ws, key=self.place.__getitem__)
            need = need_of(len(ordered), threshold)
            t = len(self.templates)
            self.templates.append((label, ordered, frozenset(ordered), need, telling, span))
            for i, w in enumerate(ordered[: len(ordered) - need + 1]):
                self.prefix.setdefault(w, []).append((t, i))
        self.rare = frozenset(self.prefix)

    def candidates(self, window: list[bytes]) -> list[int]:
        """Templates that a block of the window may meet."""
        own = sorted(self.known.intersection(window), key=self.place.__getitem__)
        tried: set[int] = set()
        out = []
        for j, w in enumerate(own):
            for t, i in self.prefix.get(w, ()):
                if t in tried:
                    continue
                tried.add(t)  # w is the first word the two share: both are in the same order
                _, ordered, words, need, telling, _ = self.templates[t]
                if len(own) < need or 1 + min(len(ordered) - i - 1, len(own) - j - 1) < need:
                    continue
                if len(words.intersection(own)) >= need and telling.issubset(own):
                    out.append(t)
        return out

    def scan(self, words: list[bytes]) -> dict[str, float]:
        """Labels with their containments over all blocks of a text: of each family that of the template which is held best."""
        best: dict[str, tuple[float, int, str]] = {}
        if self.rare.isdisjoint(words):
            return {}
        for k in range(0, max(1, len(words) - self.step), self.step):
            window = words[k : k + 2 * self.step]
            if self.rare.isdisjoint(window):
                continue
            for t in self.candidates(window):
                (label, family), ordered, known, need, telling, span = self.templates[t]
                shared = widest(window, known, telling, span)
                if shared >= need:
                    best.setdefault(family, (-1.0, 0, ""))
                    best[family] = max(best[family], (shared / len(ordered), len(ordered), label))
        return {label: share for share, _, label in best.values()}


def widest(words: list[bytes], known: frozenset[bytes], telling: frozenset[bytes], span: int) -> int:
    """Most distinct ones of the ``known`` words in a run of ``span`` words that holds all ``telling`` ones."""
    at = [(i, w) for i, w in enumerate(words) if w in known]
    within: Counter = Counter()
    most = first = 0
    for i, w in at:
        within[w] += 1
        while i - at[first][0] >= span:
            gone = at[first][1]
            within[gone] -= 1
            if not within[gone]:
                del within[gone]
            first += 1
        if len(within) > most and telling <= within.keys():
            most = len(within)
    return most


def corpus_counts(docs: DataFrame, words: set[bytes], text: str = "text") -> dict[bytes, int]:
    """Occurrences of the given words in all texts: one row a word and task is shuffled."""
    bound_batches(docs.sparkSession)
    wanted = frozenset(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    total.update(filter(wanted.__contains__, words_of(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["word", "n"])

    rows = docs.select(text).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # len(words) rows
    return {bytes(r["word"]): r["n"] for r in rows}


_RESULT = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double>"


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (the best containment
    of a template, 1 where a phrase stands)."""
    vocabulary = {w for _, _, t, _ in templates for w in words_of(t)}
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates, corpus_counts(docs, vocabulary), threshold))
    split = [(tuple(words_of(p)), label) for p, label in phrases]

    @F.arrow_udf(_RESULT)
    def find(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            words = words_of(t)
            starts = [(at, label) for phrase, label in split for at in phrase_starts(words, phrase)]
            base = {label for _, label in starts}
            met = index.value.scan(words)
            at = [a for a, _ in starts]
            rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | met.keys())), 1.0 if at else max(met.values(), default=0.0)))
        cols = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select("doc_id", find("text").alias("r")).select("doc_id", "r.*")
