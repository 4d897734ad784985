"""License scans: places against brute force, the join against all pairs of blocks and templates."""

import random
import re

from seqloom.llm import licenses, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    at = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in at}))


def joined(text, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    """Every run of every template."""
    words, best = licenses.words_of(text), {}
    for label, family, t, telling in templates:
        known, telling, span = set(licenses.words_of(t)), set(licenses.words_of(telling)), 2 * len(licenses.words_of(t))
        for k in range(max(1, len(words) - span + 1)):
            run = set(words[k : k + span])
            share = len(known & run) / len(known)
            if share >= (1 if len(known) < licenses.SHORT else threshold - 1e-12) and telling <= run:
                best[family] = max(best.get(family, (0, 0, "")), (share, len(known), label))
    return {label: share for share, _, label in best.values()}


def test_join_finds_every_block(monkeypatch):
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(30)]
    for k in range(300):
        monkeypatch.setattr(licenses, "SHORT", r.choice([0, 4]))
        words = [r.sample(vocabulary, r.randint(1, 8)) for _ in range(5)]
        templates = [(f"t{k}", f"f{r.randrange(4)}", " ".join(w), " ".join(r.sample(w, r.choice([0, 0, 1])))) for k, w in enumerate(words)]
        counts = {w.encode(): r.randint(0, 50) for w in vocabulary}
        threshold = r.choice([0.5, 0.7, 0.8, 1.0])
        index = licenses.TemplateIndex(templates, counts, threshold)
        text = "\n".join(" ".join(r.choice(vocabulary) for _ in range(r.choice([0, 3, 10, 200]))) for _ in range(4))
        assert index.scan(licenses.words_of(text)) == joined(text, templates, threshold)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op3_license_scan(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(texts[r["doc_id"]])
        met = joined(texts[r["doc_id"]])
        assert set(filter(None, r["labels"].split(","))) == met.keys() | set(filter(None, r["base_labels"].split(",")))
        assert r["score"] == (1.0 if r["n_base"] else max(met.values(), default=0.0))
    assert sum("cc-notice" in r["labels"] for r in rows) == sum("CC BY-NC" in (t or "") for t in texts.values())


def test_odd_documents(spark, odd_docs):
    rows = licenses.scan(odd_docs).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(texts[r["doc_id"]])
    assert licenses.scan(odd_docs.limit(0)).count() == 0
    far = spark.createDataFrame([(1, "MIT-License; the MIT\nlicense, GENERAL  public-LICENSE")], "doc_id bigint, text string")
    r = licenses.scan(far).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["score"]) == (8, 3, 0, 5, "gpl,mit", 1.0)


WRAPPED = [
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that", {"bsd-notice"}),
    ("This library is free software; you can redistribute it and/or modify it under the terms\nof the GNU Lesser General Public License", {"lgpl-notice", "gpl"}),
    ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", {"agpl-notice", "gpl"}),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby\ngranted, provided that the above copyright notice and this permission notice appear in all copies", {"isc-notice"}),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at", {"epl-notice"}),
    ("# SPDX-License-Identifier: X", {"spdx-notice"}),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa-notice"}),
    ("x\n# you can redistribute it and/or modify\n# it under the terms of the GNU General Public License\n", {"gpl-notice", "gpl"}),
    (" * Permission is hereby granted, free\n * of charge, to any person\n * obtaining a copy\n * of this software", {"mit-notice"}),
    ("mit " + "wort " * 30 + "\nlicensed under the\napache license, version 2.0", {"apache-notice", "apache"}),
]


def test_wrapped_notices(spark):
    rows = licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(WRAPPED)], "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: set(r["labels"].split(",")) for r in rows} == {k: want for k, (_, want) in enumerate(WRAPPED)}
    assert all(r["score"] == 1.0 for r in rows)


OTHERS = [
    ("Released under the Apache License", {"apache"}),
    ("the software is released under the terms of a license", set()),
    ("Licensed under the MIT License, Version 2.0", {"mit", "mit-notice"}),
    ("Released under the terms of the GNU Lesser License", set()),
    ("you may not use this file except with a pen", set()),
    ("Redistribution of wealth, with or without modification, is permitted and in use in all forms", set()),
    ("This work is licensed under a Creative License", set()),
    ("you can redistribute it and modify it under the terms of the Apache License", {"apache"}),
    ("permission to copy this software is free of charge to any person", set()),
    ("This form is subject to the terms of the Public License", set()),
    ("copyright law: all the rights", set()),
    ("Released under\n\n" + "word " * 40 + "the MIT License", set("mit".split())),
]


def test_whole_notices_are_told_apart(spark):
    """Every whole notice, also with a fifth of its words changed, has its own label and no relative's."""
    docs = []
    for label in ("agpl-notice", "apache-notice", "bsd-2-notice", "bsd-3-notice", "gpl-notice", "isc-notice", "lgpl-notice", "mit-notice", "mit-warranty", "unlicense-notice"):
        text = max((t for name, _, t, _ in licenses.TEMPLATES if name == label), key=len)
        words = text.split()
        docs += [(label, "x y z " * 50 + text + "\nwort" * 50)]
        docs += [(label, " ".join(w if k % 12 else f"{w}q" for k, w in enumerate(words)))]
    rows = licenses.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], "doc_id bigint, text string")).collect()
    for x in rows:
        own = {label for label in x["labels"].split(",") if label.endswith(("-notice", "-warranty"))}
        assert own == {docs[x["doc_id"]][0]}, (docs[x["doc_id"]], x)


def test_what_is_no_notice(spark):
    """One notice or phrase of each license that must not get another's label; here too the SQL gives the same."""
    import duckdb

    docs = [(k, t) for k, (t, _) in enumerate(OTHERS + WRAPPED)]
    rows = licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in rows} == {k: want for k, (_, want) in enumerate(OTHERS + WRAPPED)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    got = con.execute("SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score FROM (" + queries.oracle_sql()["op3_license_scan"] + ")").fetchall()
    assert sorted(got) == sorted(map(tuple, rows))
