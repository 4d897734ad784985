"""Byte-level BPE against the tiktoken library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from seqloom.llm import bpe, queries


@pytest.fixture(scope="module")
def library(tokenizers_path):
    ranks = bpe.read_ranks(tokenizers_path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.TwoTierBpe(ranks, public_tokenizers.PATTERN)


CASES = ["", " ", "  a  b", "\n x", "x \n  y z ", " lead", "tab\tx  ", "日本語 テキスト 🙂🙂 é", "a" * 3000, "don't  it's 123 4567\n\n\nx", "x   y", "<|endoftext|> a", "\x00\x1f \x85  b", "a b   c"]


@pytest.mark.parametrize("text", CASES)
def test_encode(library, text):
    lib, own = library
    ids = np.frombuffer(own.encode_packed([text])[0], "<u4").tolist()
    assert ids == lib.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_memo_generations(library, monkeypatch):
    lib, own = library
    monkeypatch.setattr(bpe, "MEMO_WORDS", 5)
    for k in range(40):
        texts = [f"w{k} alpha beta w{k - 1} w{k + j} gamma" for j in range(4)]
        for t, p in zip(texts, own.encode_packed(texts)):
            assert np.frombuffer(p, "<u4").tolist() == lib.encode_ordinary(t)


def test_perfect_hash():
    keys = [b"k%d" % i for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.key_at.tolist()) == list(range(5000))
    assert h.probe(keys).tolist() == list(range(5000))
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"a"])
    assert bpe.PerfectHash([b"a"]).probe([b"zzz"]).tolist() == [0]


def test_merge_is_the_tiktoken_merge(library):
    lib, own = library
    r = np.random.default_rng(0)
    for _ in range(300):
        piece = bytes(r.choice(list(b"abcdethinors "), r.integers(1, 40)))
        assert own.merge(piece) == lib._core_bpe.encode_single_piece(piece) or own.ranks.get(piece) is not None


def test_query(spark, small, library):
    lib, _ = library
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op10_byte_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(lib.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_odd_documents(odd_docs, tokenizers_path, library):
    path, pattern = tokenizers_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode_documents(odd_docs, path, pattern)
    assert encoded.columns == odd_docs.columns
    rows = bpe.decode_documents(encoded, path, pattern).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r["ids"] == library[0].encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode_documents(odd_docs.limit(0), path, pattern).count() == 0
    assert rows[0].asDict().keys() >= set(odd_docs.columns)
    assert encoded.where(F.col("ids").isNull()).count() == 0
