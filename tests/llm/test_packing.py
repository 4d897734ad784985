"""Packing: reduction against exhaustive search, places, tokens of the library."""

import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from seqloom.llm import packing, queries


def spread(plan):
    """Every bin of a plan as a list of sizes."""
    return [[s for s, n in pattern for _ in range(n)] for pattern, times in plan for _ in range(times)]


def fewest(sizes, capacity):
    """Fewest bins, exhaustively."""

    @lru_cache(None)
    def go(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)

        def fill(i, room, out):
            nonlocal best
            best = min(best, 1 + go(out + rest[i:])) if i == len(rest) else best
            if i < len(rest):
                if rest[i] <= room:
                    fill(i + 1, room - rest[i], out)
                fill(i + 1, room, (*out, rest[i]))

        fill(0, capacity - first, ())
        return best

    return go(tuple(sorted(sizes, reverse=True)))


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 10, 20, 31])
    sizes = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
    counts = Counter(sizes)
    fixed = packing.reduce_instance(counts, capacity)
    bins = spread(fixed)
    assert all(sum(b) <= capacity for b in bins)
    assert Counter(s for b in bins for s in b) + counts == Counter(sizes)
    assert len(bins) + fewest(list(counts.elements()), capacity) == fewest(sizes, capacity)


@pytest.mark.parametrize("seed", range(20))
def test_plan_holds_every_piece(seed):
    r = random.Random(seed)
    capacity = 64
    counts = Counter({r.randint(1, capacity): r.randint(1, 400) for _ in range(r.randint(1, 40))})
    bins = spread(packing.plan_packing(counts, capacity))
    assert Counter(s for b in bins for s in b) == counts and all(0 < sum(b) <= capacity for b in bins)
    assert len(bins) <= len(spread(packing.best_fit(Counter(counts), capacity))) + 1
    table = packing.slot_table(packing.plan_packing(counts, capacity))
    assert Counter(dict(zip(table["length"].tolist(), table["length"].tolist()))).keys() == counts.keys()


def test_cut():
    assert packing.cut(0, 4) == [] and packing.cut(3, 4) == [(0, 3)] and packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def check(rows, texts, library, capacity=1024):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    for key, own in by_doc.items():
        ids = np.array(library.encode(texts[key] or "", add_special_tokens=False).ids + [2], "<u4")
        pieces = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own})
        assert sum(p[2] for p in pieces) == len(ids) and [p[0] for p in pieces] == list(range(len(pieces)))
        for piece, start, length, crc in pieces:
            assert crc == zlib.crc32(ids[start : start + length].tobytes()) and (piece == 0 or length == capacity)
    for own in by_bin.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.concatenate([[0], np.cumsum([r["length"] for r in own])[:-1]]).tolist()
        assert sum(r["length"] for r in own) <= capacity
    return len(by_bin)


@pytest.fixture(scope="module")
def library(tokenizers_path):
    return Tokenizer.from_file(tokenizers_path("byte_bpe_50k.json"))


def test_query(spark, small, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op7_best_fit_packing(spark, small).collect()
    bins = check(rows, texts, library)
    assert {r["doc_id"] for r in rows} == texts.keys()
    assert bins <= 1.01 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_odd_documents(spark, odd_docs, tokenizers_path, library):
    packer = packing.Packer(spark, tokenizers_path("byte_bpe_50k.json"))
    rows = packer.pack(odd_docs).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    check(rows, texts, library)
    assert sum(r["doc_id"] == 4 for r in rows) == 3
    assert packer.pack(odd_docs.limit(0)).count() == 0


def test_marks_and_full_pieces(spark, tokenizers_path, library):
    """Added tokens in texts; pieces that fill a sequence; many pieces of one length, in several runs."""
    texts = {k: "hello <|endoftext|> world <|endoftext|>" for k in range(5)} | {10: " a" * 1023, 11: " a" * 5000, 12: None}
    texts |= {k: " b" * 99 for k in range(100, 400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing, "RUN", 40)
        rows = packing.Packer(spark, tokenizers_path("byte_bpe_50k.json")).pack(docs).collect()
    assert check(rows, texts, library) == 1 + 4 + 30 + 1 and {r["doc_id"] for r in rows} == texts.keys()


def test_sequences(spark, tokenizers_path, library):
    docs = spark.createDataFrame([(1, "a b c " * 500), (2, "hello there"), (3, None)], "doc_id bigint, text string")
    packer = packing.Packer(spark, tokenizers_path("byte_bpe_50k.json"))
    packed = packer.pack(docs)
    found = {r["sequence_id"]: r["ids"] for r in packer.sequences(docs, packed).collect()}
    for r in packed.collect():
        ids = library.encode({1: "a b c " * 500, 2: "hello there", 3: ""}[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert found[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids[r["start"] : r["start"] + r["length"]]


def test_words_of_other_letters(library, tokenizers_path):
    with open(tokenizers_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = packing.FileTokenizer(f.read())
    mark = "<|endoftext|>"
    marked = (mark, f"{mark}{mark}", f"{mark} x", f"x{mark}y", f"a {mark}", f"hello {mark} world", f"  {mark}\n{mark} é日本 {mark}", "<|endoftext|", "<|ENDOFTEXT|>", f"x {mark}'s  ")
    assert own.encode_packed(["hello <|endoftext|> world"])[0] == np.array([31373, 220, 50256, 995], "<u4").tobytes()
    for text in (*marked, "日本語 テキスト 🙂 é", "  a\n\n b", "<|endoftext|> x", "Ωμέγα ñ   c", "it's  1st"):
        assert np.frombuffer(own.encode_packed([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
