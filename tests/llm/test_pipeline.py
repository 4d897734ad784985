"""The pipeline against brute-force versions of its stages."""

from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import langid, quality, simhash
from seqloom.llm.common import shared_dir
from tests.llm.test_packing import check
from tests.llm.test_pii import brute
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_stages(spark, small, tokenizers_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], small).cache())
        if name != "packing":
            assert frames[-1].columns == docs.columns
    rows = [f.collect() for f in frames]
    ids = [{r["doc_id"] for r in x} for x in rows]
    assert ids[1] == {r["doc_id"] for r in langid.identify(docs).where(~F.col("rejected")).collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert ids[2] == {r["doc_id"] for r in quality.assess(frames[1], labels).where("kept").collect()}
    before = sorted(rows[2], key=lambda r: r["doc_id"])
    label = brute_components([brute_fingerprint(r["text"]) for r in before])
    assert ids[3] == {before[k]["doc_id"] for k in set(label)} and len(rows[3]) == len(ids[3])
    assert ids[4] == ids[3]
    for r in rows[4]:
        assert not brute(r["text"])
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizers_path("byte_bpe_50k.json"))
    check(rows[5], {r["doc_id"]: r["text"] for r in rows[4]}, library)
    assert {r["doc_id"] for r in rows[5]} == ids[4]


def test_odd_documents(spark, odd_docs, small):
    """Every stage takes nulls, odd texts, repeated rows, clashing columns and an empty table."""
    for docs in (odd_docs, odd_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            out.collect()
            if name != "packing":
                assert out.columns == docs.columns
    kept = simhash.drop_near_duplicates(odd_docs)
    assert sum(r["text"] == "the quick brown fox" for r in kept.collect()) == 1


def test_run(spark, small):
    """The result alone stays in the shared folder."""
    from pathlib import Path

    folder = Path(shared_dir(spark).removeprefix("file:")) / "seqloom"
    before = set(folder.iterdir()) if folder.exists() else set()
    assert corpus_pipeline.run(spark, small).count() > 0
    assert [p.name.partition("-")[0] for p in set(folder.iterdir()) - before] == ["packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_duplicates_move_texts_once(spark, small, odd_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = simhash.drop_near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
        head = plan[: plan.index("WindowGroupLimit")] if "WindowGroupLimit" in plan else plan
        assert "Exchange" not in head[: head.index("Window [")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    named = odd_docs.withColumnsRenamed({"score": "by_key", "r": "nth", "ids": "__0"})
    kept = simhash.drop_near_duplicates(named)
    assert kept.columns == named.columns and kept.count() == simhash.drop_near_duplicates(odd_docs).count()
