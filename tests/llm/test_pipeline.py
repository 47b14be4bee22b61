"""The pipeline's stages: what goes, what stays, and that each reads what the one before it kept."""

import sys

import corpus_pipeline
from theoremill.llm import decontam, neardup, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_dedup", "benchmark_decontamination", "pii_surrogates", "pack_sequences"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    before = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).checkpoint()
        assert after.columns == COLUMNS and after.dtypes == docs.dtypes, name
        kept.append({r["doc_id"]: r["text"] for r in after.collect()})
        before = after
    quality, unique, clean, private = kept
    all_docs = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in quality for i in good) / len(good) > 0.97
    assert set(quality) < set(all_docs) and all(quality[i] == all_docs[i] for i in quality)
    groups = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(quality.items()), "doc_id long, text string"), 5, 80).collect()}
    assert set(unique) == set(groups.values())
    leaked = {r["doc_id"] for r in decontam.leaks(docs, bench).collect()}
    assert set(clean) == set(unique) - leaked
    assert set(private) == set(clean) and all(not pii.find_entities(t) or private[i] != t for i, t in clean.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == set(private)


def test_run_gives_the_stages_rows(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 0


def test_stages_on_odd_and_empty_rows(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == odd_docs.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count()


def test_nothing_swallows_imports():
    assert "theoremill.llm" in sys.modules
