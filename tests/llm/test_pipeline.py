"""The registered queries and the pipeline over whole small tables."""

import os
import re

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def test_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from plumbline.llm import decontamination, toxicity

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, FOLDER)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        before, kept = {r.doc_id: r.text or "" for r in kept.collect()}, spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id for r in kept.collect()}
        if name == "toxicity":
            scored = toxicity.toxicity(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
            assert after == {r.doc_id for r in scored.filter("predicted = 0").collect()}
        if name == "exact dedup":
            groups = {}
            for i, t in before.items():
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
            assert after == {min(g)[1] for g in groups.values()}
        if name == "n-gram Jaccard join":
            from test_operators import brute_components

            assert after == {i for i, _, c in brute_components(list(before.items()), 5, 80, 100) if i == c}
        if name == "benchmark decontamination":
            items = [decontamination.normalised(r.text.encode()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            held = {i for i, t in before.items() if any(x in decontamination.normalised(t.encode()) for x in items)}
            assert held <= set(before) - after and len(set(before) - after) <= len(held) + 1
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept.collect()}


def test_all_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if re.match(r"op\d+_", x)}


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and columns with the operators' own names."""
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = "x One two three four five six seven eight nine ten eleven twelve y"
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, base), (3, base), (4, base + " end"), (5, leak), (None, base), (None, None), (6, "long " * 50_000), (7, "a b")]
    docs = spark.createDataFrame([(i, t, "d", 1, 2, None) for i, t in rows], "doc_id long, text string, digest string, row int, node long, component_id long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    left = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    assert left == sorted([(1, ""), (3, base), (6, "long " * 50_000), (7, "a b")])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {1, 3, 6, 7}
