"""The pipeline stage by stage against plain versions, on the small tables and on edge cases."""

import corpus_pipeline
from runloom.llm import near_dedup
from runloom.plans.store import written

from .conftest import HARD
from .test_dedup import brute_components, brute_hits


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["classify", "cut_lines", "drop_near_duplicates", "drop_leaks", "tokenize"]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf), name)
        if name != "bpe_encoding":
            assert out.columns == docs.columns
        now = {r.doc_id: r for r in out.collect()}
        assert set(now) <= set(before)
        gone = set(before) - set(now)
        if name == "quality_classifier":
            good = {i for i, r in labels.items() if r.quality == 1 and r.toxic == 0}
            assert len(gone & good) <= 0.02 * len(good) and len(gone) > 5
        elif name == "line_dedup":
            assert all(r.n_chars == len(r.text) for r in now.values())
        elif name == "near_dedup":
            want = brute_components(list(before.items()), 80)
            assert set(now) == {i for i, (_, _, kept) in want.items() if kept}
        elif name == "decontamination":
            assert gone == {r[0] for r in brute_hits(list(before.items()), bench) if r[5]}
        else:
            assert set(now) == set(before) and all(r.n_tokens > 0 or not before[i] for i, r in now.items())
            break
        docs, before = out, {i: r.text for i, r in now.items()}


def test_stages_on_edge_cases(spark, sf, hard, empty):
    for docs in (hard, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, sf), name)
        corpus_pipeline.tokenize(spark, docs, sf).collect()
    assert {i for i, _ in HARD} >= {r.doc_id for r in near_dedup.dedup(hard).collect()}
