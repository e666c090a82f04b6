from __future__ import annotations

import corpus_pipeline
from mnemora.llm import registry

from . import test_decontaminate, test_jaccard, test_lines, test_packing, test_quality


def test_stages_by_brute_force(spark, sf_dir, documents, benchmark):
    """Each stage against a plain version of it, on what the stage before kept."""
    docs = documents
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    items = texts(benchmark.withColumnRenamed("item_id", "doc_id"))
    for name, stage in corpus_pipeline.STAGES:
        before = texts(docs)
        out = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        if name == "quality_rules":
            kept = {r["doc_id"] for r in registry.quality.verdicts(docs).filter("kept").collect()}
            assert {i for i, _ in texts(out)} == kept
            for i, t in texts(out):
                own = dict(before)[i].split("\n")
                assert set(t.split("\n")) <= {*own, ""} and test_quality.plain(t)[0] <= test_quality.plain(dict(before)[i])[0]
        elif name == "line_dedup":
            assert dict(texts(out)) == test_lines.plain(before, clauses=False)
        elif name == "ngram_jaccard":
            assert {i for i, _ in texts(out)} == {c for _, c in test_jaccard.plain(before, 5, 80).values()}
        elif name == "decontamination":
            assert {i for i, _ in texts(out)} == {i for i, t in before if not test_decontaminate.plain(t, items)[4]}
        else:
            assert test_packing.check(docs, dict(before)) > 0.9
            assert {r["doc_id"] for r in out.collect()} == {i for i, _ in before}
        if name != "packing":
            assert out.columns == documents.columns and out.filter("n_chars <> length(text)").count() == 0
            docs = out


def test_run_and_queries(spark, sf_dir, same):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for name, sql in registry.ORACLES.items():
        same(registry.QUERIES[name](spark, sf_dir), sql)
    names = "pii quality_rules jaccard_join lm_scoring packing secret_scan sharding line_dedup html_extraction decontamination fill_in_middle embedding_whitening nearest_neighbours".split()
    assert sorted(registry.QUERIES) == sorted([f"op{n}_" + x for n, x in enumerate(names, 1)])
