"""The five stages on the smallest given tables, each against what its operator says, and run() against the stages."""

import os
import re

import pytest

import corpus_pipeline
from prismill.llm import exact
from prismill.llm.queries import toxicity_model
from prismill.llm.toxicity import score_toxicity

from .test_similar import by_hand

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name == "toxicity":
            model = toxicity_model(spark, before, FOLDER)
            bad = {r["doc_id"] for r in score_toxicity(before, model, "doc_id", "text").where("predicted = 1").collect()}
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} - bad
        if name == "exact_dedup":
            bodies = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in docs.collect()]
            assert sorted(bodies) == sorted({re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in before.collect()})
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in exact.exact_copies(before, "doc_id", "text").where("kept").collect()}
        if name == "simhash_near_dedup":
            given = sorted((r["doc_id"], r["text"]) for r in before.collect())
            label = by_hand([t for _, t in given])
            assert {r["doc_id"] for r in docs.collect()} == {given[i][0] for i in set(label)} and len(set(label)) < len(given)
        if name != names[-1]:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        seen.append(docs.collect())
    mixed, packed = seen[-2], seen[-1]
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}
    assert sum(r["piece"] == 0 for r in packed) == len(mixed)
    whole = corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece", "length").collect()
    assert sorted(map(tuple, whole)) == sorted((r["doc_id"], r["piece"], r["length"]) for r in packed)
