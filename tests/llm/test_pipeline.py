"""The pipeline's stages against what each must keep."""

import random

import corpus_pipeline
from docgraph.llm.common import stored


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and (ids is None or now <= ids)
        ids = now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in last.collect()} == ids
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} == ids


def test_hard_rows(spark, sf_dir):
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    base = text(120)
    rows = [(1, base), (2, base), (None, base), (None, text(90)), (3, None), (4, ""), (5, text(30_000)), (1, base)]
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, _q_kept int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "hard")
    assert sorted((x.doc_id for x in docs.collect()), key=repr) == sorted([1, None, 5], key=repr)
