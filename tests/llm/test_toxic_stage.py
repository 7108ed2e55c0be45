import dataclasses

import numpy as np

import corpus_pipeline
from dyadspark.llm import toxicity

DATA = "/root/testdata/sf0.001"


def test_stage_uses_the_cut_offs_of_languages(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = docs.select("doc_id", "lang").collect()
    monkeypatch.setattr(toxicity, "fit", lambda *_: model)
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, DATA).select("doc_id").collect()}
    for lang in {r.lang for r in rows}:
        own = [r.doc_id for r in rows if r.lang == lang]
        toxic, clean = [i for i in own if labels.get(i) == 1], [i for i in own if labels.get(i) == 0]
        assert not toxic or np.mean([i not in kept for i in toxic]) > 0.8, lang
        assert not clean or np.mean([i in kept for i in clean]) > 0.8, lang
    # one language loses all of its rows by its cut-off, the others keep all of theirs
    some = next(r.lang for r in rows if r.lang)
    strict = dataclasses.replace(model, thresholds={some: 0.0, None: 1.1})
    monkeypatch.setattr(toxicity, "fit", lambda *_: strict)
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, DATA).select("doc_id").collect()}
    assert kept == {r.doc_id for r in rows if r.lang != some}
