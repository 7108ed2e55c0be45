import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dyadspark.llm import toxicity

DOCS = "doc_id long, text string, lang string"


def late_words(spark, n=5600):
    """Texts of which half are toxic; beyond the first 1500 toxic rows in hash order another word marks them."""
    rnd = random.Random(3)
    order = spark.range(n).where((F.col("id") % 2 == 1) & (toxicity.fold("id", 5) != 0)).orderBy(F.xxhash64("id"), "id").toPandas().id.tolist()
    first = set(order[:1500])
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice("ba na ko mi tu re".split()) for _ in range(3)) for _ in range(rnd.randrange(5, 40))]
        if i % 2:
            words.insert(rnd.randrange(len(words)), "vilest" if i in first else "zorgle")
        rows.append((i, " ".join(words), "aa"))
        labels.append((i, i % 2))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.mark.parametrize("whole_rows", [8192, 0])
def test_words_beyond_the_first_rows_are_learned(spark, whole_rows):
    docs, labels = late_words(spark)
    # at 5,600 rows one task trains; whole_rows=0 takes the way of larger tables
    model = toxicity.fit(docs, labels, **({} if whole_rows else {"whole_rows": 0}))
    out = toxicity.score(docs, model).where(toxicity.fold("doc_id", 5) == 0).toPandas()
    assert len(out) > 900
    assert np.mean((out.score >= 0.5) == (out.doc_id % 2 == 1)) > 0.95
    assert set(model.thresholds) == {None, "aa"}


def test_many_tasks_agree_with_reruns_and_read_long_texts(spark):
    docs, labels = late_words(spark, 2000)
    long_ = F.concat_ws(" ", F.lit("naba " * 5000), "text")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 40 < 2, long_).otherwise(F.col("text"))).repartition(7)
    given = toxicity.labelled(docs, labels)
    assert given.count() == labels.where(toxicity.fold("doc_id", 5) != 0).count()  # long ones too
    one = toxicity.fit(docs, labels, whole_rows=0)
    two = toxicity.fit(docs.repartition(3), labels, whole_rows=0)
    assert np.abs(one.embedding - two.embedding).max() < 1e-5 and abs(one.shift - two.shift) < 1e-2
    words = set(toxicity._vocabulary(given, 1 << 17).tolist())
    texts = [r.text for r in given.select("text").collect()]
    seen = Counter()
    for text in texts:
        seen.update(set(toxicity.word_hashes(*toxicity.as_bytes(pa.array([text])))[0].ravel().tolist()))
    assert words == {w for w, n in seen.items() if n > 1}
    for most in (1, 7, 40):  # the words of most texts, about as many as asked for
        few = toxicity._vocabulary(given, most).tolist()
        assert len(few) <= most + 20 and [seen[w] for w in few] == sorted((seen[w] for w in few), reverse=True)
        assert all(seen[w] <= min(seen[x] for x in few) for w in words - set(few)) or not few


def test_tasks_move_the_model_by_their_mean(spark):
    docs, labels = late_words(spark)
    given = toxicity.labelled(docs, labels)
    words = toxicity._vocabulary(given, 1 << 17)
    some = given.where("text NOT LIKE '%zorgle%'").orderBy("doc_id").limit(1500).toPandas()
    start = toxicity.train(some.text.tolist(), some.toxic.to_numpy(), some.lang.tolist(), words=words)
    start.shift = 0.0
    model = toxicity._refined(given.repartition(6, "doc_id"), start, 0.5, tasks=3)
    held = docs.where(toxicity.fold("doc_id", 5) == 0)
    hits = [np.mean((r.score >= 0.5) == (r.doc_id % 2 == 1)) for m in (start, model) for r in [toxicity.score(held, m).toPandas()]]
    assert hits[0] < 0.9 < 0.95 < hits[1]


def test_stage_keeps_clean_rows_after_many_tasks(spark):
    """What the pipeline's first stage does with a model of the way of larger tables."""
    docs, labels = late_words(spark)
    kept = {r.doc_id for r in toxicity.clean(docs, toxicity.fit(docs, labels, whole_rows=0)).select("doc_id").collect()}
    assert np.mean([i in kept for i in range(0, 5600, 2)]) > 0.95 and np.mean([i in kept for i in range(1, 5600, 2)]) < 0.05


def test_cut_offs_of_scores_that_reach_one(spark):
    docs, labels = late_words(spark, 2000)
    given = toxicity.labelled(docs, labels)
    some = given.toPandas()
    model = toxicity.train(some.text.tolist(), some.toxic.to_numpy(), some.lang.tolist())
    model.shift, model.thresholds, model.out, model.bias = 0.0, {}, model.out * 20, (model.bias + model.shift) * 20
    assert toxicity.score(docs, model).where("score = 1").count() > 100  # in 32 bits
    toxicity._set_cuts(model, given)
    # in the other fold toxic texts have a word that these never show
    seen = toxicity.flag(docs, model).where(toxicity.fold("doc_id", 5) != 0).toPandas()
    assert np.mean(seen.toxic == (seen.doc_id % 2 == 1)) > 0.95 and 0 < model.thresholds["aa"] < 1
