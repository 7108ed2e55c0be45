"""Toxicity, language and quality models."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadspark.llm import language, ngram_quality, toxicity
from dyadspark.llm._common import as_bytes

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])


def corpus(n=700, seed=0):
    rnd = random.Random(seed)
    langs = {"aa": "ba na ko mi tu re".split(), "bb": "schl eit ung ör ß gen".split(), "cc": "пр ив ет ом да ть".split()}
    rows, toxic = [], {}
    for i in range(n):
        lang = rnd.choice(list(langs))
        words = ["".join(rnd.choice(langs[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(5, 60))]
        toxic[i] = int(rnd.random() < 0.3)
        if toxic[i]:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(["vilest", "rotter", "vile-dog"]) + rnd.choice(["", ",", "!"]))
        rows.append((i, " ".join(words), lang))
    return rows, toxic


def test_toxicity_held_out(spark):
    rows, toxic = corpus()
    docs = spark.createDataFrame(rows + [(None, None, None), (9001, "", "aa"), (9002, "12 34", "zz"), (9003, "word " * 30000, None)], DOC)
    labels = spark.createDataFrame([(i, y) for i, y in toxic.items()] + [(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).withColumn("held", toxicity.fold("doc_id", 5) == 0).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held and r.doc_id in toxic]
    assert len(held) > 80
    assert sum((r.score >= 0.5) == bool(toxic[r.doc_id]) for r in held) / len(held) > 0.95
    flagged = toxicity.flag(docs.withColumn("score", F.lit("x")), model)
    assert flagged.columns == ["doc_id", "text", "lang", "score", "toxicity", "toxic"]
    assert flagged.count() == len(out)
    # a label of the held-out fold changes nothing
    other = labels.withColumn("toxic", F.when(toxicity.fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, other)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in out)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame(corpus(20)[0], DOC)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_language_held_out(spark):
    rows, _ = corpus()
    extra = [(None, None, None), (9001, "", "aa"), (9002, "12 34 !?", "aa"), (9003, "ba na " * 20000, None), (9004, "日本", None), (9005, "５", None)]
    docs = spark.createDataFrame(rows + extra, DOC)
    model = language.fit(docs, toxicity.fold("doc_id", 3) != 1)
    out = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert len(out) == len(rows) + len(extra)
    right = [out[i].lang_pred == lang for i, _, lang in rows]
    assert np.mean(right) > 0.97
    assert [out[i].lang_pred for i in (None, 9001, 9002, 9005)] == ["und"] * 4 and out[9001].score == 0
    assert out[9003].lang_pred == "aa" and out[9004].lang_pred in {"aa", "bb", "cc"}
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_does_not_depend_on_neighbours():
    rows, _ = corpus(200)
    model = language.train([t for _, t, _ in rows], [x for _, _, x in rows])
    texts = [t for _, t, _ in rows] + ["a", "", "ba", "é"]
    data, offsets = as_bytes(pa.array(texts))
    lang, score = model.predict(data, offsets)
    for i in (0, 5, 200, 201, 202, 203):
        one = model.predict(*as_bytes(pa.array([texts[i]])))
        assert one[0][0] == lang[i] and abs(one[1][0] - score[i]) < 1e-5


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], DOC)
    model = language.fit(docs, F.lit(True))
    assert [r.lang_pred for r in language.identify(docs, model).collect()] == ["und"]


def plain_kneser_ney(texts, order):
    """Function from bytes before and a byte to its probability, from plain dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        raw = [0xFF] * (order - 1) + list(t.encode())
        for i in range(order - 1, len(raw)):
            counts[order][tuple(raw[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts = {}
    heads = {n: defaultdict(list) for n in counts}
    for n, c in counts.items():
        of = Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        discounts[n] = [min(max(k + 1 - (k + 2) * y * of[k + 2] / of[k + 1] if of[k + 1] else 0, 0), k + 1) for k in range(3)]
        for g, v in c.items():
            heads[n][g[:-1]].append(v)

    def p(gram, n=None):
        n = n or order
        g = gram[-n:]
        low = 1 / 256 if n == 1 else p(gram, n - 1)
        own = heads[n].get(g[:-1])
        if not own:
            return low
        c, d = counts[n].get(g, 0), discounts[n]
        return (c - (d[min(c, 3) - 1] if c else 0)) / sum(own) + sum(d[min(v, 3) - 1] for v in own) / sum(own) * low

    return p


def test_perplexity_against_brute_force(spark):
    rows, _ = corpus(60)
    rows += [(9001, "", "aa"), (9002, None, "aa"), (9003, "x", None), (9004, "@@## éß", "aa")]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    good = {i for i, _, _ in rows if i % 3 == 0}
    ids = spark.createDataFrame([(i, "x") for i in good] + [(None, "y")], "doc_id long, text string")
    for order, options in ((4, {"order": 4}), (6, {}), (6, {"block_bytes": 700, "most_broadcast": 0}), (2, {"order": 2})):
        p = plain_kneser_ney([t for i, t, _ in rows if i in good and t], order)
        got = {r.doc_id: r for r in ngram_quality.perplexity(docs, ids, **options).collect()}
        assert len(got) == len(rows)
        for i, text, _ in rows:
            raw = [0xFF] * (order - 1) + list((text or "").encode())
            assert got[i].n_bytes == len(raw) - order + 1
            if len(raw) == order - 1:
                assert got[i].perplexity is None
            else:
                want = math.exp(-np.mean([math.log(max(p(tuple(raw[k - order + 1 : k + 1])), 1e-12)) for k in range(order - 1, len(raw))]))
                assert abs(got[i].perplexity - want) < 1e-4 * want


def test_thresholds_are_quantiles_of_held_out_trusted_texts(spark):
    rows, _ = corpus(400, seed=2)
    docs = spark.createDataFrame(rows + [(5, "ba na", rows[5][2]), (5, None, rows[5][2]), (8000, "ba na ko", None)], DOC)
    ids = spark.createDataFrame([(i,) for i, _, _ in rows if i % 2], "doc_id long")
    got = ngram_quality.judge(docs, ids, quantile=0.9, least=10).collect()
    scores = {id(r): r.perplexity for r in got}
    lang = {i: y for i, _, y in rows}
    held = [r for r in got if r.doc_id is not None and r.doc_id % 2 and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.perplexity is not None]
    assert len(got) == 403 and len(held) > 20
    for r in got:
        own = sorted(scores[id(x)] for x in held if lang.get(x.doc_id) == lang.get(r.doc_id))
        if len(own) < 10:
            own = sorted(scores[id(x)] for x in held)
        want = own[max(0, math.ceil(0.9 * len(own)) - 1)]
        assert abs(r.threshold - want) < 1e-9, r
        assert r.kept == (r.perplexity is not None and r.perplexity <= r.threshold)
    more = docs.selectExpr("*", "1 AS n", "2 AS own", "3 AS common", "4 AS block", "5 AS trusted", "6 AS perplexity")
    assert sorted(ngram_quality.judge(more, ids, quantile=0.9, least=10).collect(), key=str) == sorted(got, key=str)


def test_quality_keeps_clean_text(spark):
    rows, _ = corpus(300)
    junk = [(5000 + i, "".join(random.Random(i).choice("!#%$ZQXJ0189") for _ in range(200)), "aa") for i in range(20)]
    docs = spark.createDataFrame(rows + junk + [(None, "ba na ko", "aa"), (7000, None, None)], DOC)
    ids = spark.createDataFrame([(i,) for i, _, _ in rows if i % 2], "doc_id long")
    got = {r.doc_id: r.kept for r in ngram_quality.judge(docs, ids).collect()}
    assert len(got) == len(rows) + len(junk) + 2
    assert not any(got[i] for i, _, _ in junk) and not got[7000]
    assert np.mean([got[i] for i, _, _ in rows]) > 0.97
    none = ngram_quality.judge(docs, ids.limit(0)).collect()
    assert len(none) == len(got) and not any(r.kept for r in none)
    assert ngram_quality.judge(docs.limit(0), ids).count() == 0


def test_language_of_unusual_rows(spark):
    """Many languages, empty tables, repeated ids, clashing names, and rejection by score."""
    rows, _ = corpus(300, seed=4)
    long = " ".join(t for _, t, y in rows if y == "aa") * 20
    docs = spark.createDataFrame(rows + [(1, "пр ив ет", "cc"), (1, "ba na ko", "aa"), (8000, long, None), (8001, None, "aa"), (8002, "12 !", "aa"), (None, "ba na mi", None)], DOC)
    model = language.fit(docs, F.col("doc_id") % 3 != 1)
    got = language.identify(docs, model).collect()
    assert len(got) == docs.count() and model.langs == ["aa", "bb", "cc"]
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (8001, 8002)} == {("und", 0.0)}
    assert next(r.lang_pred for r in got if r.doc_id == 8000) == "aa"
    assert sorted(r.lang_pred for r in got if r.doc_id == 1) == sorted(["aa", "cc", rows[1][2]])
    assert all(r.accepted == (r.lang_pred != "und" and r.score >= model.reject) for r in got)
    truth = {i: y for i, _, y in rows}
    sure = [r for r in got if r.accepted and r.doc_id in truth and r.doc_id != 1]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in sure]) > 0.98
    more = docs.selectExpr("*", "1 AS lang_pred", "2 AS score", "3 AS accepted", "4 AS _n", "5 AS _rank")
    assert sorted(language.identify(more, model).collect(), key=str) == sorted(got, key=str)
    assert language.identify(docs.limit(0), model).count() == 0
    assert language.fit(docs.limit(0), F.lit(True)).langs == []


def test_language_sample_leaves_no_language_out(spark):
    rows = [(i, f"text number {i}", f"l{i % 40:02d}") for i in range(2000)]
    docs = spark.createDataFrame(rows, DOC)
    found = language.labelled_sample(docs, F.lit(True), per_lang=30, most_rows=200).collect()
    assert {r.lang for r in found} == {f"l{i:02d}" for i in range(40)}
    assert max(Counter(r.lang for r in found).values()) == 5
    assert max(Counter(r.lang for r in language.labelled_sample(docs, F.lit(True), per_lang=30).collect()).values()) == 30


def test_toxic_sample_is_chosen_among_usable_texts(spark):
    rows = [(i, "x" * 30_000 if i < 150 else f"text {i}", "aa") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    found = toxicity.labelled_sample(spark.createDataFrame(rows, DOC), labels, mod=10**9, out=-1, per_class=60).collect()
    assert Counter(r.toxic for r in found) == {0: 60, 1: 60} and min(r.doc_id for r in found) >= 150


def plain_toxicity(model, text):
    """The score of one text word by word, without arrays of texts."""
    mask = (1 << 64) - 1
    words = [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", text.encode())]
    vectors = []
    for w in words:
        total = np.zeros(model.embedding.shape[1])
        for i, stem in enumerate((None, *toxicity.STEMS)):
            part = w if stem is None else w[:stem]
            h = sum((b + 1) * pow(int(toxicity._MULT), (j & 63) + 1, 1 << 64) + j for j, b in enumerate(part))
            h = (h + (0x5851F42D4C957F2D * i & mask)) & mask
            h ^= h >> 29
            h = h * 0xBF58476D1CE4E5B9 & mask
            h ^= h >> 32
            slot = h & (toxicity._SLOTS - 1)
            total += model.embedding[model.row[slot] if model.fingerprint[slot] == h >> 32 else 0]
        vectors.append(total)
    pooled = []
    for w, b in zip(model.filters, model.biases, strict=True):
        found = [sum(vectors[i + j] @ w[j] for j in range(len(w))) + b for i in range(len(vectors) - len(w) + 1)]
        pooled += list(np.maximum(np.max(found, axis=0), 0)) if found else [0.0] * len(b)
    z = float(np.dot(pooled, model.out)) + model.bias
    return 1 / (1 + math.exp(-min(30, max(-30, model.scale * z + model.shift))))


def plain_language(model, text):
    """Probabilities of one text from the subwords at each of its bytes."""
    raw = text.encode()
    folded = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in raw]
    total = np.zeros(len(model.langs))
    for size in (2, 3, 4):
        for i in range(len(raw)):
            code = int.from_bytes(bytes((folded[i : i + size] + [32] * size)[:size]), "big")
            total += model.table[((code * 0x9E3779B1 + (size * 0x61C88647 & 0xFFFFFFFF)) & 0xFFFFFFFF) >> 16]
    z = (total / max(1, len(raw)) / 3 + model.bias) / model.temperature
    p = np.exp(z - z.max())
    return p / p.sum()


def test_scores_equal_plain_recomputation(spark):
    data = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    some = docs.where("length(text) < 3000").orderBy("doc_id").limit(25).unionByName(spark.createDataFrame([(-1, "", None, None, 0), (-2, "Ünïcödé word " + "x" * 200, None, None, 0), (-3, "12 34", None, None, 0)], docs.schema))
    texts = {r.doc_id: r.text for r in some.collect()}
    toxic = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(some, toxic).collect()}
    assert all(abs(got[i] - plain_toxicity(toxic, t)) < 1e-4 for i, t in texts.items())
    model = language.fit(docs, F.lit(True))
    for r in language.identify(some, model).collect():
        p = plain_language(model, texts[r.doc_id])
        assert r.lang_pred == "und" and r.score == 0 or r.lang_pred == model.langs[int(p.argmax())] and abs(r.score - p.max()) < 1e-4
