"""The queries of this subpackage: thin digests of the operators over their whole tables."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.llm import bpe, cover_tree, hard_negatives, language, main_text, mixing, ngram_quality, simhash, spelling, substring_dedup, suffix_dedup, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat an earlier 100-byte string."""
    return suffix_dedup.removal_report(_table(spark, sf_dir, "documents"), length=100)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows of fold 1 are never learned from."""
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs, toxicity.fold("doc_id", 3) != 1)
    found = language.identify(docs, model)
    return found.select("doc_id", (toxicity.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.93."""
    return cover_tree.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products for every hundredth vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text they decode to."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")

    def digests(part, codec, ids, at):
        data, ends = codec.decode(ids, at)
        raw = data.tobytes()
        spelled = [hashlib.sha256(x).hexdigest() for x in codec.spelled_ids(ids, at)]
        decoded = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(spelled), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bpe.apply(docs, bpe.Codec(public_tokenizers.path("byte_bpe_50k.json")), digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of fold 0 are never seen."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, mod=5, out=0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text.extract(_table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of every document."""
    return mixing.report(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of the documents labelled as good, and the verdict."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return ngram_quality.judge(docs, labels.where("quality = 1"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 13-word windows that an earlier document holds."""
    return substring_dedup.removal_report(_table(spark, sf_dir, "documents"), length=13)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that come close to the positives of every hundredth vector; every seventh label is shifted first."""
    given = _table(spark, sf_dir, "embeddings")
    given = given.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(given, F.col("vec_id") % 100 == 0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the frequent word one edit away that each may be a variant of."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_language, op3_embedding_dedup, op4_topk, op5_simhash, op6_bpe, op7_toxicity, op8_main_text, op9_mixing, op10_quality, op11_substring_dedup, op12_hard_negatives, op13_spelling)}
_OK = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_TOPK_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE {_OK}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 10
"""
_LINKS_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND {_OK} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
r(n, m) AS (SELECT a, least(a, b) FROM l UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.n WHERE r.m < l.b),
c AS (SELECT n, min(m) AS m FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0) AS n_links, coalesce(c.m, vec_id) AS component_id, coalesce(c.m, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN c ON c.n = vec_id
"""
_NEGATIVES_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND {_OK}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
r AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS n
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, n::INT AS rank, negative_id, positive_score, negative_score FROM r WHERE n <= 5
"""
ORACLE_SQL: dict[str, str] = {"op3_embedding_dedup": _LINKS_SQL, "op4_topk": _TOPK_SQL, "op9_mixing": mixing.report_sql(), "op12_hard_negatives": _NEGATIVES_SQL}
