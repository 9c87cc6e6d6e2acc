"""The registered queries of this subpackage and their check SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

import corpus_pipeline
from lakelens.llm import (
    bpe,
    codes,
    fingerprints,
    langid,
    mixing,
    near,
    quality,
    resampling,
    secrets,
    semdedup,
    topk,
    toxicity,
    warc,
)
from lakelens.llm.shared import table
from lakelens.session import scratch_dir

QUERIES: dict = {"pipeline": corpus_pipeline.run}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query(mixing.mix_sql())
def op4_mixing(spark, folder):
    docs = table(spark, folder, "documents")
    taken = mixing.mix(docs).select("doc_id", "lang", "source", "text", "epoch")
    return taken.select(
        "doc_id", F.expr(mixing.DOMAIN_SQL).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"), mixing.token_count().alias("n_tokens"), "epoch")


@query(secrets.scan_sql())
def op10_secrets(spark, folder):
    return secrets.scan(table(spark, folder, "documents"))


@query()
def op1_near_dedup(spark, folder):
    classes = near.near_classes(table(spark, folder, "documents"), shingle=4, similarity=0.8)
    return classes.select("doc_id", "n_shingles", "component_id", "kept")


@query()
def op3_fingerprints(spark, folder):
    return fingerprints.fingerprints(table(spark, folder, "documents"))


@query()
def op9_bpe(spark, folder):
    return bpe.encode_digests(table(spark, folder, "documents"), corpus_pipeline.vocabulary())


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, html, h, max(page_id) OVER (PARTITION BY h) AS top,
    array_to_string(list_transform(string_split(h, ''), lambda c: substr(
        '0000000100100011010001010110011110001001101010111100110111101111',
        CAST(4 * (strpos('0123456789abcdef', c) - 1) + 1 AS BIGINT), 4)), '') AS bits FROM p),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, top,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS BIGINT), 1) AS INTEGER)
    + 8 * CAST(substr(bits, CAST(5 * i + 2 AS BIGINT), 1) AS INTEGER)
    + 4 * CAST(substr(bits, CAST(5 * i + 3 AS BIGINT), 1) AS INTEGER)
    + 2 * CAST(substr(bits, CAST(5 * i + 4 AS BIGINT), 1) AS INTEGER)
    + CAST(substr(bits, CAST(5 * i + 5 AS BIGINT), 1) AS INTEGER) AS BIGINT), 1)), '') AS payload_digest FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
    CAST(CASE WHEN page_id = top THEN NULL ELSE top END AS BIGINT) AS refers_to FROM d
""")
def op5_warc(spark, folder):
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    return warc.page_captures(table(spark, folder, "pages"), path)


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""")
def op7_topk(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"))


@query()
def op2_toxicity(spark, folder):
    return toxicity.detect(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op6_quality(spark, folder):
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"))
    return quality.rate(docs.select("doc_id", "text"), model).drop("text")


@query()
def op8_language(spark, folder):
    return langid.identify(table(spark, folder, "documents"))


@query(codes.compress_sql())
def op11_codes(spark, folder):
    return codes.compress(table(spark, folder, "embeddings")).drop("label")


@query(semdedup.vector_classes_sql())
def op12_vectors(spark, folder):
    return semdedup.vector_classes(table(spark, folder, "embeddings"))


@query()
def op13_resampling(spark, folder):
    drawn = resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
