"""The corpus queries, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import common, decontam, html_extract, importance, langid, neardup, packing, quality, secrets, token_counts, topk, toxicity, warc, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def sql(text: str) -> Callable:
    """The SQL for a query's rows."""

    def add(fn: Callable) -> Callable:
        ORACLES[fn.__name__] = text
        return fn

    return add


@sql("""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
""")
@query
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(common.table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % topk.QUERY_EVERY == 0), common.shared_dir(spark))


@sql("""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY 1),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (run) GROUP BY 1, 2)
SELECT doc_id, item_id, item_shingles, shared, CAST(shared AS DOUBLE) / item_shingles AS containment
FROM m JOIN n USING (item_id) WHERE shared >= ceil(CAST(0.8 AS DOUBLE) * item_shingles - 1e-9)
""")
@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"))


@query
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels"), common.shared_dir(spark)))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"), common.shared_dir(spark))


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(common.table(spark, sf_dir, "pages"), html_extract.train())


@query
def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(common.table(spark, sf_dir, "documents"), common.shared_dir(spark))


@sql("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
""")
@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(common.table(spark, sf_dir, "pages"), common.shared_dir(spark)).drop("url")


@query
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), common.shared_dir(spark))


@query
def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return secrets.digest(secrets.find(docs, secrets.train(docs)))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(common.table(spark, sf_dir, "embeddings"), common.shared_dir(spark))
