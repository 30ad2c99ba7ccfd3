"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakewarden.llm import hosts, langid, media, merkle, neardup, packing, periods, quotes, sampling, secrets, sql, topk, toxicity, warc


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return langid.identify(docs, tokenizer_path("piece_bpe_32k.model"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.rate(docs, labels)


def op8_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return quotes.conversations(quotes.as_mail(turns))


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sampling.round_trip(docs, tokenizer_path("piece_bpe_32k.model"), seed=1)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.derive(warc.responses(pages), ["page_id"])


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(generate_series(1, len(a.q)), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingles
  FROM d),
x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = s.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_language_id, op2_media_columns, op3_secrets, op4_mixture_packing, op5_toxicity, op6_warc_derivatives,
        op7_exact_top_k, op8_quote_threads, op9_sampled_pieces, op10_minhash_near_dedup,
        op11_host_reputation, op12_merkle_manifest, op13_periodic_runs,
    )
    return {op.__name__: op for op in ops}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_top_k": OP7_SQL, "op10_minhash_near_dedup": OP10_SQL, "op11_host_reputation": sql.OP11_SQL, "op12_merkle_manifest": sql.OP12_SQL}
