"""Inputs that the registered queries derive from the given tables, as SQL that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: A fifth of a customer's key is its asset, the rest its column. Two snapshots differ in some facts and rows.
OBSERVED = """
SELECT c_mktsegment AS schema_name, concat('t', CAST(floor(c_custkey / 5.0) AS BIGINT)) AS name,
  CASE WHEN floor(c_custkey / 5.0) % 9 = 0 THEN 'view' ELSE 'table' END AS asset_type, concat('c', c_custkey % 5) AS column_name,
  CASE WHEN c_custkey % 6 = 0 THEN 'bigint' ELSE 'text' END AS data_type, CAST(c_custkey % 5 + 1 AS INTEGER) AS ordinal, c_acctbal > 0 AS nullable
FROM customer WHERE floor(c_custkey / 5.0) % 7 <> 0 AND c_custkey % 11 <> 0"""
STORED = """
SELECT c_mktsegment AS schema_name, concat('t', CAST(floor(c_custkey / 5.0) AS BIGINT)) AS name,
  CASE WHEN floor(c_custkey / 5.0) % 18 = 0 THEN 'view' ELSE 'table' END AS asset_type, concat('c', c_custkey % 5) AS column_name,
  CASE WHEN c_custkey % 12 = 0 THEN 'bigint' ELSE 'text' END AS data_type, CAST(c_custkey % 5 + 1 AS INTEGER) AS ordinal, c_acctbal > 0 AS nullable,
  CASE WHEN floor(c_custkey / 5.0) % 13 = 0 THEN 'missing' ELSE 'active' END AS asset_lifecycle,
  CASE WHEN floor(c_custkey / 5.0) % 13 = 0 OR c_custkey % 17 = 0 THEN 'missing' ELSE 'active' END AS column_lifecycle
FROM customer WHERE floor(c_custkey / 5.0) % 5 <> 0 AND c_custkey % 8 <> 0"""
ASSETS = """
SELECT concat('a', c_custkey) AS asset_id, c_mktsegment AS schema_name, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 's0' ELSE 's1' END AS source_id,
  CASE WHEN c_custkey % 10 = 0 THEN 'missing' WHEN c_custkey % 23 = 0 THEN 'deprecated' ELSE 'active' END AS lifecycle FROM customer"""
#: A customer's orders are the versions of its asset; the digest changes with the status.
VERSIONS = """
SELECT concat('a', o_custkey) AS asset_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version,
  md5(o_orderstatus) AS digest, o_orderdate AS created_at, o_orderkey FROM orders"""
COMPUTED = """SELECT concat('a', c_custkey) AS asset_id, md5(CASE c_custkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'F' ELSE 'O' END) AS digest FROM customer"""
#: Orders are proposals, their line items decisions.
PROPOSALS = """
SELECT o_orderkey AS proposal_id, o_custkey % 200 AS asset_id, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderdate, o_orderkey) AS version,
  o_orderkey % 4 AS profile_version, o_orderdate AS created_at FROM orders"""
DECISIONS = """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)), CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR(20))) AS id, l_orderkey AS proposal_id,
  CASE WHEN l_returnflag = 'R' THEN 'reject' ELSE 'approve' END AS outcome, CASE WHEN l_linestatus = 'F' THEN 'human' ELSE 'policy' END AS actor_kind,
  concat('x', l_suppkey % 3) AS actor_id, CASE WHEN l_linestatus = 'F' AND l_partkey % 7 <> 0 THEN NULL ELSE concat('x', l_suppkey % 3) END AS policy_id,
  'r' AS reason, CASE WHEN l_partkey % 5 = 0 THEN concat('k', l_partkey) END AS idempotency_key, l_shipdate AS decided_at
FROM lineitem"""
STATES = """SELECT DISTINCT o_custkey % 200 AS asset_id, (o_custkey % 200) % 9 <> 0 AS active, (o_custkey % 200) % 4 AS latest_version FROM orders"""
TASKS = """
SELECT event_id AS task_id, user_id AS run_id, event_type AS task_type, props AS payload,
  CASE WHEN user_id % 3 = 0 THEN 'done' WHEN user_id % 3 = 1 AND event_id % 9 < 3 THEN 'pending' WHEN event_id % 7 = 1 THEN 'claimed' WHEN event_id % 7 = 2 THEN 'running'
    WHEN event_id % 7 = 3 AND user_id % 3 = 2 THEN 'failed' WHEN event_id % 7 = 4 AND user_id % 3 = 2 THEN 'dead' ELSE 'done' END AS state,
  event_id % 4 AS attempts, CAST(3 AS BIGINT) AS max_attempts, ts AS lease_expires_at, event_id % 5 <> 0 AS retryable, event_id % 6 <> 0 AS affordable,
  concat('h', event_id % 11) AS claimed_by, CAST(event_id % 3 + 1 AS BIGINT) AS steps_budget, CAST(900 AS BIGINT) AS tokens_budget, CAST(1 + event_id % 2 AS DECIMAL(14,6)) AS cost_budget, CAST(60 AS BIGINT) AS wall_clock_budget,
  CAST(event_id % 3 AS BIGINT) AS steps_used, CAST(event_id % 1000 AS BIGINT) AS tokens_used, CAST(value / 100 AS DECIMAL(14,6)) AS cost_used, CAST(event_id % 50 AS BIGINT) AS wall_clock_used
FROM events"""
RUNS = """
SELECT user_id AS run_id, CASE user_id % 10 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'pending' ELSE 'running' END AS status, concat('g', user_id % 7) AS goal, concat('p', user_id % 4) AS payload, min(ts) AS created_at,
  CAST(count(*) AS BIGINT) AS steps, CAST(sum(event_id % 100) AS BIGINT) AS tokens, CAST(sum(CAST(value AS DECIMAL(14,6))) AS DECIMAL(20,6)) AS cost, CAST(sum(event_id % 50) AS BIGINT) AS wall_clock,
  CAST(70 AS BIGINT) AS steps_cap, CAST(3000 AS BIGINT) AS tokens_cap, CAST(2500 AS DECIMAL(20,6)) AS cost_cap, CAST(2000 AS BIGINT) AS wall_clock_cap
FROM events GROUP BY user_id"""
CHARGES = """
SELECT user_id AS run_id, event_id AS task_id, event_id AS seq, CAST(1 AS BIGINT) AS steps, CAST(event_id % 100 AS BIGINT) AS tokens, CAST(value AS DECIMAL(18,8)) AS cost, CAST(event_id % 50 AS BIGINT) AS wall_clock FROM events"""
CAPS = """SELECT DISTINCT user_id AS run_id, CAST(20 + user_id % 60 AS BIGINT) AS steps_cap, CAST(1000 + user_id AS BIGINT) AS tokens_cap, CAST(900 + user_id AS DECIMAL(20,6)) AS cost_cap FROM events"""
REQUESTS = """SELECT concat('k', user_id, '-', CAST(floor(event_id / 400.0) AS BIGINT)) AS key, ts AS asked_at, event_id AS id, event_type FROM events"""
CHECKPOINTS = """SELECT user_id AS task_id, event_id % 12 AS step, ts AS updated_at, event_id, props AS state FROM events"""
SPANS = """SELECT event_id AS task_id, substr(md5(concat('run', user_id)), 1, 16) AS trace_id, CASE WHEN event_type = 'click' THEN 'generation' ELSE 'tool' END AS kind,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'v1' END AS prompt_version FROM events WHERE event_id % 6 <> 0"""
#: Expected labels from what is known of documents; three runs miss some in their own ways.
EXPECTED = """
SELECT d.source AS table_name, concat('d', d.doc_id) AS column_name, CASE WHEN l.toxic = 1 AND l.quality = 1 THEN array['pii', 'phi'] WHEN l.toxic = 1 THEN array['financial'] WHEN l.quality = 0 THEN array['pii'] ELSE array['none'] END AS labels
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
PREDICTED = """
SELECT r.run, d.source AS table_name, concat('d', d.doc_id) AS column_name,
  CASE WHEN (d.doc_id + r.run) % 29 = 0 THEN array['none'] WHEN l.toxic = 1 AND l.quality = 1 THEN array['phi', 'pii'] WHEN l.toxic = 1 THEN array['financial'] WHEN l.quality = 0 THEN array['pii'] WHEN d.doc_id % 31 = 0 THEN array['pii'] ELSE array['none'] END AS labels
FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN (SELECT 1 AS run UNION ALL SELECT 2 UNION ALL SELECT 3) r ON (d.doc_id + r.run) % 41 <> 0"""
#: The same predictions with a confidence, what they cite, and what may be cited; the second run cites some facts that are not there.
CONFIDENT = f"""
SELECT q.run, q.table_name, q.column_name, q.labels, CASE WHEN (CAST(substr(q.column_name, 2) AS BIGINT) + q.run) % 37 = 0 THEN 70 ELSE 80 END AS confidence FROM ({PREDICTED}) q"""
CITATIONS = """
SELECT r.run, d.source AS asset_id, CAST(1 AS BIGINT) AS version, concat('d', d.doc_id) AS column_name, k.kind,
  CASE WHEN k.kind = 'data_type' THEN 'text' WHEN r.run = 2 AND d.doc_id % 43 = 0 THEN 'absent' ELSE coalesce(d.lang, '-') END AS locator
FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN (SELECT 1 AS run UNION ALL SELECT 2 UNION ALL SELECT 3) r ON (d.doc_id + r.run) % 41 <> 0
  JOIN (SELECT 'data_type' AS kind UNION ALL SELECT 'semantic_type') k ON k.kind = 'semantic_type' OR (d.doc_id + r.run) % 47 <> 0"""
CITABLE = """
SELECT d.source AS asset_id, CAST(1 AS BIGINT) AS version, concat('d', d.doc_id) AS column_name, k.kind, CASE WHEN k.kind = 'data_type' THEN 'text' ELSE coalesce(d.lang, '-') END AS locator
FROM documents d JOIN (SELECT 'data_type' AS kind UNION ALL SELECT 'semantic_type') k ON true"""
FIELDS_OLD = """
SELECT concat('m', CAST(floor(p_partkey / 8.0) AS BIGINT)) AS subject, concat('/f', p_partkey % 8) AS path, CASE WHEN p_size % 2 = 0 THEN 'string' ELSE 'integer' END AS type, p_size % 3 = 0 AS required,
  CASE WHEN p_size % 5 = 0 THEN array['a', 'b', 'c'] END AS vals FROM part WHERE p_partkey % 13 <> 0"""
FIELDS_NEW = """
SELECT concat('m', CAST(floor(p_partkey / 8.0) AS BIGINT)) AS subject, concat('/f', p_partkey % 8) AS path, CASE WHEN p_partkey % 19 = 0 THEN 'number' WHEN p_size % 2 = 0 THEN 'string' ELSE 'integer' END AS type, p_size % 3 = 0 OR p_partkey % 17 = 0 AS required,
  CASE WHEN p_size % 5 = 0 AND p_partkey % 7 = 0 THEN array['a', 'c'] WHEN p_size % 5 = 0 THEN array['a', 'b', 'c', 'd'] END AS vals FROM part WHERE p_partkey % 11 <> 0 AND floor(p_partkey / 8.0) % 40 <> 0"""


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs a query over the given tables, each a view of its Parquet files."""
    for table in TABLES:
        if re.search(rf"\b{table}\b", sql):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(re.sub(r"array\[([^\]]*)\]", r"array(\1)", sql))
