"""Registered queries of streams over several batches, drift, dense retrieval, nested schemas, snapshots and replayed decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.operators import compat, dense, drift, profile, quality, review
from lakewarden.plans import inputs as I
from lakewarden.plans.estate import COLUMNS, Query, doubles, profile_sql, table, with_inputs
from lakewarden.plans.estate_more import SQL_MORE
from lakewarden.sources import catalog, snapshot
from lakewarden.streaming import folds, streams

QUERIES_DEPTH: dict[str, Query] = {}
SQL_DEPTH: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def keep(query: Query) -> Query:
        QUERIES_DEPTH[name] = query
        if sql:
            SQL_DEPTH[name] = sql
        return query

    return keep


# Streams in several batches, in order of time

LEASE_HOURS = 8
_TASK_EVENTS = """
SELECT user_id AS task_id, CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'done' WHEN event_type = 'error' AND event_id % 11 = 0 THEN 'failed' WHEN event_type = 'signup' THEN 'pending' WHEN event_type = 'view' THEN 'claimed' ELSE 'running' END AS state,
  event_id % 4 AS attempts, CAST(floor(CAST({} AS BIGINT) / 1000) AS BIGINT) AS ms, event_id AS seq FROM events"""
_TASK_MOVES = f"""
WITH e AS ({_TASK_EVENTS.format("epoch_us(ts)")}),
n AS (SELECT *, lead(ms) OVER (PARTITION BY task_id ORDER BY ms, seq) AS next_ms, max(ms) OVER () - 1000 AS watermark FROM e),
m AS (
  SELECT task_id, state, attempts, ms, seq FROM n
  UNION ALL
  SELECT task_id, CASE WHEN attempts >= 3 THEN 'dead' ELSE 'pending' END, attempts, ms + {LEASE_HOURS} * 3600000, -1 FROM n
  WHERE state IN ('claimed', 'running') AND CASE WHEN next_ms IS NULL THEN ms + {LEASE_HOURS} * 3600000 < watermark ELSE next_ms > ms + {LEASE_HOURS} * 3600000 END),
d AS (SELECT *, coalesce(bool_or(state IN ('done', 'failed', 'dead')) OVER (PARTITION BY task_id ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM m)
SELECT task_id, state, attempts, ms FROM d WHERE NOT ended"""


def moves(stream: DataFrame, home: str) -> None:
    """Drains the folded task states of a stream of (task_id, state, attempts, ms, seq) into home/rows."""
    rows = stream.select("task_id", "state", "attempts", F.timestamp_millis("ms").alias("at"), "seq")
    folded = folds.fold_tasks(rows, LEASE_HOURS * 3_600_000, delay="1 second", keep_ms=3650 * 86_400_000)
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{home}/rows/batch={batch}")  # noqa: E731  a batch that comes again replaces its rows
    with folds.rocks(stream.sparkSession):
        query = folded.writeStream.outputMode("update").option("checkpointLocation", f"{home}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


@add("k1_stream_task_moves", _TASK_MOVES)
def _k1(spark, sf_dir):
    home = streams.fed(I.derive(spark, sf_dir, _TASK_EVENTS.format("unix_micros(CAST(ts AS TIMESTAMP))")), "ms", 4, "moves", moves)
    return spark.read.schema(f"{folds.TASK}").parquet(f"{home}/rows").select("task_id", "state", "attempts", F.unix_millis("at").alias("ms"))


@add("k2_stream_clamped_usage", SQL_MORE["i3_clamped_usage"])
def _k2(spark, sf_dir):
    budgets = I.derive(spark, sf_dir, I.CAPS)

    def drain(stream: DataFrame, home: str) -> None:
        clamped = folds.clamp_usage(stream, budgets)
        with folds.rocks(spark):
            query = clamped.writeStream.format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    charges = I.derive(spark, sf_dir, I.CHARGES)
    home = streams.fed(charges, "seq", 3, "charges", drain)
    return doubles(spark.read.parquet(f"{home}/rows"), *(f"{d}_{x}" for d in ("steps", "tokens", "cost") for x in ("used", "applied", "over")))


@add("k4_cumulated_profile", profile_sql("events"))
def _k4(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(*COLUMNS["events"])

    def drain(stream: DataFrame, home: str) -> None:
        record = folds.record_profiles(home, "events")

        def twice(batch: DataFrame, batch_id: int) -> None:  # as after a failure between the batch and its commit
            record(batch, batch_id)
            record(batch, batch_id)
            if batch_id == 1:
                profile.State(spark, f"{home}/state", events.schema).compact(before=1)

        stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{home}/stream").trigger(availableNow=True).start().awaitTermination()

    home = streams.fed(events, "event_id", 3, "profile", drain)
    return doubles(profile.flat(profile.State(spark, f"{home}/state", events.schema).profile()), "null_ratio", "distinct_ratio")


_HEALTH_EVENTS = "SELECT event_id AS task_id, ts AS at, CASE WHEN event_type = 'error' THEN 'dead' ELSE 'done' END AS state, event_id % 500 AS age_seconds FROM events"


@add(
    "l10_stream_health",
    with_inputs("SELECT time_bucket(INTERVAL '1 hour', h.at) AS start, count(*) AS events, count(*) FILTER (state = 'dead') AS dead, max(age_seconds) AS oldest_seconds FROM h GROUP BY 1 HAVING time_bucket(INTERVAL '1 hour', h.at) + INTERVAL '1 hour' <= (SELECT max(h.at) - INTERVAL '10 minutes' FROM h)", h=_HEALTH_EVENTS),
)
def _l10(spark, sf_dir):
    rows = I.derive(spark, sf_dir, _HEALTH_EVENTS).withColumn("at", F.col("at").cast("timestamp"))
    late = rows.join(F.broadcast(rows.agg(F.min("at").alias("at"))), "at").select(*rows.columns)  # the first row once more, long after its window has closed

    def drain(stream: DataFrame, home: str) -> None:
        stream_of = folds.health(stream, delay="10 minutes").writeStream.format("parquet").option("path", f"{home}/rows")
        stream_of.option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()

    home = streams.fed(rows, "at", 4, "health", drain, late=late)
    return spark.read.parquet(f"{home}/rows").withColumn("start", F.col("start").cast("timestamp_ntz"))


# Drift and freshness

_OLD_VALUES = "SELECT CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_extendedprice END AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01 00:00:00'"
_NEW_VALUES = "SELECT CASE WHEN l_linenumber % 5 = 0 THEN round(l_extendedprice, -3) ELSE l_extendedprice * 1.1 END AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01 00:00:00'"
_COUNTED = f"a AS ({_OLD_VALUES}), b AS ({_NEW_VALUES}), c AS (SELECT v, sum(x) AS x, sum(y) AS y FROM (SELECT v, 1 AS x, 0 AS y FROM a UNION ALL SELECT v, 0, 1 FROM b) WHERE v IS NOT NULL GROUP BY v), r AS (SELECT *, sum(x) OVER (ORDER BY v) AS rx, sum(y) OVER (ORDER BY v) AS ry, sum(x) OVER () AS nx, sum(y) OVER () AS ny FROM c)"


def samples(spark, sf_dir) -> DataFrame:
    return drift.counted(I.derive(spark, sf_dir, _OLD_VALUES), I.derive(spark, sf_dir, _NEW_VALUES), "v")


@add("l1_ks_distance", f"WITH {_COUNTED} SELECT CAST(max(nx) AS BIGINT) AS n_base, CAST(max(ny) AS BIGINT) AS n_now, round(max(abs(rx / nx - ry / ny)), 9) AS ks FROM r")
def _l1a(spark, sf_dir):
    return drift.distance(samples(spark, sf_dir))


@add(
    "l1_numeric_stability",
    f"WITH {_COUNTED}, e AS (SELECT list_distinct([{', '.join(f'min(v) FILTER (rx * 10 >= nx * {q})' for q in range(1, 10))}]) AS e FROM r), "
    "g AS (SELECT len(list_filter(e, lambda z: z < v)) AS bin, sum(x) AS x, sum(y) AS y FROM r, e GROUP BY 1), h AS (SELECT CASE WHEN x > 0 THEN x ELSE 0.5 END::DOUBLE AS x, CASE WHEN y > 0 THEN y ELSE 0.5 END::DOUBLE AS y FROM g), "
    "t AS (SELECT x / sum(x) OVER () AS p, y / sum(y) OVER () AS q FROM h) SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM t",
)
def _l1b(spark, sf_dir):
    return drift.stability(samples(spark, sf_dir))


@add("l1_freshness", "SELECT event_type, max(ts) AS latest, CAST(date_diff('microsecond', max(ts), TIMESTAMP '2024-01-31 00:00:00') // 1000000 AS BIGINT) AS age_seconds, date_diff('microsecond', max(ts), TIMESTAMP '2024-01-31 00:00:00') // 1000000 <= 3600 AS fresh FROM events GROUP BY event_type")
def _l1c(spark, sf_dir):
    return quality.freshness(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 3600, "event_type")


# Dense retrieval

_UNITS = "SELECT vec_id, list_transform(v, lambda x: x / n) AS u FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL)) WHERE n > 0"


@add("l3_dense_top", with_inputs("SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.u, b.u), 6) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) WHERE a.vec_id % 100 = 0)) WHERE rank <= 8", u=_UNITS))
def _l3(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return dense.nearest(vectors, vectors.filter("vec_id % 100 = 0"), 8)


# Nested schemas

_MODEL = "concat('m', CAST(floor(p_partkey / 8.0) AS BIGINT))"
_REF = "concat('m', (CAST(floor(p_partkey / 8.0) AS BIGINT) * 3 + p_size {shift}) % 97)"
_MODELS_OLD = f"SELECT {_MODEL} AS model, concat('f', p_partkey % 8) AS field, CASE WHEN p_size % 6 = 0 THEN 'object' WHEN p_size % 2 = 0 THEN 'string' ELSE 'integer' END AS type, p_size % 3 = 0 AS required, CASE WHEN p_size % 5 = 0 THEN array['a', 'b', 'c'] END AS vals, CASE WHEN p_size % 6 = 0 THEN {_REF.format(shift='')} END AS ref FROM part WHERE p_partkey % 13 <> 0"
_MODELS_NEW = f"SELECT {_MODEL} AS model, concat('f', p_partkey % 8) AS field, CASE WHEN p_partkey % 19 = 0 THEN 'number' WHEN p_size % 6 = 0 THEN 'object' WHEN p_size % 2 = 0 THEN 'string' ELSE 'integer' END AS type, p_size % 3 = 0 OR p_partkey % 17 = 0 AS required, CASE WHEN p_size % 5 = 0 AND p_partkey % 7 = 0 THEN array['a', 'c'] WHEN p_size % 5 = 0 THEN array['a', 'b', 'c', 'd'] END AS vals, CASE WHEN p_size % 6 = 0 AND p_partkey % 19 <> 0 THEN CASE WHEN p_partkey % 4 = 0 THEN {_REF.format(shift='+ 5')} ELSE {_REF.format(shift='')} END END AS ref FROM part WHERE p_partkey % 11 <> 0"
_ROOTS_OLD = f"SELECT DISTINCT {_MODEL} AS subject FROM part WHERE CAST(floor(p_partkey / 8.0) AS BIGINT) % 5 = 0"
_ROOTS_NEW = f"SELECT DISTINCT {_MODEL} AS subject FROM part WHERE CAST(floor(p_partkey / 8.0) AS BIGINT) % 5 = 0 AND CAST(floor(p_partkey / 8.0) AS BIGINT) % 35 <> 0"


def _flat_sql(s: str) -> str:
    return (
        f"reach_{s} AS (SELECT subject, subject AS model FROM roots_{s} UNION SELECT r.subject, m.ref FROM reach_{s} r JOIN models_{s} m ON m.model = r.model WHERE m.ref IS NOT NULL), "
        f"flat_{s} AS (SELECT r.subject, CASE WHEN r.model <> r.subject THEN r.model END AS model, CASE WHEN r.model = r.subject THEN '/properties/' || field ELSE '/$defs/' || r.model || '/properties/' || field END AS path, type, required, vals FROM reach_{s} r LEFT JOIN models_{s} m ON m.model = r.model)"
    )


_FLAT = f"models_o AS ({_MODELS_OLD}), models_n AS ({_MODELS_NEW}), roots_o AS ({_ROOTS_OLD}), roots_n AS ({_ROOTS_NEW}), {_flat_sql('o')}, {_flat_sql('n')}"
_NESTED = f"""WITH RECURSIVE {_FLAT},
gone AS (SELECT DISTINCT subject, model FROM flat_o o WHERE model IS NOT NULL AND subject IN (SELECT subject FROM flat_n) AND NOT EXISTS (SELECT 1 FROM flat_n n WHERE n.subject = o.subject AND n.model = o.model)),
o AS (SELECT * FROM flat_o f WHERE path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.subject = f.subject AND g.model = f.model)), n AS (SELECT * FROM flat_n WHERE path IS NOT NULL),
both_ AS (SELECT coalesce(o.subject, n.subject) AS subject, coalesce(o.path, n.path) AS path, o.path AS op, n.path AS np, o.type AS ot, n.type AS nt, coalesce(o.required, false) AS oreq, n.required AS nreq, o.vals AS ov, n.vals AS nv FROM o FULL JOIN n ON o.subject = n.subject AND o.path = n.path)
SELECT subject, '/$defs/' || model AS path, 'removed_model' AS problem FROM gone
UNION ALL SELECT subject, path, CASE WHEN subject IN (SELECT subject FROM n) THEN 'removed_field' ELSE 'removed_subject' END FROM both_ WHERE np IS NULL
UNION ALL SELECT subject, path, 'type_changed' FROM both_ WHERE ot <> nt
UNION ALL SELECT subject, path, 'newly_required' FROM both_ WHERE nreq AND NOT oreq
UNION ALL SELECT subject, path, 'enum_narrowed' FROM both_ WHERE len(list_filter(ov, lambda x: NOT list_contains(nv, x))) > 0"""


@add("j1_nested_breaks", _NESTED)
def _j1(spark, sf_dir):
    old = compat.flatten(I.derive(spark, sf_dir, _MODELS_OLD), I.derive(spark, sf_dir, _ROOTS_OLD))
    new = compat.flatten(I.derive(spark, sf_dir, _MODELS_NEW), I.derive(spark, sf_dir, _ROOTS_NEW))
    return compat.nested_breaks(old, new)


@add("j1_flat_models", f"WITH RECURSIVE {_FLAT} SELECT subject, model, path, type, required FROM flat_o")
def _j1b(spark, sf_dir):
    return compat.flatten(I.derive(spark, sf_dir, _MODELS_OLD), I.derive(spark, sf_dir, _ROOTS_OLD)).select("subject", "model", "path", "type", "required")


# Snapshots and replays


@add("a6_snapshot_profile", profile_sql("orders"))
def _a6(spark, sf_dir):
    taken = snapshot.Snapshot(spark, f"{sf_dir}/orders.parquet")
    return doubles(profile.flat(snapshot.profile_snapshot(taken)), "null_ratio", "distinct_ratio")


@add("g10_answers")
def _g10(spark, sf_dir):
    """Each third decision comes once more, word for word, at a later time."""
    decisions = I.derive(spark, sf_dir, I.DECISIONS)
    again = decisions.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == 0).withColumns({"id": F.concat("id", F.lit("-again")), "decided_at": F.col("decided_at") + F.expr("INTERVAL '30' DAY")})
    settled = review.settle_keys(decisions.unionByName(again), I.derive(spark, sf_dir, I.PROPOSALS), I.derive(spark, sf_dir, I.STATES))
    return review.answered(*settled)



# Sinks


@add("a7_appended_versions", with_inputs("SELECT asset_id, version, digest FROM v", v=I.VERSIONS))
def _a7(spark, sf_dir):
    """First versions first, later ones appended to them."""
    path, versions = streams.folder(spark, "versions"), I.derive(spark, sf_dir, I.VERSIONS).withColumn("shard", F.crc32("asset_id") % 8)
    for part in ("version = 1", "version > 1"):
        catalog.append_version(versions.filter(part), path, "shard")
    return spark.read.parquet(path).select("asset_id", "version", "digest")


_ARTIFACT = "SELECT user_id % 3 AS run, event_id, {} AS event_type FROM events"


@add("a10_replaced_artifacts", f"SELECT * FROM ({_ARTIFACT.format('event_type')}) WHERE run <> 2 UNION ALL SELECT * FROM ({_ARTIFACT.format('upper(event_type)')}) WHERE run = 2")
def _a10(spark, sf_dir):
    """Three runs, of which one is written again."""
    path = streams.folder(spark, "artifacts")
    catalog.write_artifact(I.derive(spark, sf_dir, _ARTIFACT.format("event_type")), path)
    catalog.write_artifact(I.derive(spark, sf_dir, _ARTIFACT.format("upper(event_type)")).filter("run = 2"), path)
    return spark.read.schema("run bigint, event_id bigint, event_type string").json(path)
