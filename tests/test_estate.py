"""Profiles, catalog convergence, history, reviews, ledgers and streams on small fixtures; every query against its SQL."""

import os
import random
from decimal import Decimal

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakewarden.functions import text as masks
from lakewarden.operators import catalog, classify, compat, history, ledger, profile, quality, review, score
from lakewarden.plans import estate, inputs
from lakewarden.sources import catalog as sources
from lakewarden.streaming import folds

OBSERVED = "schema_name string, name string, asset_type string, column_name string, data_type string, ordinal int, nullable boolean"
STORED = OBSERVED + ", asset_lifecycle string, column_lifecycle string"


def test_profile_of_small_table(spark):
    rows = [(2, "yes"), (10, "yes"), (100, "no"), (10, None)]
    found = {r.name: r for r in profile.profile(spark.createDataFrame(rows, "n int, flag string")).collect()}
    assert found["n"].min_value.masked == "*" and found["n"].distinct_count == 3 and found["n"].semantic_type == "number"
    assert found["flag"].null_count == 1 and found["flag"].null_ratio == Decimal("0.250000")
    assert {t.value.masked for t in found["flag"].top_values} == {"***"} and found["flag"].top_values[0]["count"] == 2
    assert found["flag"].min_value.masked == "***" and found["flag"].min_value.length is None


def test_profile_of_empty_and_odd_tables(spark):
    empty = profile.profile(spark.createDataFrame([], "a int, `b``c.d` string")).collect()
    assert [(r.row_count, r.distinct_count, r.null_ratio, r.min_value, len(r.top_values), r.semantic_type) for r in empty] == [(0, 0, Decimal(0), None, 0, "unknown")] * 2
    odd = profile.profile(spark.sql("select map('a', 1) as m, array(1, 2) as l, named_struct('x', 1) as s")).collect()
    assert [r.name for r in odd] == ["m", "l", "s"]  # in column order
    assert odd[0].min_value is None and odd[1].min_value is not None


def test_long_values_are_ranked_exactly(spark):
    base = "x" * 400
    rows = [(base + c,) for c in "edcbazyx"] + [(base + "z",)]
    df = spark.createDataFrame(rows, "v string")
    top = profile.top_values(df, profile.frequencies(df), 5).orderBy("place").collect()
    assert [r.value[-1] for r in top] == ["z", "a", "b", "c", "d"]


def test_state_digest_ignores_order_and_clock(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id int, v string, at int")
    b = spark.createDataFrame([(2, "y", 9), (1, "x", 9)], "id int, v string, at int")
    assert profile.state_digest(a, ("at",)).collect() == profile.state_digest(b, ("at",)).collect()


def test_convergence(spark):
    observed = spark.createDataFrame([("s", "new", "table", "a", "int", 1, True), ("s", "kept", "view", "a", "int", 1, True), ("s", "back", "table", "a", "int", 1, True)], OBSERVED)
    stored = spark.createDataFrame(
        [("s", "kept", "table", "a", "text", 1, True, "active", "active"), ("s", "gone", "table", "a", "int", 1, True, "active", "active"), ("s", "lost", "table", "a", "int", 1, True, "missing", "missing"), ("s", "back", "table", "a", "int", 1, True, "missing", "missing")],
        STORED,
    )
    changes = {(r.name, r.change) for r in catalog.plan(observed, stored).collect()}
    assert changes == {("new", "insert_asset"), ("new", "insert_column"), ("kept", "update_asset"), ("kept", "update_column"), ("gone", "missing_asset"), ("gone", "missing_column"), ("back", "update_asset"), ("back", "update_column")}
    after = catalog.apply(observed, stored)
    assert catalog.plan(observed, after).isEmpty()
    assert {r.name: r.asset_lifecycle for r in after.collect()} == {"new": "active", "kept": "active", "back": "active", "gone": "missing", "lost": "missing"}
    assert catalog.plan(spark.createDataFrame([], OBSERVED), spark.createDataFrame([], STORED)).isEmpty()


def test_cursor_round_trip_and_refusal(spark):
    row = spark.createDataFrame([("s", "n", "i?>")], "a string, b string, c string").select(catalog.encode_cursor(F.col("a"), F.col("b"), F.col("c")).alias("k"))
    assert row.select(catalog.decode_cursor(F.col("k")).alias("p")).first().p == ["s", "n", "i?>"]
    with pytest.raises(Exception, match="bad cursor"):
        spark.createDataFrame([("eA==",)], "k string").select(catalog.decode_cursor(F.col("k"))).collect()


def test_register_first_wins(spark):
    shape = "name string, engine string, host string, database string, include_schemas array<string>, exclude_schemas array<string>, requested_at int"
    rows = [("b", "pg", "h", "d", ["x", "y"], [], 2), ("a", "pg", "h", "d", ["y", "x", "x"], None, 1)]
    fresh = sources.register(spark.createDataFrame(rows, shape), spark.createDataFrame([], shape))
    assert [r.name for r in fresh.collect()] == ["a"]
    assert sources.register(spark.createDataFrame(rows, shape), fresh).isEmpty()


def test_versions(spark):
    versions = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x")], "asset_id string, version int, digest string")
    computed = spark.createDataFrame([("a", "y"), ("b", "z"), ("c", "q")], "asset_id string, digest string")
    assert {(r.asset_id, r.version) for r in history.record(computed, versions).collect()} == {("b", 2), ("c", 1)}
    assert {(r.asset_id, r.version) for r in history.latest(versions).collect()} == {("a", 2), ("b", 1)}


def sequential(proposals, decisions, states):
    """Verdicts by a plain fold over the log."""
    status = {p["proposal_id"]: "pending" for p in proposals}
    by_id = {p["proposal_id"]: p for p in proposals}
    standing, out, seen_reject = {}, {}, set()
    for d in sorted(decisions, key=lambda d: (d["decided_at"], d["id"])):
        p = by_id[d["proposal_id"]]
        fair = d["policy_id"] == d["actor_id"] if d["actor_kind"] == "policy" else d["policy_id"] is None
        active, latest = states[p["asset_id"]]
        if not fair:
            out[d["id"]] = "policy_mismatch"
        elif status[p["proposal_id"]] != "pending":
            out[d["id"]] = "not_pending"
        elif d["outcome"] == "reject":
            out[d["id"]], status[p["proposal_id"]] = "accepted", "rejected"
        elif not active:
            out[d["id"]] = "inactive_asset"
        elif p["profile_version"] != latest:
            out[d["id"]] = "stale_profile"
        elif p["version"] <= standing.get(p["asset_id"], 0):
            out[d["id"]] = "newer_version_stands"
        else:
            out[d["id"]], status[p["proposal_id"]], standing[p["asset_id"]] = "accepted", "approved", p["version"]
    return out


def test_replay_equals_a_sequential_fold(spark):
    rng = random.Random(5)
    proposals, decisions, states = [], [], {}
    for asset in range(60):
        states[asset] = (rng.random() < 0.9, 1)
        proposals += [{"proposal_id": asset * 10 + v, "asset_id": asset, "version": v, "profile_version": 1 if rng.random() < 0.85 else 0} for v in range(1, 5)]
    for i in range(1500):
        kind = rng.choice(["human", "policy"])
        decisions.append({"id": i, "proposal_id": rng.choice(proposals)["proposal_id"], "outcome": rng.choice(["approve", "approve", "reject"]), "actor_kind": kind, "actor_id": "x", "policy_id": rng.choice(["x", None]) if kind == "policy" else rng.choice([None, None, "x"]), "reason": "r", "idempotency_key": None, "decided_at": rng.randrange(400)})
    shape = "id int, proposal_id int, outcome string, actor_kind string, actor_id string, policy_id string, reason string, idempotency_key string, decided_at int"
    names = [c.split()[0] for c in shape.split(", ")]
    log = spark.createDataFrame([tuple(d[n] for n in names) for d in decisions], shape)
    ours = spark.createDataFrame([tuple(p.values()) for p in proposals], "proposal_id int, asset_id int, version int, profile_version int")
    known = spark.createDataFrame([(a, *s) for a, s in states.items()], "asset_id int, active boolean, latest_version int")
    judged = review.judge(log, ours, known)
    assert {r.id: r.verdict for r in judged.collect()} == sequential(proposals, decisions, states)
    assert review.current(review.statuses(ours, judged)).groupBy("asset_id").count().filter("count > 1").isEmpty()


def test_ledger_rounding(spark):
    given = ["0.0000125", "0.0000135", "0.7000085", "3.1415925", "0.0000095", "2.0000115"]  # ties
    out = spark.createDataFrame([(Decimal(g),) for g in given], "c decimal(14,8)").select(ledger.ledger_cost(F.col("c")).alias("r")).collect()
    assert [str(r.r) for r in out] == ["0.000013", "0.000014", "0.700009", "3.141593", "0.000010", "2.000012"]


def test_clamp_on_equal_seq(spark):
    charges = spark.createDataFrame([("r", 1, i, 3, 0, Decimal("0"), 1) for i in (1, 2)] + [("r", 2, 3, 9, 0, Decimal("0"), 1)], "run_id string, seq int, task_id int, steps long, tokens long, cost decimal(14,6), wall_clock long")
    caps = spark.createDataFrame([("r", 5, 9, Decimal("9"))], "run_id string, steps_cap long, tokens_cap long, cost_cap decimal(14,6)")
    rows = ledger.clamped(charges, caps).collect()
    assert sorted((r.steps_used, r.steps_applied, r.steps_over) for r in rows) == [(3, 3, 0), (5, 0, 9), (5, 2, 1)]


def test_artifacts_of_other_runs_stay(spark, tmp_path):
    for run, v in ((1, "a"), (2, "b"), (2, "c")):
        sources.write_artifact(spark.createDataFrame([(run, v)], "run int, v string"), str(tmp_path / "out"))
    assert sorted((r.run, r.v) for r in spark.read.json(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "c")]


def test_versions_are_appended(spark, tmp_path):
    for v in (1, 2):
        sources.append_version(spark.createDataFrame([("a", v)], "asset_id string, version int"), str(tmp_path / "v"))
    assert sorted(r.version for r in spark.read.parquet(str(tmp_path / "v")).collect()) == [1, 2]


def test_tables_without_columns(spark):
    bare = spark.range(1).select()
    observed = sources.scan({("s", "bare"): bare, ("s", "full"): spark.range(1)})
    assert {(r.name, r.column_name) for r in observed.collect()} == {("bare", None), ("full", "id")}
    none = spark.createDataFrame([], STORED)
    assert {(r.name, r.change) for r in catalog.plan(observed, none).collect()} == {("bare", "insert_asset"), ("full", "insert_asset"), ("full", "insert_column")}
    stored = catalog.apply(observed, none)
    assert catalog.plan(observed, stored).isEmpty() and catalog.apply(observed, stored).count() == 2
    grown = sources.scan({("s", "bare"): spark.range(1), ("s", "full"): spark.range(1)})
    after = catalog.apply(grown, stored)
    assert {(r.name, r.column_name, r.asset_lifecycle) for r in after.collect()} == {("bare", "id", "active"), ("full", "id", "active")}
    assert catalog.plan(grown, after).isEmpty()
    gone = catalog.plan(sources.scan({("s", "full"): spark.range(1)}), stored).collect()
    assert [(r.name, r.change) for r in gone] == [("bare", "missing_asset")]


def test_jdbc_scan_filters(spark):
    query = sources.jdbc_query(["a'b"], ["c"])
    assert "in ('a''b')" in query and "'pg_catalog'" in query and "'c')" in query and "left join information_schema.columns" in query


def test_views_of_the_session_are_scanned(spark):
    spark.sql("create database if not exists lw_scan")
    spark.range(2).write.mode("overwrite").saveAsTable("lw_scan.t")
    spark.sql("create or replace view lw_scan.v as select id from lw_scan.t")
    try:
        found = {(r.name, r.asset_type) for r in sources.scan_catalog(spark, "lw_scan").filter("schema_name = 'lw_scan' and name in ('t', 'v')").collect()}
        assert found == {("t", "table"), ("v", "view")}
    finally:
        spark.sql("drop database lw_scan cascade")


def test_short_pages_have_no_cursor(spark):
    assets = spark.createDataFrame([("s", f"n{i:03d}", f"a{i}", "x") for i in range(70)], "schema_name string, name string, asset_id string, source_id string")
    first = catalog.page(assets, limit=50)
    assert first.count() == 50 and first.filter("cursor is null").isEmpty()
    rest = catalog.page(assets, ("s", "n049", "a49"), 50)
    assert rest.count() == 20 and rest.filter("cursor is not null").isEmpty()


def test_endpoints(spark):
    given = ["https://[::1]:8080/v1", "http://a.b:0/x", "\thttps://a.b/v1/ ", "https://a.b/?", "https://a.b/#", "https://a.b/?q", "https://a.b/#f", "https://[::1/v1", "https://a.b:x/"]
    rows = spark.createDataFrame([(g,) for g in given], "u string").select(compat.endpoint(F.col("u")).alias("e")).select("e.*").collect()
    assert [(r.host, r.port) for r in rows[:4]] == [("::1", 8080), ("a.b", 80), ("a.b", 443), ("a.b", 443)]
    assert [r.problem for r in rows] == [None, None, None, None, None, "query", "query", "host", "port"]


def test_register_knows_sources_without_a_host(spark):
    shape = "name string, engine string, host string, database string, include_schemas array<string>, exclude_schemas array<string>, requested_at int"
    rows = spark.createDataFrame([("a", "files", None, "d", [], [], 1)], shape)
    fresh = sources.register(rows, spark.createDataFrame([], shape))
    assert fresh.count() == 1 and sources.register(rows, fresh).isEmpty()


def test_keys_meet_only_where_there_is_one(spark):
    shape = "id int, proposal_id int, outcome string, actor_kind string, actor_id string, policy_id string, reason string, idempotency_key string, decided_at int"
    rows = [(1, 1, "approve", "human", "x", None, "r", "k", 1), (2, 1, "approve", "human", "x", None, "r", "k", 2), (3, 2, "approve", "human", "x", None, "r", "k", 3), (4, 1, "approve", "human", "x", None, "r", None, 1), (5, 1, "approve", "human", "x", None, "r", None, 1)]
    found = review.requests_by_key(spark.createDataFrame(rows, shape))
    assert {r.id: r.replay for r in found.collect()} == {1: "first", 2: "replay", 3: "conflict", 4: "first", 5: "first"}


def test_sweep_finds_a_planted_value(spark):
    rows = spark.createDataFrame([(1, "plain", ["x"]), (2, "has canary-7731 in it", []), (3, "n", ["canary-7731"])], "id int, v string, l array<string>")
    tokens = spark.createDataFrame([("canary-7731",), ("absent",)], "token string")
    assert [(r.token, r.rows) for r in quality.leaks(rows, tokens, "t").collect()] == [("canary-7731", 2)]
    masked = profile.flat(profile.profile(rows))
    assert quality.leaks(masked, tokens, "profile").isEmpty()


def test_scan_and_profile_twice(spark):
    """A second run over the same tables changes nothing."""
    tables = {("s", "t"): spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "a int, b string")}
    stored = catalog.apply(sources.scan(tables), spark.createDataFrame([], STORED))
    again = catalog.apply(sources.scan(tables), stored)
    assert catalog.plan(sources.scan(tables), stored).isEmpty() and sorted(map(tuple, stored.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    document = lambda: profile.table_document(profile.profile(tables["s", "t"])).select(F.lit("t").alias("asset_id"), profile.digest("row_count", "columns").alias("digest"))
    none = spark.createDataFrame([], "asset_id string, version int, digest string")
    first = history.record(document(), none)
    assert first.count() == 1 and history.record(document(), first.select("asset_id", F.col("version").cast("int").alias("version"), "digest")).isEmpty()


def test_masks_compile(spark, data, capfd):
    """The generated code of a mask stays within a method's limit."""
    spark.read.parquet(f"{data}/customer.parquet").select(masks.mask(F.col("c_name"))).write.format("noop").mode("overwrite").save()
    assert "grows beyond" not in capfd.readouterr().err


def test_leases_that_pass(spark, tmp_path):
    """Tasks whose lease is over become pending, or dead without attempts left; ended ones and those with time left stay."""
    shape = "task_id long, state string, attempts long, at timestamp"
    rows = [
        [(1, "running", 1, 0), (2, "claimed", 3, 0), (3, "running", 1, 0), (4, "running", 1, 5), (5, "done", 1, 0)],
        [(3, "done", 1, 20), (4, "running", 2, 3590), (9, "running", 1, 3600)],
        [(9, "done", 1, 3601)],
        [(9, "done", 1, 3602)],
    ]
    for i, batch in enumerate(rows):
        frame = spark.createDataFrame([(*r[:3], r[3]) for r in batch], "task_id long, state string, attempts long, s long")
        frame.select("task_id", "state", "attempts", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at")).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = folds.fold_tasks(stream, 60_000).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    seen = []
    with folds.rocks(spark):
        query.foreachBatch(lambda df, i: seen.extend((i, r.at, r.task_id, r.state, r.attempts) for r in df.collect())).start().awaitTermination()
    last = {task: (state, attempts) for _, _, task, state, attempts in sorted(seen, key=lambda x: x[:2])}
    assert last == {1: ("pending", 1), 2: ("dead", 3), 3: ("done", 1), 4: ("running", 2), 5: ("done", 1), 9: ("done", 1)}


def test_usage_stops_at_caps(spark):
    charges = spark.createDataFrame([("a", 1, 3), ("a", 1, 4), ("b", 1, 1)], "run_id string, steps long, cost long")
    caps = spark.createDataFrame([("a", 5), ("b", 5)], "run_id string, cost_cap long")
    assert {r.run_id: (r.steps, r.cost, r.cost_used) for r in folds.usage_totals(charges, caps).collect()} == {"a": (2, 7, 5), "b": (1, 1, 1)}


def test_gate_needs_runs(spark):
    none = spark.createDataFrame([], "run int, passed boolean")
    assert score.gate(none).first().passed is False
    assert score.gate(spark.createDataFrame([(1, True), (2, True), (3, True)], "run int, passed boolean")).first().passed is True
    assert score.gate(spark.createDataFrame([(1, True), (2, False), (3, True)], "run int, passed boolean")).first().passed is False


def test_allowlist(spark):
    urls = spark.createDataFrame([(1, "https://a.b/v1/x"), (2, "https://a.b:443/v1"), (3, "https://u@a.b/v1"), (4, "ftp://a.b"), (5, "https://a.b/v12"), (6, "https://x.openrouter.ai/v1"), (7, "https://a.b:99999/v1"), (8, None)], "id int, url string")
    allowed = spark.createDataFrame([("https://A.b/v1/",)], "url string")
    assert {r.id: r.verdict for r in compat.url_audit(urls, allowed, "id").collect()} == {1: "allowed", 2: "allowed", 3: "malformed", 4: "malformed", 5: "not_allowed", 6: "denied", 7: "malformed", 8: "malformed"}


def test_fixture_is_read_strictly(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text('{"tables": [{"name": "t", "row_count": 3, "columns": [{"name": "c", "data_type": "text", "semantic_type": "email", "null_ratio": "0", "distinct_ratio": "1", "masked_samples": [], "expected": ["pii"]}]}]}')
    assert sources.load_fixture(spark, str(good)).first().expected == ["pii"]
    bad = tmp_path / "bad.json"
    bad.write_text("{")
    with pytest.raises(Exception):
        sources.load_fixture(spark, str(bad)).collect()


def test_classifier_surface(spark):
    found = profile.profile(spark.createDataFrame([(f"u{i}@site{i}.org", i, f"{i:04d}") for i in range(9)], "email string, amount int, email_hash string")).withColumn("table_name", F.lit("t"))
    labels = {r.column_name: r.labels for r in classify.classify(found).collect()}
    assert labels == {"email": ["pii"], "amount": ["financial"], "email_hash": ["none"]}
    flat = found.select("table_name", "name")
    own = classify.classify_with(flat, lambda pdf: pdf.assign(label="x"), "table_name string, name string, label string")
    assert own.count() == 3


def test_profile_uses_one_frequency_exchange(spark, data):
    plan = profile.raw_counts(spark.read.parquet(f"{data}/orders.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(ordinal") <= 2 and "Python" not in plan


def frequency_exchanges(df):
    """Exchanges of value counts that a plan runs, without those that it reads again."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return sum("Exchange hashpartitioning(ordinal" in line and ", short" in line and "ReusedExchange" not in line for line in plan.splitlines())


def test_profiles_count_values_once(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    assert frequency_exchanges(profile.profile(events)) == 1
    state = profile.State(spark, str(tmp_path / "state"), events.schema)
    state.add(events, 0)
    assert frequency_exchanges(state.profile()) == 1


def test_estate_has_the_profiles_of_its_tables(spark, data):
    long = spark.createDataFrame([(1, "x" * 300 + "a"), (2, "x" * 300 + "a"), (3, "x" * 300 + "b"), (4, None)], "id int, text string")
    tables = {"long": long, "empty": long.limit(0), "supplier": spark.read.parquet(f"{data}/supplier.parquet")}
    whole = profile.profile_estate(tables)
    for name, df in tables.items():
        assert whole.filter(F.col("table_name") == name).drop("table_name").collect() == profile.profile(df).collect()
    assert [profile.may_be_long(f.dataType) for f in long.schema] == [False, True]


def rows_of(df):
    plain = lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else v.item() if hasattr(v, "item") and not isinstance(v, pd.Timestamp) else v
    frame = df[sorted(df.columns)]
    return sorted((tuple(plain(plain(v)) for v in r) for r in frame.itertuples(index=False, name=None)), key=str)


QUICK = ["a2_filter_schemas", "b6_cursors", "c2_counts_customer", "c9_profile_customer", "c9_profile_documents", "d12_mask_pages_url", "e1_asset_changes", "e4_column_changes", "e8_apply", "f2_record", "g3_proposal_problems", "g8_judge_reviews", "g13_details", "h4_verdicts", "i3_clamped_usage", "j2_compat_verdicts", "k2_stream_usage", "l5_retrieval_metrics"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, data, name):
    connection = duckdb.connect()
    for t in inputs.TABLES:
        path = f"{data}/{t}.parquet"
        connection.sql(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    ours, theirs = estate.queries()[name](spark, data).toPandas(), connection.sql(estate.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_kappa_and_rules(spark):
    pairs = spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 0)], "a int, b int")
    assert quality.kappa(pairs, "a", "b").first().kappa == 0.5
    assert {r.rule: r.failed for r in quality.rules(pairs, {"a_is_one": F.col("a") == 1}).collect()} == {"a_is_one": 2}
