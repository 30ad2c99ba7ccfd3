"""Streams over several batches, drift, dense retrieval, nested schemas, snapshots and replayed decisions, against brute force."""

import math
import random
from collections import defaultdict
from decimal import Decimal

import pytest
import test_estate
from pyspark.sql import functions as F
from test_whole import DECISION

from lakewarden.operators import compat, dense, drift, ledger, order, profile, quality, review
from lakewarden.plans import estate_depth
from lakewarden.sources import catalog as sources
from lakewarden.sources import inspector, snapshot
from lakewarden.streaming import folds, streams

# The queries against their SQL


@pytest.mark.parametrize("name", sorted(n for n in estate_depth.SQL_DEPTH if not n.startswith(("k1", "k4", "l10", "a6"))))  # those are tested below, and slow
def test_query_equals_its_sql(spark, data, name):
    test_estate.test_query_equals_its_sql(spark, data, name)


# Streams


def folded(spark, batches, **options):
    """What fold_tasks gives for batches of (task_id, state, attempts, second, seq), each a drain of its own."""
    home = streams.folder(spark, "fold")
    for rows in batches:
        df = spark.createDataFrame(rows, "task_id long, state string, attempts long, s long, seq long")
        df.write.mode("append").parquet(f"{home}/source")
        stream = spark.readStream.schema(df.schema).parquet(f"{home}/source").select("task_id", "state", "attempts", F.timestamp_seconds("s").alias("at"), "seq")
        write = lambda out, batch: out.write.mode("overwrite").parquet(f"{home}/rows/batch={batch}")
        with folds.rocks(spark):
            query = folds.fold_tasks(stream, **options).writeStream.outputMode("update").option("checkpointLocation", f"{home}/state").foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
    return sorted((r.task_id, r.s, r.state, r.attempts) for r in spark.read.schema(folds.TASK).parquet(f"{home}/rows").select("task_id", F.unix_seconds("at").alias("s"), "state", "attempts").collect())


def test_an_ended_task_stays_ended(spark):
    found = folded(spark, [[(1, "running", 1, 990, 0), (1, "done", 1, 1000, 0), (2, "pending", 0, 1000, 0)], [(1, "running", 1, 995, 0), (1, "running", 1, 1005, 0), (2, "running", 1, 1010, 0)]], lease_ms=10**8, delay="30 seconds", keep_ms=60_000)
    assert found == [(1, 990, "running", 1), (1, 1000, "done", 1), (2, 1000, "pending", 0), (2, 1010, "running", 1)]


@pytest.mark.parametrize("shards", [1, 3])
def test_tasks_share_a_shard(spark, shards):
    rng = random.Random(shards)
    kinds = ("claimed", "running", "running", "pending", "done", "failed")
    rows = [(rng.randrange(12), rng.choice(kinds), rng.randrange(5), 1000 + 7 * i, i) for i in range(150)]
    last = (99, "pending", 0, 4000, 999)
    found = folded(spark, [rows[:60], [*rows[60:], rows[100]], [last]], lease_ms=90_000, keep_ms=10**9, shards=shards)
    assert found == sorted([*plain_fold(rows, 90, 4000), (99, 4000, "pending", 0)])


def test_runs_share_a_shard(spark):
    rng = random.Random(5)
    charges = [(rng.randrange(6), i, i, 1, rng.randrange(9), Decimal(rng.randrange(500)) / 100, i % 5) for i in range(90)]
    caps = [(r, 8 + r, 40 + r, Decimal(20 + r)) for r in range(6)]
    budgets, home = spark.createDataFrame(caps, "run_id long, steps_cap long, tokens_cap long, cost_cap decimal(20,6)"), streams.folder(spark, "clamp")
    for part in (charges[:40], charges[40:45], charges[45:]):
        df = spark.createDataFrame(part, "run_id long, task_id long, seq long, steps long, tokens long, cost decimal(18,8), wall_clock long")
        df.write.mode("append").parquet(f"{home}/source")
        with folds.rocks(spark):
            query = folds.clamp_usage(spark.readStream.schema(df.schema).parquet(f"{home}/source"), budgets, shards=1).writeStream.format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    sums, expected = defaultdict(lambda: [0, 0, 0, 0]), []
    for run, _, seq, *given in charges:
        used, cap = sums[run], caps[run][1:]
        now = [*(min(u + x, c) for u, x, c in zip(used, given, cap, strict=False)), used[3] + given[3]]
        expected.append((run, seq, *(y for d in range(3) for y in (now[d], now[d] - used[d], given[d] - now[d] + used[d])), now[3]))
        sums[run] = now
    assert sorted(tuple(r) for r in spark.read.parquet(f"{home}/rows").select("run_id", "seq", *(f"{d}_{x}" for d in folds.CAPPED for x in ("used", "applied", "over")), "wall_clock_used").collect()) == sorted(expected)


def plain_fold(rows, lease, watermark):
    out = []
    for task in sorted({r[0] for r in rows}):
        own, held = sorted((r for r in rows if r[0] == task), key=lambda r: (r[3], r[4])), None
        for _, state, attempts, at, _ in [*own, (task, None, None, watermark, None)]:
            if held and held[0] in folds.LEASED and at > held[2] + lease:
                held = ("dead" if held[1] >= 3 else "pending", held[1], held[2] + lease)
                out.append((task, held[2], held[0], held[1]))
            if state and not (held and held[0] in folds.ENDED):
                held = (state, attempts, at)
                out.append((task, at, state, attempts))
    return sorted(out)


def test_batches_do_not_matter(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(6), rng.choice(["running", "claimed", "pending", "running", "done", "failed"][: 4 if rng.random() < 0.8 else 6]), rng.randrange(5), 1000 + 7 * i, i) for i in range(60)]
    wanted = plain_fold(rows, 50, rows[-1][3])
    assert {"dead", "pending"} <= {r[2] for r in wanted}
    for cuts in ([], [20, 40], [5, 30, 31]):
        ends = [0, *cuts, len(rows)]
        assert folded(spark, [rows[a:b] for a, b in zip(ends, ends[1:], strict=False)], lease_ms=50_000, keep_ms=10**9) == wanted


def test_clamped_charges_of_several_batches(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), i, i // 2, rng.randrange(4), rng.randrange(100), Decimal(rng.randrange(10**7)) / 10**7, rng.randrange(9)) for i in range(120)]
    charges = spark.createDataFrame(rows, "run_id long, task_id long, seq long, steps long, tokens long, cost decimal(14,8), wall_clock long")
    caps = spark.createDataFrame([(r, 40, 900 + r, Decimal("12.5")) for r in range(3)], "run_id long, steps_cap long, tokens_cap long, cost_cap decimal(14,6)")

    def drain(stream, home):
        with folds.rocks(spark):
            query = folds.clamp_usage(stream, caps).writeStream.format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    home = streams.fed(charges, "seq", 4, "charges", drain)
    found, wanted = spark.read.parquet(f"{home}/rows"), ledger.clamped(charges, caps)
    plain = lambda df: sorted(tuple(float(r[c]) for c in sorted(wanted.columns)) for r in df.collect())
    assert plain(found) == plain(wanted) and any(r.steps_over for r in found.collect())


def test_late_rows_count_while_their_window_is_open(spark):
    hour = lambda h, m: F.timestamp_seconds(F.lit(1_700_006_400 + 3600 * h + 60 * m))
    home = streams.folder(spark, "late")
    for batch in ([(0, 5), (0, 50)], [(1, 20)], [(0, 10), (1, 10), (0, 59)], [(5, 0)]):  # the third batch: 0:10 and 0:59 are late, the first hour is closed at 1:10
        df = spark.range(1).select(F.explode(F.array(*(hour(*x) for x in batch))).alias("at"), F.lit("dead").alias("state"), F.lit(3).alias("age_seconds"))
        df.write.mode("append").parquet(f"{home}/source")
        stream = spark.readStream.schema(df.schema).parquet(f"{home}/source")
        folds.health(stream, delay="10 minutes").writeStream.format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    assert [(r.events, r.dead) for r in spark.read.parquet(f"{home}/rows").orderBy("start").collect()] == [(2, 2), (2, 2)]


# The profile's state


def test_state_of_batches_is_the_profile_of_all_rows(spark):
    rng = random.Random(8)
    long = "x" * 300
    rows = [(rng.choice([None, *range(12)]), rng.choice(["a", "b", None, long + "a", long + "b"]), float(rng.randrange(5)), [rng.randrange(3)]) for _ in range(200)]
    shape = "n int, v string, `odd``na.me` double, l array<int>"
    df = spark.createDataFrame(rows, shape)
    part = lambda a, b: spark.createDataFrame(rows[a:b], shape)
    state = profile.State(spark, streams.folder(spark, "state"), df.schema)
    wanted = profile.flat(profile.profile(df)).collect()
    for i, (a, b) in enumerate(((0, 90), (90, 90), (90, 140))):
        state.add(part(a, b), i)
    state.compact(before=2)
    state.add(part(140, 150), 3)
    state.add(part(140, 200), 3)  # the same batch once more, whole now
    assert profile.flat(state.profile()).collect() == wanted
    again = profile.State(spark, state.path, df.schema)
    assert again.generation == 1 and profile.flat(again.profile()).collect() == wanted
    again.compact(before=4)
    assert profile.flat(again.profile()).collect() == wanted
    empty = profile.State(spark, streams.folder(spark, "state"), df.schema)
    empty.add(df.limit(0), 0)
    assert profile.flat(empty.profile()).collect() == profile.flat(profile.profile(df.limit(0))).collect()


# Order and drift


def test_running_sums(spark):
    rows = [(i, i % 7, -i) for i in range(300)]
    random.Random(1).shuffle(rows)
    found = {r.k: (r.run_a, r.run_b) for r in order.running(spark.createDataFrame(rows, "k int, a int, b int").repartition(3), "k", "a", "b").collect()}
    a = b = 0
    for k, x, y in sorted(rows):
        a, b = a + x, b + y
        assert found[k] == (a, b)
    assert order.running(spark.createDataFrame([], "k int, a int"), "k", "a").collect() == []


def plain_drift(base, now, bins=10):
    base, now = (sorted((x for x in v if x is not None), key=lambda x: (math.isnan(x), x)) for v in (base, now))
    if not base or not now:
        return None, None
    upto = lambda v, x: sum(1 for y in v if not math.isnan(y) and (math.isnan(x) or y <= x) or math.isnan(y) and math.isnan(x))
    ks = max(abs(upto(base, x) / len(base) - upto(now, x) / len(now)) for x in base + now)
    edges = sorted({base[math.ceil(len(base) * q / bins) - 1] for q in range(1, bins)}, key=lambda x: (math.isnan(x), x))
    counts = [[upto(v, e) for e in edges] + [len(v)] for v in (base, now)]
    held = [[max(b - a, 0) for a, b in zip([0, *c], c, strict=False)] for c in counts]
    pairs = [(x or 0.5, y or 0.5) for x, y in zip(*held, strict=True) if x or y]
    p, q = (sum(v) for v in zip(*pairs, strict=True))
    return ks, sum((y / q - x / p) * math.log((y / q) / (x / p)) for x, y in pairs)


@pytest.mark.parametrize("kind", ["apart", "ties", "nan", "few", "same"])
def test_drift_equals_brute_force(spark, kind):
    rng = random.Random(kind)
    draw = {
        "apart": lambda s: rng.gauss(s, 1), "ties": lambda s: float(rng.randrange(3 + s)), "nan": lambda s: rng.choice([float("nan"), None, rng.random()]),
        "few": lambda s: float(s), "same": lambda s: 1.0,
    }[kind]
    base, now = ([draw(s) for _ in range(n)] + [None] for s, n in ((0, 150), (1, 90)))
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "v double")
    values = drift.counted(frame(base), frame(now), "v")
    ks, psi = plain_drift(base, now)
    found = drift.distance(values).first()
    assert (found.n_base, found.n_now) == (sum(x is not None for x in base), sum(x is not None for x in now))
    assert found.ks == pytest.approx(ks, abs=2e-9) and drift.stability(values).first().psi == pytest.approx(psi, abs=2e-6)


def test_drift_of_nothing(spark):
    some, none = spark.createDataFrame([(1.0,)], "v double"), spark.createDataFrame([(None,)], "v double")
    for base, now in ((some, none), (none, some), (none, none)):
        values = drift.counted(base, now, "v")
        assert drift.stability(values).first().psi is None
        assert len(drift.distance(values).collect()) == 1 and drift.distance(values).first().ks is None


def test_freshness(spark):
    rows = spark.createDataFrame([("a", 100), ("a", 50), ("b", 10), ("c", None)], "k string, s long").select("k", F.timestamp_seconds("s").alias("at"))
    found = {r.k: (r.age_seconds, r.fresh) for r in quality.freshness(rows, "at", F.timestamp_seconds(F.lit(130)), 60, "k").collect()}
    assert found == {"a": (30, True), "b": (120, False), "c": (None, False)}
    assert quality.freshness(rows.limit(0), "at", F.timestamp_seconds(F.lit(130)), 60).first().fresh is False


# Dense retrieval


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 4)
    rng = random.Random(9)
    vectors = {i: [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(rng.choice([3, 3, 3, 4]))] for i in range(80)}
    odd = [(900, None), (None, [1.0, 0.0, 0.0]), (901, [float("nan"), 1.0, 1.0]), (902, [None, 1.0, 1.0]), (903, [0.0, 0.0, 0.0]), (904, []), (905, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    ranked = dense.nearest(df, df.filter("vec_id % 3 = 0"), 5)
    for r in ranked.orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.doc_id, pytest.approx(r.score, abs=2e-6)))
    norm = {i: math.sqrt(sum(x * x for x in v)) for i, v in vectors.items()}
    for q, v in vectors.items():
        near = [(i, round(sum(x * y for x, y in zip(v, w, strict=True)) / norm[q] / norm[i], 6)) for i, w in vectors.items() if i != q and len(w) == len(v) and norm[i]] if norm[q] and q % 3 == 0 else []
        assert found.get(q, []) == sorted(near, key=lambda x: (-x[1], x[0]))[:5]
    plan = ranked._jdf.queryExecution().toString()
    assert "Python" not in plan and "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert dense.nearest(df, df.limit(0), 5).collect() == []


@pytest.mark.parametrize(("wide", "broadcast", "first"), [(512, 4_000_000, 2), (3, 4_000_000, 2), (512, 0, 3)])
def test_nearest_by_products_of_columns(spark, monkeypatch, wide, broadcast, first):
    """Longer vectors than columns are made of, queries that are not broadcast, and scores that no answer is below: all give the same."""
    for name, value in (("WIDE", wide), ("BROADCAST", broadcast), ("FIRST", first), ("BLOCK", 7)):
        monkeypatch.setattr(dense, name, value)
    rng = random.Random(5)
    vectors = {i: [rng.choice([-1.0, 0.5, 2.0, 3.0]) for _ in range(rng.choice([3, 5]))] for i in range(120)}
    df = spark.createDataFrame([*vectors.items()], "vec_id long, embedding array<double>")
    ranked = dense.nearest(df, df.filter("vec_id % 4 = 0"), 3)
    joins = [line for line in ranked._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joins and (wide == 3 or not any("lambdafunction" in line for line in joins))
    found = defaultdict(list)
    for r in ranked.orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.doc_id, pytest.approx(r.score, abs=2e-6)))
    cosine = lambda v, w: round(sum(x * y for x, y in zip(v, w, strict=True)) / math.sqrt(sum(x * x for x in v)) / math.sqrt(sum(y * y for y in w)), 6)
    for q in range(0, 120, 4):
        near = [(i, cosine(vectors[q], w)) for i, w in vectors.items() if i != q and len(w) == len(vectors[q])]
        assert found[q] == sorted(near, key=lambda x: (-x[1], x[0]))[:3]


# Nested schemas

FIELD = "model string, field string, type string, required boolean, vals array<string>, ref string"


def flat(spark, fields, roots):
    return compat.flatten(spark.createDataFrame([(m, f, t, False, None, r) for m, f, t, r in fields], FIELD), spark.createDataFrame([(r,) for r in roots], "subject string"))


def test_circles_and_unknown_models(spark):
    fields = [("a", "x", "object", "b"), ("b", "y", "object", "a"), ("b", "z", "object", "b"), ("b", "w", "string", None), ("b", "q", "object", "nowhere")]
    found = {(r.model, r.path) for r in flat(spark, fields, ["a", "b", "alone"]).filter("subject = 'a'").collect()}
    assert found == {(None, "/properties/x"), *(("b", f"/$defs/b/properties/{f}") for f in "yzwq"), ("nowhere", None)}
    assert [r.path for r in flat(spark, fields, ["alone"]).collect()] == [None]


def test_a_removed_model_is_told_from_a_removed_field(spark):
    old = flat(spark, [("a", "x", "object", "b"), ("a", "k", "string", None), ("b", "y", "object", "c"), ("b", "w", "string", None), ("c", "v", "string", None)], ["a", "gone"])
    new = flat(spark, [("a", "x", "object", "b"), ("a", "k", "integer", None), ("b", "y", "string", None)], ["a"])
    assert sorted(map(tuple, compat.nested_breaks(old, new).collect())) == [("a", "/$defs/b/properties/w", "removed_field"), ("a", "/$defs/b/properties/y", "type_changed"), ("a", "/$defs/c", "removed_model"), ("a", "/properties/k", "type_changed")]
    assert compat.nested_breaks(old, old).isEmpty()


# Replays


def answers(decisions, proposals):
    """id: (verdict, settled_by, outcome), one request at a time: a key that has settled one is looked up first."""
    asset, version = {p: a for p, a, _, _ in proposals}, {p: v for p, _, v, _ in proposals}
    used, done, standing, out = {}, set(), {}, {}
    for d in sorted(decisions, key=lambda d: (d[8], d[0])):
        name, proposal, outcome, key, request = d[0], d[1], d[2], d[7], d[1:7]
        if key is not None and key in used:
            first, before = used[key]
            out[name] = ("replayed", first, outcome) if before == request else ("key_conflict", None, None)
        elif proposal in done:
            out[name] = ("not_pending", None, None)
        elif outcome == "approve" and version[proposal] <= standing.get(asset[proposal], 0):
            out[name] = ("newer_version_stands", None, None)
        else:
            out[name] = ("accepted", name, outcome)
            done.add(proposal)
            if outcome == "approve":
                standing[asset[proposal]] = version[proposal]
            if key is not None:
                used[key] = name, request
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_replays_are_told_the_first_outcome(spark, seed):
    draw = random.Random(seed)
    proposals = [(p, p % 4, p // 4 + 1, 1) for p in range(40)]
    decisions = []
    for i in range(160):
        if decisions and draw.random() < 0.3:
            decisions.append((f"d{i:03}", *draw.choice(decisions)[1:8], i // 2))
        else:
            decisions.append((f"d{i:03}", draw.randrange(40), draw.choice(["approve", "approve", "reject"]), "human", "x", None, draw.choice("rs"), draw.choice([None, *(f"k{k}" for k in range(20))]), i // 2))
    states = spark.createDataFrame([(a, True, 1) for a in range(4)], "asset_id long, active boolean, latest_version long")
    ours = spark.createDataFrame(proposals, "proposal_id long, asset_id long, version long, profile_version long")
    told = review.answered(*review.settle_keys(spark.createDataFrame(decisions, DECISION), ours, states))
    wanted = answers(decisions, proposals)
    assert {r.id: (r.verdict, r.settled_by, r.outcome) for r in told.collect()} == wanted
    assert {"replayed", "key_conflict", "accepted"} <= {v for v, _, _ in wanted.values()}


# Snapshots


def test_replays_are_known_since_keys_were_settled(spark):
    """Answers read what is judged once: no join finds the first of a replay."""
    draw = random.Random(3)
    proposals = [(p, p % 4, p // 4 + 1, 1) for p in range(20)]
    decisions = []
    for i in range(80):
        if decisions and draw.random() < 0.4:
            decisions.append((f"d{i:03}", *draw.choice(decisions)[1:8], i // 2))
        else:
            decisions.append((f"d{i:03}", draw.randrange(20), draw.choice(["approve", "reject"]), "human", "x", None, draw.choice("rs"), draw.choice([None, *(f"k{k}" for k in range(8))]), i // 2))
    states = spark.createDataFrame([(a, True, 1) for a in range(4)], "asset_id long, active boolean, latest_version long")
    ours = spark.createDataFrame(proposals, "proposal_id long, asset_id long, version long, profile_version long")
    judged, refused = review.settle_keys(spark.createDataFrame(decisions, DECISION), ours, states)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    told = review.answered(judged, refused)
    assert joins(told) <= joins(judged) + joins(refused)
    expected = {d: first for d, (verdict, first, _) in answers(decisions, proposals).items() if verdict == "replayed"}
    assert expected and {r.id: r.repeats for r in judged.filter("repeats is not null").collect()} == expected
    assert {r.id: r.settled_by for r in told.filter("verdict = 'replayed'").collect()} == expected


def test_a_snapshot_is_one_table_for_all_passes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    taken = snapshot.Snapshot(spark, path)
    spark.range(10, 30).write.mode("append").parquet(path)  # between two passes
    found = snapshot.profile_snapshot(taken).collect()[0]
    assert (found.row_count, found.distinct_count) == (10, 10) and spark.read.parquet(path).count() == 30
    assert taken.manifest().count() == len(taken.files)
    assert snapshot.profile_snapshot(snapshot.Snapshot(spark, path)).collect()[0].row_count == 30


def test_a_changed_snapshot_is_refused(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(10).coalesce(1).write.parquet(str(path))
    taken = snapshot.Snapshot(spark, str(path))
    (file,) = path.glob("*.parquet")
    file.write_bytes(file.read_bytes() + b"x")
    with pytest.raises(snapshot.Changed):
        taken.check()
    file.unlink()
    with pytest.raises(snapshot.Changed):
        taken.check()
    with pytest.raises(FileNotFoundError):
        snapshot.Snapshot(spark, str(path))


# Leaks


def test_leaks_in_columns_of_any_type(spark):
    df = spark.sql("select * from values (1, 'ab 12', array('x', 'secret'), timestamp_ntz'2024-05-06 07:08:09', 1.5D, map('k', 'v9')), (12, null, null, null, null, null), (3, 'ab', array(), null, 12.25D, null) as t(n, s, l, at, d, m)")
    tokens = spark.createDataFrame([("12",), ("ab",), ("secret",), ("2024-05",), ("v9",), ("none",), ("12",), (None,), ("1.5",)], "token string")
    found = {r.token: r.rows for r in quality.leaks(df, tokens, "t").collect()}
    assert found == {"12": 3, "ab": 2, "secret": 1, "2024-05": 1, "v9": 1, "1.5": 1}
    numbers = spark.createDataFrame([(7, 8.5)], "a int, b double")
    assert [tuple(r) for r in quality.leaks(numbers, tokens.union(spark.createDataFrame([("8.5",)], "token string")), "u").collect()] == [("8.5", "u", 1)]
    assert quality.leaks(df.limit(0), tokens, "t").collect() == []


# Inspectors


def test_schemas_are_inspected_on_executors(spark, tmp_path):
    spark.sql("select 1 as a, 'x' as b, array(1.5D) as c, timestamp_ntz'2024-01-01 00:00:00' as d, cast(1 as decimal(9,2)) as e, named_struct('k', 1L) as s, map('a', true) as m").write.parquet(str(tmp_path / "sales" / "orders"))
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "plain"))
    (tmp_path / "staging").mkdir()
    next((tmp_path / "plain").glob("*.parquet")).rename(tmp_path / "staging" / "ids.parquet")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = inspector.inspect(spark, path=str(tmp_path))
    wanted = sources.scan({("sales", "orders"): spark.read.parquet(str(tmp_path / "sales" / "orders")), ("staging", "ids"): spark.read.parquet(str(tmp_path / "staging" / "ids.parquet"))})
    key = lambda r: tuple(r)[:6]  # noqa: E731  nullability is the file's own here
    assert sorted(map(key, found.collect())) == sorted(map(key, wanted.collect()))
    assert found.rdd.getNumPartitions() == len([s for s in tmp_path.iterdir()])
    one = found.filter("schema_name = 'staging'")
    assert one.rdd.getNumPartitions() == 1 and [r.column_name for r in one.collect()] == ["id"]
    assert found.filter("schema_name in ('sales', 'none') and ordinal > 6").count() == 1
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert inspector.inspect(spark, path=str(tmp_path)).filter("schema_name = 'staging'").count() == 1


def test_inspectors_are_pluggable(spark):
    class Fixed(inspector.SchemaInspector):
        """Another inspector: a list of tables."""

        @classmethod
        def name(cls):
            return "fixed_schemas"

        def inspector(self):
            class Listed:
                def schemas(self):
                    return ["a", "b"]

                def tables(self, schema):
                    yield f"t_{schema}", "view", [("x", "int", 1, True)]
                    yield "empty", "table", []

            return Listed()

    found = sorted(map(tuple, inspector.inspect(spark, Fixed).collect()), key=str)
    assert found == [("a", "empty", "table", None, None, None, None), ("a", "t_a", "view", "x", "int", 1, True), ("b", "empty", "table", None, None, None, None), ("b", "t_b", "view", "x", "int", 1, True)]
