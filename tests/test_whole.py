"""Whole results where an earlier form did less than the whole job."""

import math
import random
import re
from collections import Counter

import pytest
import test_estate
from pyspark.sql import functions as F

from lakewarden.operators import quality, review, score
from lakewarden.plans import estate


def brute_bm25(docs, queries, k, k1=1.2, b=0.75):
    counts = {d: Counter(words) for d, words in docs.items()}
    mean, df = sum(map(len, docs.values())) / len(docs), Counter(w for c in counts.values() for w in c)
    out = []
    for q, words in queries.items():
        scores = {}
        for d, c in counts.items():
            hits = [math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * len(docs[d]) / mean)) for w in set(words) if c[w]]
            if hits:
                scores[d] = sum(hits)
        out += [(q, d, s, i + 1) for i, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k])]
    return out


def test_bm25_against_brute_force(spark, tmp_path):
    docs = {1: "The cat sat on a mat, the end", 2: "A dog ran; the cat ran", 3: "extraordinary catalogues", 4: "mat mat mat", 5: "... !"}
    queries = {10: "the cat", 11: "a mat on extraordinary mat", 12: "dog", 13: "nothing here"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(queries.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = estate.queries()["l2_bm25"](spark, str(tmp_path)).orderBy("query_id", "rank").collect()
    split = lambda texts: {k: [w for w in re.split(r"\W+", t.lower()) if w] for k, t in texts.items()}
    wanted = brute_bm25(split(docs), split(queries), 5)
    assert [(r.query_id, r.doc_id, r["rank"]) for r in found] == [(q, d, i) for q, d, _, i in wanted]
    assert all(abs(r.score - s) < 2e-6 for r, (_, _, s, _) in zip(found, wanted, strict=True))


def test_bm25_is_the_same_without_broadcast(spark, monkeypatch):
    split = lambda c: F.split(c, " ").alias("tokens")
    docs = spark.createDataFrame([(1, "a b c"), (2, "a a"), (3, "c")], "doc_id long, t string").select("doc_id", split("t"))
    queries = spark.createDataFrame([(7, "a c"), (8, "b")], "query_id long, t string").select("query_id", split("t"))
    small = sorted(map(tuple, quality.bm25(docs, queries, 3).collect()))
    monkeypatch.setattr(quality, "POSTINGS", 0)
    assert sorted(map(tuple, quality.bm25(docs, queries, 3).collect())) == small


DECISION = "id string, proposal_id long, outcome string, actor_kind string, actor_id string, policy_id string, reason string, idempotency_key string, decided_at long"


def replayed(decisions, proposals):
    """id: verdict, one decision at a time; every asset is active and every profile the latest."""
    asset, version = {p: a for p, a, _, _ in proposals}, {p: v for p, _, v, _ in proposals}
    used, done, standing, out = {}, set(), {}, {}
    for d in sorted(decisions, key=lambda d: (d[8], d[0])):
        name, proposal, outcome, key, request = d[0], d[1], d[2], d[7], d[1:7]
        if key in used and used[key] != request:
            out[name] = "key_conflict"
        elif proposal in done:
            out[name] = "not_pending"
        elif outcome == "approve" and version[proposal] <= standing.get(asset[proposal], 0):
            out[name] = "newer_version_stands"
        else:
            out[name] = "accepted"
            done.add(proposal)
            if outcome == "approve":
                standing[asset[proposal]] = version[proposal]
            if key is not None:
                used.setdefault(key, request)
    return out


def settled(spark, decisions, proposals):
    states = spark.createDataFrame([(a, True, 1) for a in sorted({p[1] for p in proposals})], "asset_id long, active boolean, latest_version long")
    ours = spark.createDataFrame(proposals, "proposal_id long, asset_id long, version long, profile_version long")
    judged, refused = review.settle_keys(spark.createDataFrame(decisions, DECISION), ours, states)
    rows = [(r.id, r.verdict) for r in judged.collect()] + [(r.id, r.why) for r in refused.collect()]
    assert len(rows) == len(decisions)
    return dict(rows)


def test_keys_settle_through_a_long_chain(spark):
    decision = lambda i, p, key: (f"d{i:03}", p, "approve", "human", "x", None, "r", key, i)
    proposals, decisions = [(1, 0, 1, 1)], [decision(0, 1, "k0")]
    for i in range(8):  # dropping the newer version's approval lets the older one use the next key
        proposals += [(10 * i + 12, i + 1, 2, 1), (10 * i + 11, i + 1, 1, 1)]
        decisions += [decision(2 * i + 1, 10 * i + 12, f"k{i}"), decision(2 * i + 2, 10 * i + 11, f"k{i + 1}")]
    wanted = replayed(decisions, proposals)
    assert sum(v == "key_conflict" for v in wanted.values()) == 8
    assert settled(spark, decisions, proposals) == wanted


def test_keys_settle_as_one_by_one(spark):
    draw = random.Random(5)
    proposals = [(p, p % 4, p // 4 + 1, 1) for p in range(40)]
    decisions = [(f"d{i:03}", draw.randrange(40), draw.choice(["approve", "approve", "reject"]), "human", "x", None, "r", draw.choice([None, *(f"k{k}" for k in range(12))]), i // 2) for i in range(150)]
    wanted = replayed(decisions, proposals)
    assert settled(spark, decisions, proposals) == wanted and {"key_conflict", "accepted"} <= set(wanted.values())


def test_runs_disagree_on_confidence_and_citations(spark):
    schema = "run int, table_name string, column_name string, labels array<string>, confidence int, citations array<struct<kind: string, locator: string>>"
    a, b = ("data_type", "text"), ("semantic_type", "email")
    answers = {"same": [(80, [a, b]), (80, [b, a])], "confidence": [(80, [a]), (70, [a])], "cited": [(80, [a]), (80, [b])], "uncited": [(80, [a]), (80, None)], "null": [(None, [a]), (80, [a])]}
    rows = [(i, "t", name, ["pii"], *x) for name, two in answers.items() for i, x in enumerate(two)]
    found = score.disagreements(spark.createDataFrame(rows, schema)).collect()
    assert {r.column_name for r in found} == {"confidence", "cited", "uncited", "null"}


def test_bad_citations_fail_runs(spark, data):
    found = {name: estate.queries()[name](spark, data).collect() for name in ("h1_evidence_failures", "h4_verdicts_on_evidence")}
    assert {r.run for r in found["h1_evidence_failures"] if r.failures} == {2}
    assert {r.run for r in found["h4_verdicts_on_evidence"] if "unresolved_evidence" in r.reasons} == {2}


EVIDENT = ["h1_evidence_failures", "h4_verdicts_on_evidence", "h5_gate_on_evidence", "h6_disagreements_on_evidence", "h6_disagreements"]


@pytest.mark.parametrize("name", EVIDENT)
def test_evidence_queries_equal_their_sql(spark, data, name):
    test_estate.test_query_equals_its_sql(spark, data, name)


def test_only_contested_decisions_are_settled_in_rounds(spark):
    make = lambda i, p, outcome, key, day: (i, p, outcome, "human", "x", None, "r", key, day)
    decisions = [make("a", 1, "reject", None, 1), make("b", 1, "reject", "k", 2), make("c", 2, "approve", None, 3), make("d", 3, "approve", "k", 4), make("e", 4, "reject", "k", 5), make("f", 5, "reject", None, 6)]
    ours = spark.createDataFrame([(1, 7, 1, 1), (2, 7, 9, 1), (3, 7, 8, 1), (4, 8, 1, 1), (5, 8, 2, 1)], "proposal_id long, asset_id long, version long, profile_version long")
    states = spark.createDataFrame([(7, True, 1), (8, True, 1)], "asset_id long, active boolean, latest_version long")
    kept = review.contested(spark.createDataFrame(decisions, DECISION), ours, states)
    assert sorted(r.id for r in kept.collect()) == ["c", "e"]


def test_only_sound_approvals_meet_by_asset(spark):
    decisions = spark.createDataFrame([("a", 1, "reject", "human", "x", None, "r", None, None)], DECISION)
    ours = spark.createDataFrame([(1, 7, 1, 1)], "proposal_id long, asset_id long, version long, profile_version long")
    states = spark.createDataFrame([(7, True, 1)], "asset_id long, active boolean, latest_version long")
    plan = review.judge(decisions, ours, states)._jdf.queryExecution().optimizedPlan().toString()
    by_asset = [line for line in plan.splitlines() if "Window [" in line and ", [asset_id#" in line]
    assert len(by_asset) == 1
