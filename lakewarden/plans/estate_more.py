"""Registered queries of classification, review, scoring, ledgers, compatibility, streams and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.operators import classify, compat, ledger, profile, quality, review, score
from lakewarden.plans import duck
from lakewarden.plans import inputs as I
from lakewarden.plans.estate import Query, doubles, profile_sql, table, with_inputs
from lakewarden.sources import catalog as sources
from lakewarden.streaming import folds, streams

QUERIES_MORE: dict[str, Query] = {}
SQL_MORE: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def keep(query: Query) -> Query:
        QUERIES_MORE[name] = query
        if sql:
            SQL_MORE[name] = sql
        return query

    return keep


# Classification


def proposals(spark, sf_dir) -> DataFrame:
    """A proposal for each order, its line items the columns."""
    rows = I.derive(
        spark, sf_dir,
        "SELECT l_orderkey AS proposal_id, l_orderkey % 4 AS profile_version, concat('c', l_linenumber) AS column_name, CASE l_partkey % 6 WHEN 0 THEN array['none', 'pii'] WHEN 1 THEN array['pii', 'pii'] WHEN 2 THEN array['pii'] WHEN 3 THEN array['financial', 'pii'] ELSE array['none'] END AS labels, "
        "CAST(l_discount * 12 AS DECIMAL(4,2)) AS confidence, l_partkey, l_suppkey FROM lineitem",
    )
    citation = F.struct((F.col("profile_version") + (F.col("l_suppkey") % 9 == 0).cast("int")).alias("profile_version"), F.when(F.col("l_suppkey") % 7 == 0, "c0").otherwise(F.col("column_name")).alias("column_name"), F.lit("column_name").alias("kind"), F.col("column_name").alias("locator"))
    evidence = F.when(F.col("l_suppkey") % 4 == 0, F.array().cast("array<struct<profile_version:bigint,column_name:string,kind:string,locator:string>>")).when(F.col("l_suppkey") % 11 == 0, F.array(citation, citation)).otherwise(F.array(citation))
    rows = rows.select("proposal_id", "profile_version", F.struct("column_name", "labels", "confidence", evidence.alias("evidence")).alias("c"))
    return rows.groupBy("proposal_id", "profile_version").agg(F.collect_list("c").alias("columns"))


_LINES = "SELECT l_orderkey AS proposal_id, l_orderkey % 4 AS profile_version, concat('c', l_linenumber) AS column_name, l_partkey % 6 AS k, CAST(l_discount * 12 AS DECIMAL(4,2)) AS confidence, l_suppkey AS s FROM lineitem"
_PROBLEMS = """concat_ws(',', CASE WHEN k = 1 THEN 'duplicate_label' END, CASE WHEN k = 0 THEN 'none_not_alone' END, CASE WHEN k < 4 AND s % 4 = 0 THEN 'sensitive_without_evidence' END,
CASE WHEN s % 4 <> 0 AND s % 11 = 0 THEN 'repeated_citation' END, CASE WHEN s % 4 <> 0 AND s % 7 = 0 THEN 'foreign_citation' END, CASE WHEN s % 4 <> 0 AND s % 9 = 0 THEN 'wrong_version' END, CASE WHEN confidence > 1 THEN 'bad_confidence' END)"""


_RULED = f"""p AS ({profile_sql('customer')}), n AS (SELECT name AS column_name, semantic_type, regexp_replace(lower(name), '^[a-z]_', '') AS n FROM p),
f AS (SELECT *, list_filter([{', '.join(f"CASE WHEN (regexp_matches(n, '{pattern}') AND NOT regexp_matches(n, '{classify.DERIVED}')) OR {kinds} THEN '{label}' END" for (label, pattern), kinds in zip(classify.NAME_RULES.items(), ("semantic_type IN ('email', 'phone', 'ip_address')", "false", "semantic_type = 'credit_card'"), strict=True))}], lambda x: x IS NOT NULL) AS labels FROM n)"""


@add("g1_rule_labels", f"WITH {_RULED} SELECT 'customer' AS table_name, column_name, CASE WHEN len(labels) > 0 THEN array_to_string(labels, ',') ELSE 'none' END AS labels, CASE WHEN semantic_type IN ('email', 'credit_card') THEN 0.95::DOUBLE WHEN len(labels) > 0 THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS confidence, CAST(CASE WHEN len(labels) > 0 THEN 2 ELSE 0 END AS INTEGER) AS citations FROM f")
def _g1(spark, sf_dir):
    found = profile.profile(table(spark, sf_dir, "customer")).withColumn("table_name", F.lit("customer"))
    labelled = classify.classify(found)
    return labelled.select("table_name", "column_name", F.array_join("labels", ",").alias("labels"), F.col("confidence").cast("double").alias("confidence"), F.size("evidence").alias("citations"))


@add("g2_label_problems", with_inputs(f"SELECT proposal_id, column_name, {_PROBLEMS} AS problems FROM l", l=_LINES))
def _g2(spark, sf_dir):
    return classify.column_problems(proposals(spark, sf_dir)).select("proposal_id", "column_name", F.array_join("problems", ",").alias("problems"))


@add("g3_proposal_problems", with_inputs(f"SELECT proposal_id, coalesce(string_agg(CASE WHEN n > 1 THEN column_name END, ',' ORDER BY column_name), '') AS repeated_columns, bool_and(n = 1 AND fine) AS valid FROM (SELECT proposal_id, column_name, count(*) AS n, bool_and({_PROBLEMS} = '') AS fine FROM l GROUP BY ALL) GROUP BY proposal_id", l=_LINES))
def _g3(spark, sf_dir):
    return classify.proposal_problems(proposals(spark, sf_dir)).select("proposal_id", F.array_join("repeated_columns", ",").alias("repeated_columns"), "valid")


@add("g4_sensitive_columns", with_inputs("SELECT proposal_id, CAST(count(CASE WHEN k < 4 THEN 1 END) AS INTEGER) AS n_sensitive, coalesce(string_agg(CASE WHEN k < 4 THEN column_name END, ',' ORDER BY column_name), '') AS sensitive FROM l GROUP BY proposal_id", l=_LINES))
def _g4(spark, sf_dir):
    return classify.sensitive_columns(proposals(spark, sf_dir)).select("proposal_id", "n_sensitive", F.array_join("sensitive", ",").alias("sensitive"))


_A = "SELECT l_orderkey AS asset_id, concat('c', l_partkey % 9) AS column_name FROM lineitem WHERE l_returnflag <> 'N'"
_B = "SELECT l_orderkey AS asset_id, concat('c', l_partkey % 9) AS column_name FROM lineitem WHERE l_linestatus = 'F'"


@add("g5_coverage", with_inputs("SELECT coalesce(a.asset_id, b.asset_id) AS asset_id, coalesce(string_agg(CASE WHEN a.asset_id IS NULL THEN b.column_name END, ',' ORDER BY b.column_name), '') AS missing, coalesce(string_agg(CASE WHEN b.asset_id IS NULL THEN a.column_name END, ',' ORDER BY a.column_name), '') AS unknown FROM (SELECT DISTINCT * FROM x) a FULL JOIN (SELECT DISTINCT * FROM y) b ON a.asset_id = b.asset_id AND a.column_name = b.column_name WHERE a.asset_id IS NULL OR b.asset_id IS NULL GROUP BY 1", x=_A, y=_B))
def _g5(spark, sf_dir):
    found = classify.coverage(I.derive(spark, sf_dir, _A), I.derive(spark, sf_dir, _B))
    return found.select("asset_id", F.array_join("missing", ",").alias("missing"), F.array_join("unknown", ",").alias("unknown"))


_FACTS = "SELECT o_custkey AS asset_id, CAST(1 AS BIGINT) AS version, concat('c', o_orderkey % 4) AS column_name, 'text' AS data_type, CAST(o_orderkey % 3 / 2.0 AS DECIMAL(7,6)) AS null_ratio, CAST(0.5 AS DECIMAL(7,6)) AS distinct_ratio, o_orderstatus AS semantic_type, array[o_orderpriority] AS samples FROM orders"
_CITED = "SELECT l_orderkey % 1500 AS asset_id, CAST(1 AS BIGINT) AS version, concat('c', l_linenumber % 4) AS column_name, CASE l_partkey % 3 WHEN 0 THEN 'semantic_type' WHEN 1 THEN 'null_ratio' ELSE 'data_type' END AS kind, CASE l_partkey % 3 WHEN 0 THEN l_linestatus WHEN 1 THEN '0.500000' ELSE 'text' END AS locator, l_partkey FROM lineitem"


@add("g6_unresolved_evidence", with_inputs("SELECT c.asset_id, c.column_name, c.kind, c.locator, c.l_partkey FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.asset_id = c.asset_id AND f.column_name = c.column_name AND CASE c.kind WHEN 'semantic_type' THEN f.semantic_type WHEN 'null_ratio' THEN CAST(f.null_ratio AS VARCHAR) ELSE f.data_type END = c.locator)", f=_FACTS, c=_CITED))
def _g6(spark, sf_dir):
    known = classify.facts(I.derive(spark, sf_dir, _FACTS))
    return classify.unresolved(I.derive(spark, sf_dir, _CITED), known).select("asset_id", "column_name", "kind", "locator", "l_partkey")


_NEW = "SELECT o_orderkey AS proposal_id, o_custkey AS asset_id, o_orderkey % 3 AS profile_version, 'p1' AS prompt_version, CASE WHEN o_orderkey % 2 = 0 THEN 'm1' ELSE 'm2' END AS model_alias, o_orderdate AS created_at FROM orders WHERE o_orderstatus <> 'P'"
_OLD = "SELECT asset_id, profile_version, 'p1' AS prompt_version, 'm1' AS model_alias, row_number() OVER (PARTITION BY asset_id ORDER BY profile_version) AS version FROM (SELECT DISTINCT o_custkey AS asset_id, o_orderkey % 3 AS profile_version FROM orders WHERE o_orderstatus = 'P')"


@add("g7_propose", with_inputs("SELECT proposal_id, d.asset_id, coalesce(last, 0) + row_number() OVER (PARTITION BY d.asset_id ORDER BY created_at, proposal_id) AS version FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, profile_version, prompt_version, model_alias ORDER BY created_at, proposal_id) AS turn FROM n) WHERE turn = 1) d LEFT JOIN (SELECT asset_id, max(version) AS last FROM s GROUP BY asset_id) m ON m.asset_id = d.asset_id WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.asset_id = d.asset_id AND s.profile_version = d.profile_version AND s.model_alias = d.model_alias)", n=_NEW, s=_OLD))
def _g7(spark, sf_dir):
    return classify.propose(I.derive(spark, sf_dir, _NEW), I.derive(spark, sf_dir, _OLD)).select("proposal_id", "asset_id", F.col("version").cast("bigint").alias("version"))


def judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    ours = I.derive(spark, sf_dir, I.PROPOSALS)
    return ours, review.judge(I.derive(spark, sf_dir, I.DECISIONS), ours, I.derive(spark, sf_dir, I.STATES))


_FIRST = "PARTITION BY proposal_id ORDER BY decided_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_ASSET = "PARTITION BY asset_id ORDER BY decided_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_JUDGED = f"""p AS ({I.PROPOSALS}), d AS ({I.DECISIONS}), st AS ({I.STATES}),
j0 AS (SELECT d.*, p.asset_id, p.version, p.profile_version, p.created_at, st.active, st.latest_version, CASE WHEN actor_kind = 'policy' THEN policy_id = actor_id AND policy_id IS NOT NULL ELSE policy_id IS NULL END AS fair FROM d LEFT JOIN p ON p.proposal_id = d.proposal_id LEFT JOIN st ON st.asset_id = p.asset_id),
j1 AS (SELECT *, coalesce(bool_or(outcome = 'reject' AND fair) OVER ({_FIRST}), false) AS rejected FROM j0),
j2 AS (SELECT *, coalesce(outcome = 'approve' AND fair AND NOT rejected AND active AND profile_version = latest_version, false) AS sound FROM j1),
j3 AS (SELECT *, sound AND version > coalesce(max(CASE WHEN sound THEN version END) OVER ({_ASSET}), 0) AS record FROM j2),
j4 AS (SELECT *, coalesce(bool_or(record) OVER ({_FIRST}), false) AS approved_before FROM j3),
judged AS (SELECT *, CASE WHEN version IS NULL THEN 'unknown_proposal' WHEN NOT fair THEN 'policy_mismatch' WHEN rejected OR approved_before THEN 'not_pending' WHEN outcome = 'reject' THEN 'accepted' WHEN NOT coalesce(active, false) THEN 'inactive_asset' WHEN NOT coalesce(profile_version = latest_version, false) THEN 'stale_profile' WHEN NOT record THEN 'newer_version_stands' ELSE 'accepted' END AS verdict FROM j4),
yes AS (SELECT proposal_id, max(CASE WHEN outcome = 'approve' THEN 1 ELSE 0 END) AS yes FROM judged WHERE verdict = 'accepted' GROUP BY proposal_id),
tops AS (SELECT p.asset_id, max(p.version) AS top FROM p JOIN yes ON yes.proposal_id = p.proposal_id WHERE yes = 1 GROUP BY p.asset_id),
status AS (SELECT p.proposal_id, p.asset_id, p.version, CASE WHEN yes = 0 THEN 'rejected' WHEN p.version = top THEN 'approved' WHEN yes = 1 THEN 'superseded' ELSE 'pending_review' END AS status, p.created_at FROM p LEFT JOIN yes ON yes.proposal_id = p.proposal_id LEFT JOIN tops ON tops.asset_id = p.asset_id)"""


@add("g8_judge_reviews", f"WITH {_JUDGED} SELECT id, proposal_id, verdict FROM judged")
def _g8(spark, sf_dir):
    return judged(spark, sf_dir)[1].select("id", "proposal_id", "verdict")


@add("g9_rejections", f"WITH {_JUDGED} SELECT id, proposal_id FROM judged WHERE verdict = 'accepted' AND outcome = 'reject'")
def _g9(spark, sf_dir):
    return judged(spark, sf_dir)[1].filter("verdict = 'accepted' and outcome = 'reject'").select("id", "proposal_id")


@add("g10_replays", with_inputs("SELECT id, CASE WHEN idempotency_key IS NULL OR r = 1 THEN 'first' WHEN q = fq THEN 'replay' ELSE 'conflict' END AS replay FROM (SELECT *, row_number() OVER w AS r, first_value(q) OVER w AS fq FROM (SELECT *, concat_ws('|', proposal_id, outcome, actor_kind, actor_id, coalesce(policy_id, '-'), reason) AS q FROM d) WINDOW w AS (PARTITION BY idempotency_key ORDER BY decided_at, id))", d=I.DECISIONS))
def _g10(spark, sf_dir):
    return review.requests_by_key(I.derive(spark, sf_dir, I.DECISIONS)).select("id", "replay")


@add("g10_settled_keys")
def _g10b(spark, sf_dir):
    ours = I.derive(spark, sf_dir, I.PROPOSALS)
    settled, refused = review.settle_keys(I.derive(spark, sf_dir, I.DECISIONS), ours, I.derive(spark, sf_dir, I.STATES))
    return settled.select("id", "verdict").unionByName(refused.select("id", F.col("why").alias("verdict")))


@add("g11_policy_attribution", with_inputs("SELECT id, CASE WHEN actor_kind = 'policy' THEN policy_id IS NOT NULL AND policy_id = actor_id ELSE policy_id IS NULL END AS consistent FROM d", d=I.DECISIONS))
def _g11(spark, sf_dir):
    return I.derive(spark, sf_dir, I.DECISIONS).select("id", review.consistent_policy().alias("consistent"))


@add("g12_current", f"WITH {_JUDGED} SELECT proposal_id, asset_id, version FROM status WHERE status = 'approved'")
def _g12(spark, sf_dir):
    return review.current(review.statuses(*judged(spark, sf_dir))).select("proposal_id", "asset_id", "version")


@add("g13_details", f"WITH {_JUDGED} SELECT s.proposal_id, s.status, coalesce(string_agg(j.id || ':' || j.outcome, ',' ORDER BY j.decided_at, j.id), '') AS decisions FROM status s LEFT JOIN judged j ON j.proposal_id = s.proposal_id AND j.verdict = 'accepted' GROUP BY ALL")
def _g13(spark, sf_dir):
    ours, found = judged(spark, sf_dir)
    rows = review.details(review.statuses(ours, found), found)
    return rows.select("proposal_id", "status", F.coalesce(F.array_join(F.transform("decisions", lambda d: F.concat_ws(":", d["id"], d["outcome"])), ","), F.lit("")).alias("decisions"))


@add("g14_review_queue", f"WITH {_JUDGED} SELECT proposal_id, asset_id FROM status WHERE status = 'pending_review'")
def _g14(spark, sf_dir):
    ours, found = judged(spark, sf_dir)
    return review.queue(ours, review.statuses(ours, found)).select("proposal_id", "asset_id")


@add("g15_status_audit", f"WITH {_JUDGED} SELECT CASE WHEN outcome = 'approve' THEN 'classification.approved' ELSE 'classification.rejected' END AS action, proposal_id, 'pending_review' AS before, CASE WHEN outcome = 'approve' THEN 'approved' ELSE 'rejected' END AS after FROM judged WHERE verdict = 'accepted' UNION ALL SELECT 'classification.superseded', proposal_id, 'approved', 'superseded' FROM (SELECT *, lead(proposal_id) OVER (PARTITION BY asset_id ORDER BY decided_at, id) AS nxt FROM judged WHERE verdict = 'accepted' AND outcome = 'approve') WHERE nxt IS NOT NULL")
def _g15(spark, sf_dir):
    return review.status_audit(judged(spark, sf_dir)[1])


# Scores

_SCORED = f"""e AS ({I.EXPECTED}), p AS ({I.PREDICTED}), runs AS (SELECT unnest([1, 2, 3]) AS run),
w AS (SELECT run, table_name, column_name, labels FROM e, runs),
scored AS (SELECT coalesce(w.run, p.run) AS run, coalesce(w.column_name, p.column_name) AS column_name, coalesce(w.table_name, p.table_name) AS table_name, list_sort(list_filter(coalesce(w.labels, []), lambda x: x <> 'none')) AS expected, list_sort(list_filter(coalesce(p.labels, []), lambda x: x <> 'none')) AS predicted,
  CASE WHEN p.run IS NULL THEN 'missing' WHEN w.run IS NULL THEN 'invented' WHEN list_sort(list_filter(w.labels, lambda x: x <> 'none')) = list_sort(list_filter(p.labels, lambda x: x <> 'none')) THEN 'right' ELSE 'wrong' END AS outcome FROM w FULL JOIN p ON w.run = p.run AND w.table_name = p.table_name AND w.column_name = p.column_name),
confusion AS (SELECT run, label, count(*) FILTER (list_contains(expected, label) AND list_contains(predicted, label)) AS tp, count(*) FILTER (NOT list_contains(expected, label) AND list_contains(predicted, label)) AS fp, count(*) FILTER (list_contains(expected, label) AND NOT list_contains(predicted, label)) AS fn FROM scored, (SELECT unnest(['pii', 'phi', 'financial']) AS label) GROUP BY run, label),
rates AS (SELECT run, label, tp, fp, fn, CASE WHEN tp + fp > 0 THEN CAST({duck.ratio('tp', '(tp + fp)', 4)} AS DOUBLE) END AS precision, CASE WHEN tp + fn > 0 THEN CAST({duck.ratio('tp', '(tp + fn)', 4)} AS DOUBLE) END AS recall FROM confusion),
verdict AS (SELECT s.run, concat_ws(',', CASE WHEN missing > 0 THEN 'missing_columns' END, CASE WHEN invented > 0 THEN 'invented_columns' END, CASE WHEN recall IS NULL THEN 'recall_undefined' END, CASE WHEN recall < 0.95 THEN 'low_recall' END, CASE WHEN precision IS NULL THEN 'precision_undefined' END, CASE WHEN precision < 0.9 THEN 'low_precision' END) AS reasons
  FROM (SELECT run, count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'invented') AS invented FROM scored GROUP BY run) s LEFT JOIN rates r ON r.run = s.run AND r.label = 'pii')"""


def scored(spark, sf_dir) -> DataFrame:
    return score.score(I.derive(spark, sf_dir, I.EXPECTED), I.derive(spark, sf_dir, I.PREDICTED), spark.createDataFrame([(1,), (2,), (3,)], "run int"))


@add("h1_score_tables", f"WITH {_SCORED} SELECT run, table_name, column_name, array_to_string(expected, ',') AS expected, array_to_string(predicted, ',') AS predicted, outcome FROM scored")
def _h1(spark, sf_dir):
    return scored(spark, sf_dir).select("run", "table_name", "column_name", F.array_join("expected", ",").alias("expected"), F.array_join("predicted", ",").alias("predicted"), "outcome")


@add("h2_confusion", f"WITH {_SCORED} SELECT * FROM confusion")
def _h2(spark, sf_dir):
    return score.confusion(scored(spark, sf_dir))


@add("h3_rates", f"WITH {_SCORED} SELECT * FROM rates")
def _h3(spark, sf_dir):
    return doubles(score.rates(score.confusion(scored(spark, sf_dir))), "precision", "recall")


@add("h4_verdicts", f"WITH {_SCORED} SELECT run, reasons, reasons = '' AS passed FROM verdict")
def _h4(spark, sf_dir):
    found = scored(spark, sf_dir)
    return score.verdicts(found, score.rates(score.confusion(found))).select("run", F.array_join("reasons", ",").alias("reasons"), "passed")


@add("h5_gate", f"WITH {_SCORED} SELECT count(*) AS runs, bool_and(reasons = '') AND count(*) = 3 AS passed FROM verdict")
def _h5(spark, sf_dir):
    found = scored(spark, sf_dir)
    return score.gate(score.verdicts(found, score.rates(score.confusion(found))))


@add("h6_disagreements", with_inputs("SELECT table_name, column_name, answers, by_run FROM (SELECT table_name, column_name, count(DISTINCT l) AS answers, string_agg(run || '=' || l, ';' ORDER BY run) AS by_run FROM (SELECT run, table_name, column_name, array_to_string(list_sort(list_filter(labels, lambda x: x <> 'none')), '+') AS l FROM p) GROUP BY ALL) WHERE answers > 1", p=I.PREDICTED))
def _h6(spark, sf_dir):
    found = score.disagreements(I.derive(spark, sf_dir, I.PREDICTED))
    return found.select("table_name", "column_name", "answers", F.array_join(F.transform("by_run", lambda r: F.concat_ws("=", r["run"], F.array_join(r["labels"], "+"))), ";").alias("by_run"))


_BAD = f"cited AS ({I.CITATIONS}), fact AS ({I.CITABLE}), bad AS (SELECT * FROM cited c WHERE NOT EXISTS (SELECT 1 FROM fact f WHERE f.asset_id = c.asset_id AND f.version = c.version AND f.column_name = c.column_name AND f.kind = c.kind AND f.locator = c.locator))"
_EVIDENT = f"{_SCORED}, {_BAD}, evident AS (SELECT v.run, array_to_string(list_sort(list_filter(string_split(reasons, ',') || CASE WHEN EXISTS (SELECT 1 FROM bad b WHERE b.run = v.run) THEN ['unresolved_evidence'] ELSE [] END, lambda x: x <> '')), ',') AS reasons FROM verdict v)"


def failing(spark, sf_dir) -> DataFrame:
    return classify.unresolved(I.derive(spark, sf_dir, I.CITATIONS), I.derive(spark, sf_dir, I.CITABLE))


@add("h1_evidence_failures", f"WITH {_SCORED}, {_BAD} SELECT s.run, s.table_name, s.column_name, outcome, (SELECT count(*) FROM bad b WHERE b.run = s.run AND b.asset_id = s.table_name AND b.column_name = s.column_name) AS failures FROM scored s")
def _h1b(spark, sf_dir):
    return score.evidence_failures(scored(spark, sf_dir), failing(spark, sf_dir)).select("run", "table_name", "column_name", "outcome", "failures")


@add("h4_verdicts_on_evidence", f"WITH {_EVIDENT} SELECT run, reasons, reasons = '' AS passed FROM evident")
def _h4b(spark, sf_dir):
    found = scored(spark, sf_dir)
    return score.verdicts(found, score.rates(score.confusion(found)), failing(spark, sf_dir)).select("run", F.array_join(F.array_sort("reasons"), ",").alias("reasons"), "passed")


@add("h5_gate_on_evidence", f"WITH {_EVIDENT} SELECT count(*) AS runs, bool_and(reasons = '') AND count(*) = 3 AS passed FROM evident")
def _h5b(spark, sf_dir):
    found = scored(spark, sf_dir)
    return score.gate(score.verdicts(found, score.rates(score.confusion(found)), failing(spark, sf_dir)))


@add("h6_disagreements_on_evidence", with_inputs("SELECT table_name, column_name, answers FROM (SELECT table_name, column_name, count(DISTINCT concat_ws('|', l, confidence, coalesce(cited, ''))) AS answers FROM (SELECT run, table_name, column_name, confidence, array_to_string(list_sort(list_filter(labels, lambda x: x <> 'none')), '+') AS l FROM p) q LEFT JOIN (SELECT run AS r, asset_id, column_name AS n, string_agg(kind || '=' || locator, ',' ORDER BY kind, locator) AS cited FROM c GROUP BY ALL) g ON r = run AND asset_id = table_name AND n = column_name GROUP BY table_name, column_name) WHERE answers > 1", p=I.CONFIDENT, c=I.CITATIONS))
def _h6b(spark, sf_dir):
    cited = I.derive(spark, sf_dir, I.CITATIONS).groupBy("run", F.col("asset_id").alias("table_name"), "column_name").agg(F.collect_set(F.struct("kind", "locator")).alias("citations"))
    return score.disagreements(I.derive(spark, sf_dir, I.CONFIDENT).join(cited, ["run", "table_name", "column_name"], "left")).select("table_name", "column_name", "answers")


# Ledgers


@add("i1_run_status", with_inputs("SELECT r.run_id, CASE WHEN r.status = 'cancelled' OR n IS NULL THEN r.status WHEN bad > 0 THEN 'failed' WHEN done = n THEN 'succeeded' ELSE r.status END AS status FROM r LEFT JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (state IN ('failed', 'dead')) AS bad, count(*) FILTER (state = 'done') AS done FROM t GROUP BY run_id) c ON c.run_id = r.run_id", r=I.RUNS, t=I.TASKS))
def _i1(spark, sf_dir):
    return ledger.run_status(I.derive(spark, sf_dir, I.RUNS), I.derive(spark, sf_dir, I.TASKS))


@add("i2_usage", with_inputs("SELECT run_id, CAST(sum(steps) AS BIGINT) AS steps, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(wall_clock) AS BIGINT) AS wall_clock FROM c GROUP BY run_id", c=I.CHARGES))
def _i2(spark, sf_dir):
    return doubles(ledger.usage(I.derive(spark, sf_dir, I.CHARGES), "run_id"), "cost")


@add("i3_clamped_usage", with_inputs("SELECT run_id, seq, " + ", ".join(f"CAST(least(r_{d}, {d}_cap) AS DOUBLE) AS {d}_used, CAST(least(r_{d}, {d}_cap) - least(r_{d} - {d}, {d}_cap) AS DOUBLE) AS {d}_applied, CAST({d} - (least(r_{d}, {d}_cap) - least(r_{d} - {d}, {d}_cap)) AS DOUBLE) AS {d}_over" for d in ("steps", "tokens", "cost")) + ", CAST(r_wall AS BIGINT) AS wall_clock_used FROM (SELECT q.run_id, seq, steps, tokens, cost, steps_cap, tokens_cap, cost_cap, sum(steps) OVER w AS r_steps, sum(tokens) OVER w AS r_tokens, sum(cost) OVER w AS r_cost, sum(wall_clock) OVER w AS r_wall FROM (SELECT run_id, seq, steps, tokens, round(cost, 6) AS cost, wall_clock FROM c) q JOIN k ON k.run_id = q.run_id WINDOW w AS (PARTITION BY q.run_id ORDER BY seq))", c=I.CHARGES, k=I.CAPS))
def _i3(spark, sf_dir):
    rows = ledger.clamped(I.derive(spark, sf_dir, I.CHARGES), I.derive(spark, sf_dir, I.CAPS))
    return doubles(rows, *(f"{d}_{x}" for d in ("steps", "tokens", "cost") for x in ("used", "applied", "over")))


@add("i4_ledger_rounding", "SELECT event_id, CAST(CAST((event_id * 5 + 5) // 10 AS DECIMAL(18,6)) / 1000000 AS DOUBLE) AS cost FROM events")
def _i4(spark, sf_dir):
    exact = (F.col("event_id") * 5).cast("decimal(18,0)") * F.expr("CAST(0.0000001 AS DECIMAL(8,7))")
    return table(spark, sf_dir, "events").select("event_id", ledger.ledger_cost(exact).cast("double").alias("cost"))


@add("i5_over_budget", with_inputs("SELECT run_id, concat_ws(',', CASE WHEN steps > steps_cap THEN 'steps' END, CASE WHEN tokens > tokens_cap THEN 'tokens' END, CASE WHEN cost > cost_cap THEN 'cost' END, CASE WHEN wall_clock > wall_clock_cap THEN 'wall_clock' END) AS over, greatest(steps_cap - steps, 0) AS steps_left, CAST(greatest(cost_cap - cost, 0) AS DOUBLE) AS cost_left FROM r", r=I.RUNS))
def _i5(spark, sf_dir):
    rows = ledger.remaining(I.derive(spark, sf_dir, I.RUNS))
    return doubles(rows.select("run_id", F.array_join(ledger.over(), ",").alias("over"), "steps_left", "cost_left"), "cost_left")


@add("i6_reservations", with_inputs("SELECT r.run_id, concat_ws(',', CASE WHEN s > steps_cap THEN 'steps' END, CASE WHEN t > tokens_cap THEN 'tokens' END, CASE WHEN c > cost_cap THEN 'cost' END, CASE WHEN w > wall_clock_cap THEN 'wall_clock' END) AS over FROM r JOIN (SELECT run_id, sum(steps_budget) AS s, sum(tokens_budget) AS t, sum(cost_budget) AS c, sum(wall_clock_budget) AS w FROM t GROUP BY run_id) q ON q.run_id = r.run_id", r=I.RUNS, t=I.TASKS))
def _i6(spark, sf_dir):
    goals = I.derive(spark, sf_dir, I.RUNS).select("run_id", *(f"{d}_cap" for d in ledger.DIMENSIONS))
    return ledger.reservation(I.derive(spark, sf_dir, I.TASKS), goals).select("run_id", F.array_join("over", ",").alias("over"))


@add("i7_unaffordable", with_inputs("SELECT t.task_id, concat_ws(',', " + ", ".join(f"CASE WHEN r.{d} + greatest(t.{d}_budget - t.{d}_used, 0) > r.{d}_cap THEN '{d}' END" for d in ledger.DIMENSIONS) + ") AS unaffordable FROM t JOIN r ON r.run_id = t.run_id", t=I.TASKS, r=I.RUNS))
def _i7(spark, sf_dir):
    return ledger.unaffordable(I.derive(spark, sf_dir, I.TASKS), I.derive(spark, sf_dir, I.RUNS)).select("task_id", F.array_join("unaffordable", ",").alias("unaffordable"))


@add("i8_retry_delays", "SELECT event_id, least(power(2.0, least(greatest(event_id % 40, 1) - 1, 60)), 300.0) AS delay FROM events")
def _i8(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ledger.retry_delay(F.col("event_id") % 40).alias("delay"))


@add("i9_stale_leases", with_inputs("SELECT task_id, state AS before, CASE WHEN attempts >= max_attempts THEN 'dead' ELSE 'pending' END AS after FROM t WHERE state IN ('claimed', 'running') AND lease_expires_at < TIMESTAMP '2024-01-05 00:00:00'", t=I.TASKS))
def _i9(spark, sf_dir):
    return ledger.stale(I.derive(spark, sf_dir, I.TASKS), "2024-01-05 00:00:00")


@add("i10_failure_outcomes", with_inputs("SELECT task_id, CASE WHEN retryable AND attempts < max_attempts AND affordable THEN 'pending' WHEN retryable THEN 'dead' ELSE 'failed' END AS state, CASE WHEN retryable AND attempts < max_attempts AND affordable THEN least(power(2.0, greatest(attempts, 1) - 1), 300.0) END AS delay FROM t", t=I.TASKS))
def _i10(spark, sf_dir):
    return ledger.failure_outcome(I.derive(spark, sf_dir, I.TASKS))


@add("i11_deduplicated_tasks", with_inputs("SELECT run_id, task_type, payload, min(task_id) AS task_id FROM t GROUP BY ALL", t=I.TASKS))
def _i11(spark, sf_dir):
    return ledger.deduplicated(I.derive(spark, sf_dir, I.TASKS)).select("run_id", "task_type", "payload", "task_id")


@add("i12_idempotent_requests", with_inputs("SELECT id, CASE WHEN row_number() OVER w = 1 THEN 'created' WHEN event_type = first_value(event_type) OVER w THEN 'replayed' ELSE 'conflict' END AS outcome FROM q WINDOW w AS (PARTITION BY key ORDER BY asked_at, id)", q=I.REQUESTS))
def _i12(spark, sf_dir):
    return ledger.idempotent(I.derive(spark, sf_dir, I.REQUESTS).withColumnRenamed("asked_at", "at"), ["event_type"]).select("id", "outcome")


@add("i13_single_flight", with_inputs("SELECT goal, payload, run_id FROM (SELECT *, row_number() OVER (PARTITION BY goal, payload ORDER BY created_at, run_id) AS r FROM r WHERE status IN ('pending', 'running')) WHERE r = 1", r=I.RUNS))
def _i13(spark, sf_dir):
    return ledger.single_flight(I.derive(spark, sf_dir, I.RUNS))


@add("i14_latest_checkpoints", with_inputs("SELECT task_id, step, state FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY step DESC, updated_at DESC) AS r FROM c) WHERE r = 1", c=I.CHECKPOINTS))
def _i14(spark, sf_dir):
    return ledger.latest_checkpoint(I.derive(spark, sf_dir, I.CHECKPOINTS))


_WRITES = "SELECT event_id AS task_id, concat('h', event_id % 12) AS holder, event_id % 5 AS attempt FROM events WHERE event_id % 3 <> 0"


@add("i15_stale_writers", with_inputs("SELECT w.* FROM w LEFT JOIN t ON t.task_id = w.task_id WHERE NOT (w.holder IS NOT DISTINCT FROM t.claimed_by AND w.attempt IS NOT DISTINCT FROM t.attempts AND coalesce(t.state IN ('claimed', 'running'), false))", w=_WRITES, t=I.TASKS))
def _i15(spark, sf_dir):
    return ledger.stale_writers(I.derive(spark, sf_dir, _WRITES), I.derive(spark, sf_dir, I.TASKS))


_CALLS = "SELECT event_id AS call_id, user_id AS run_id, event_type AS alias, event_id % 900 AS tokens_in, event_id % 70 AS tokens_out FROM events"
_PRICES = "SELECT DISTINCT event_type AS alias, CAST(0.000001 * length(event_type) AS DECIMAL(14,6)) AS price_in, CAST(0.000003 AS DECIMAL(14,6)) AS price_out FROM events UNION ALL SELECT 'click', CAST(0.00001 AS DECIMAL(14,6)), CAST(0.000001 AS DECIMAL(14,6))"


@add("i16_model_cost", with_inputs("SELECT run_id, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS calls FROM (SELECT call_id, run_id, max(tokens_in * price_in + tokens_out * price_out) AS cost FROM c LEFT JOIN p ON p.alias = c.alias GROUP BY ALL) GROUP BY run_id", c=_CALLS, p=_PRICES))
def _i16(spark, sf_dir):
    return doubles(ledger.model_cost(I.derive(spark, sf_dir, _CALLS), I.derive(spark, sf_dir, _PRICES), "run_id"), "cost")


_MUTATED = "SELECT event_type AS entity_type, concat('e', event_id) AS entity_id FROM events"
_AUDITED = "SELECT event_type AS entity_type, concat('e', event_id) AS entity_id FROM events WHERE event_id % 13 <> 0"


@add("i17_unaudited", with_inputs("SELECT * FROM m EXCEPT SELECT * FROM a", m=_MUTATED, a=_AUDITED))
def _i17(spark, sf_dir):
    return ledger.unaudited(I.derive(spark, sf_dir, _MUTATED), I.derive(spark, sf_dir, _AUDITED))


@add("i17_audit_counts", with_inputs("SELECT entity_type, count(*) AS rows FROM a GROUP BY entity_type", a=_AUDITED))
def _i17b(spark, sf_dir):
    return ledger.audit_counts(I.derive(spark, sf_dir, _AUDITED))


@add("a8_audit_sink", f"WITH o AS ({I.OBSERVED}) SELECT 'scanner' AS actor, 'column.seen' AS action, 'column' AS entity_type, concat_ws('.', schema_name, name, column_name) AS entity_id, CAST(NULL AS VARCHAR) AS before, '{{\"data_type\":\"' || data_type || '\",\"ordinal\":' || ordinal || '}}' AS after FROM o")
def _a8(spark, sf_dir):
    seen = I.derive(spark, sf_dir, I.OBSERVED)
    rows = sources.audit("column", "scanner", [(seen, "column.seen", sources.qualified_name("schema_name", "name", "column_name"), F.lit(None).cast("string"), F.to_json(F.struct("data_type", "ordinal")))])
    return rows


_TRACED = "SELECT event_id AS task_id, substr(md5(concat('run', user_id)), 1, 16) AS trace_id FROM events"


@add("i18_trace_gaps", with_inputs("SELECT t.task_id, CASE WHEN s.task_id IS NULL THEN 'no_span' ELSE 'no_prompt_version' END AS gap FROM t LEFT JOIN (SELECT task_id, trace_id, count(*) FILTER (kind = 'generation' AND prompt_version IS NULL) AS bad FROM s GROUP BY ALL) s ON s.task_id = t.task_id AND s.trace_id = t.trace_id WHERE s.task_id IS NULL OR bad > 0", t=_TRACED, s=I.SPANS))
def _i18(spark, sf_dir):
    return ledger.trace_gaps(I.derive(spark, sf_dir, _TRACED), I.derive(spark, sf_dir, I.SPANS))


@add("i19_trace_ids", "SELECT event_id, substr(sha256(concat('run-', event_id)), 1, 32) AS trace_id FROM events")
def _i19(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ledger.trace_id(F.concat(F.lit("run-"), F.col("event_id"))).alias("trace_id"))


# Compatibility

_BREAKS = f"o AS ({I.FIELDS_OLD}), n AS ({I.FIELDS_NEW}), b AS (SELECT coalesce(o.subject, n.subject) AS subject, coalesce(o.path, n.path) AS path, unnest(list_filter([CASE WHEN n.path IS NULL AND s.subject IS NULL THEN 'removed_subject' END, CASE WHEN n.path IS NULL AND s.subject IS NOT NULL THEN 'removed_field' END, CASE WHEN o.type <> n.type THEN 'type_changed' END, CASE WHEN n.required AND NOT coalesce(o.required, false) THEN 'newly_required' END, CASE WHEN len(list_filter(o.vals, lambda x: NOT list_contains(n.vals, x))) > 0 THEN 'enum_narrowed' END], lambda x: x IS NOT NULL)) AS problem FROM o FULL JOIN n ON o.subject = n.subject AND o.path = n.path LEFT JOIN (SELECT DISTINCT subject FROM n) s ON s.subject = coalesce(o.subject, n.subject))"
_DECLARED = "SELECT DISTINCT concat('m', CAST(floor(p_partkey / 8.0) AS BIGINT)) AS subject, concat('/f', p_partkey % 8) AS path, CASE WHEN p_partkey % 2 = 0 THEN 'removed_field' ELSE 'type_changed' END AS problem FROM part WHERE p_partkey % 5 < 2"


@add("j1_breaks", f"WITH {_BREAKS} SELECT * FROM b")
def _j1(spark, sf_dir):
    return compat.breaks(I.derive(spark, sf_dir, I.FIELDS_OLD), I.derive(spark, sf_dir, I.FIELDS_NEW))


@add("j2_compat_verdicts", f"WITH {_BREAKS}, d AS ({_DECLARED}), u AS (SELECT subject FROM o UNION SELECT subject FROM n UNION SELECT subject FROM d) SELECT u.subject, CASE WHEN u.subject IN (SELECT subject FROM (SELECT * FROM b EXCEPT SELECT * FROM d)) THEN 'breaking' WHEN u.subject IN (SELECT subject FROM (SELECT * FROM d EXCEPT SELECT * FROM b)) THEN 'stale' ELSE 'pass' END AS verdict FROM u")
def _j2(spark, sf_dir):
    old, new = I.derive(spark, sf_dir, I.FIELDS_OLD), I.derive(spark, sf_dir, I.FIELDS_NEW)
    return compat.verdicts(old, new, compat.breaks(old, new), I.derive(spark, sf_dir, _DECLARED))


_BASES = ("https://blog.tionsh.example.net", "http://www.ththhe.example.com/en", "https://api.mistral.ai")


@add("j3_url_audit", "SELECT page_id, CASE WHEN regexp_matches(url, '^[^?#]*\\?[^#]|#.') THEN 'malformed' WHEN regexp_matches(url, '^https://blog\\.tionsh\\.example\\.net(/|$)') OR regexp_matches(url, '^http://www\\.ththhe\\.example\\.com/en(/|$)') THEN 'allowed' ELSE 'not_allowed' END AS verdict FROM pages")
def _j3(spark, sf_dir):
    allowed = spark.createDataFrame([(u,) for u in _BASES], "url string")
    return compat.url_audit(table(spark, sf_dir, "pages"), allowed, "page_id")


# Streams: the files of a table as a stream, drained once, with a batch query over the same rows as the reference


def drained(spark, stream: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream writes until its source is empty, as a table in the shared folder."""
    folder = streams.folder(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/rows").start()
    else:
        with folds.rocks(spark):
            query = writer.foreachBatch(lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema if mode == "append" else T.StructType([*stream.schema, T.StructField("batch", T.IntegerType())])).parquet(f"{folder}/rows")


def event_stream(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path if not path.endswith(".parquet") else path + "*")


_STATES_OF_EVENTS = "SELECT user_id AS task_id, ts, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'running' WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS state FROM events"


@add("k1_stream_task_states", with_inputs("SELECT task_id, coalesce(arg_min(state, (ts, event_id)) FILTER (state <> 'running'), arg_max(state, (ts, event_id))) AS state FROM s GROUP BY task_id", s=_STATES_OF_EVENTS))
def _k1(spark, sf_dir):
    state = F.when(F.col("event_type").isin("click", "view"), "running").when(F.col("event_type") == "error", "failed").otherwise("done")
    rows = event_stream(spark, sf_dir).select(F.col("user_id").alias("task_id"), state.alias("state"), F.lit(1).cast("long").alias("attempts"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    found = drained(spark, folds.fold_tasks(rows, 365 * 24 * 3600 * 1000), "task-states", "update")
    return found.groupBy("task_id").agg(F.max_by("state", F.struct("at", "batch")).alias("state"))


@add("k2_stream_usage", "SELECT user_id AS run_id, count(*) AS steps, CAST(sum(CAST(value AS DECIMAL(14,6))) AS DOUBLE) AS cost FROM events GROUP BY user_id")
def _k2(spark, sf_dir):
    rows = event_stream(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.lit(1).cast("long").alias("steps"), F.col("value").cast("decimal(14,6)").alias("cost"))
    found = drained(spark, folds.usage_totals(rows), "usage", "update")
    return found.groupBy("run_id").agg(F.max_by("steps", "batch").alias("steps"), F.max_by("cost", "batch").cast("double").alias("cost"))


@add("k3_stream_first_requests", "SELECT DISTINCT concat('k', user_id) AS key FROM events")
def _k3(spark, sf_dir):
    rows = event_stream(spark, sf_dir).select(F.concat(F.lit("k"), "user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return drained(spark, folds.first_requests(rows, "3650 days"), "requests", "append").select("key")


@add("k4_incremental_profiles", "SELECT 'events' AS asset_id, 1 AS version, count(*) AS row_count FROM events")
def _k4(spark, sf_dir):
    folder = streams.folder(spark, "profiles")
    stream = event_stream(spark, sf_dir)
    for turn in ("first", "again"):  # the second run sees the same rows under the same batch ids, and changes nothing
        writer = stream.writeStream.foreachBatch(folds.record_profiles(folder, "events")).option("checkpointLocation", f"{folder}/{turn}").trigger(availableNow=True)
        writer.start().awaitTermination()
    return spark.read.parquet(f"{folder}/versions").select("asset_id", F.col("version").cast("int").alias("version"), "row_count")


# Quality, retrieval, health


@add("l1_rules", "SELECT unnest(['positive', 'dated']) AS rule, unnest([count(*) FILTER (NOT coalesce(o_totalprice > 1000, false)), count(*) FILTER (NOT coalesce(o_orderdate >= TIMESTAMP '1993-01-01', false))]) AS failed, count(*) AS total FROM orders")
def _l1(spark, sf_dir):
    return quality.rules(table(spark, sf_dir, "orders"), {"positive": F.col("o_totalprice") > 1000, "dated": F.col("o_orderdate") >= F.lit("1993-01-01").cast("timestamp_ntz")})


@add("l1_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _l1b(spark, sf_dir):
    return quality.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@add("l1_orphans", "SELECT doc_id, toxic FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0)")
def _l1c(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return quality.orphans(rows, "doc_id", table(spark, sf_dir, "documents").filter("doc_id % 7 <> 0"), "doc_id")


@add("l1_stability", "SELECT round(sum((b / tb - a / ta) * ln((b / tb) / (a / ta))), 6) AS psi FROM (SELECT coalesce(CAST(x.n AS DOUBLE), 0.5) AS a, coalesce(CAST(y.n AS DOUBLE), 0.5) AS b, sum(coalesce(CAST(x.n AS DOUBLE), 0.5)) OVER () AS ta, sum(coalesce(CAST(y.n AS DOUBLE), 0.5)) OVER () AS tb FROM (SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY source) x FULL JOIN (SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY source) y ON x.source = y.source)")
def _l1d(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.stability(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), "source")


@add("l2_name_tokens", "SELECT p_partkey, array_to_string(list_distinct_in_order, ',') AS tokens FROM (SELECT p_partkey, [lower(p_brand)] || list_filter(string_split_regex(lower(p_brand), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS list_distinct_in_order FROM part)")
def _l2(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(quality.name_tokens(F.col("p_brand")), ",").alias("tokens"))


_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_BM25 = f"""WITH w AS (SELECT doc_id, {_WORDS} AS tokens FROM documents), q AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark),
size AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM w), t AS (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS term FROM w),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), size GROUP BY ALL)
SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5"""


@add("l2_bm25", _BM25)
def _l2b(spark, sf_dir):
    words = lambda df, key, name: df.select(F.col(key).alias(name), F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("tokens"))
    return quality.bm25(words(table(spark, sf_dir, "documents"), "doc_id", "doc_id"), words(table(spark, sf_dir, "benchmark"), "item_id", "query_id"), 5)


_RANKED = "SELECT o_custkey AS query_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders"
_RANKED2 = "SELECT o_custkey AS query_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders"
_RELEVANT = "SELECT o_custkey AS query_id, o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'F'"


@add("l4_fused_ranks", with_inputs("SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)) WHERE rank <= 5", a=_RANKED, b=_RANKED2))
def _l4(spark, sf_dir):
    return quality.fuse(I.derive(spark, sf_dir, _RANKED).unionByName(I.derive(spark, sf_dir, _RANKED2)), 5)


@add("l5_retrieval_metrics", with_inputs("SELECT w.query_id, round(coalesce(found, 0) / wanted::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(wanted, 8) + 1) t(i)), 6) AS ndcg FROM (SELECT query_id, count(*) AS wanted FROM v GROUP BY query_id) w LEFT JOIN (SELECT a.query_id, count(*) AS found, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM a JOIN v ON v.query_id = a.query_id AND v.doc_id = a.doc_id WHERE rank <= 8 GROUP BY a.query_id) h ON h.query_id = w.query_id", a=_RANKED, v=_RELEVANT))
def _l5(spark, sf_dir):
    return quality.retrieval_metrics(I.derive(spark, sf_dir, _RANKED), I.derive(spark, sf_dir, _RELEVANT), 8)


@add("l6_kappa", "SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM (SELECT avg(CASE WHEN toxic = quality THEN 1.0 ELSE 0.0 END) AS po, avg(toxic) * avg(quality) + (1 - avg(toxic)) * (1 - avg(quality)) AS pe FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL)")
def _l6(spark, sf_dir):
    return quality.kappa(table(spark, sf_dir, "labels"), "toxic", "quality")


_TRUTH = "SELECT c_custkey, md5(c_name) AS digest FROM customer WHERE c_custkey % 17 <> 0"
_INDEX = "SELECT c_custkey, md5(CASE WHEN c_custkey % 29 = 0 THEN 'x' ELSE c_name END) AS digest FROM customer WHERE c_custkey % 19 <> 0"


@add("l7_reconcile", with_inputs("SELECT coalesce(t.c_custkey, i.c_custkey) AS c_custkey, CASE WHEN i.digest IS NULL THEN 'missing' WHEN t.digest IS NULL THEN 'extra' ELSE 'changed' END AS state FROM t FULL JOIN i ON t.c_custkey = i.c_custkey WHERE t.digest IS DISTINCT FROM i.digest", t=_TRUTH, i=_INDEX))
def _l7(spark, sf_dir):
    return quality.reconcile(I.derive(spark, sf_dir, _TRUTH), I.derive(spark, sf_dir, _INDEX), "c_custkey")


@add("l8_cost_regressions", "SELECT event_type AS task_type, round(avg(value) FILTER (event_id % 2 = 0) / avg(value) FILTER (event_id % 2 = 1), 4) AS ratio, avg(value) FILTER (event_id % 2 = 0) / avg(value) FILTER (event_id % 2 = 1) <= 1.2 AS within FROM events GROUP BY event_type")
def _l8(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("task_type"), F.col("value").alias("cost"))
    return quality.regressions(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"))


@add("l9_hit_at_3", with_inputs("SELECT query_id AS incident_id, bool_or(rank <= 3 AND doc_id % 4 = 0) AS hit FROM a GROUP BY query_id", a=_RANKED))
def _l9(spark, sf_dir):
    ranked = I.derive(spark, sf_dir, _RANKED).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("r"))
    causes = ranked.select(F.col("query_id").alias("incident_id"), F.transform("r", lambda x: (x["doc_id"] % 4).cast("int")).alias("causes"))
    return quality.hit_at(causes, causes.select("incident_id", F.lit(0).alias("cause")))


@add("l10_health", with_inputs("SELECT time_bucket(INTERVAL '1 hour', lease_expires_at) AS start, count(*) AS events, count(*) FILTER (state = 'dead') AS dead, max(attempts) AS oldest_seconds FROM t GROUP BY 1", t=I.TASKS))
def _l10(spark, sf_dir):
    rows = I.derive(spark, sf_dir, I.TASKS).select(F.col("lease_expires_at").alias("at"), "state", F.col("attempts").alias("age_seconds"))
    return quality.health(rows)
