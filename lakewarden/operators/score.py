"""Scores of classifiers: expected against predicted label sets, per label and run, with a verdict and its reasons.

expected: table_name, column_name, labels. predicted: run, table_name, column_name, labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.functions.text import ratio

SENSITIVE = ("pii", "phi", "financial")
LEAST_RECALL, LEAST_PRECISION, RUNS = 0.95, 0.90, 3


def label_set(column):
    """Sorted distinct labels without none."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda x: x != "none")))


def score(expected: DataFrame, predicted: DataFrame, runs: DataFrame) -> DataFrame:
    """A row for each run and column: both label sets, whether they agree, and missing or invented columns. runs: run."""
    key = ["run", "table_name", "column_name"]
    # each run is to answer for every column: expected rows times runs, which are a handful
    want = expected.select("table_name", "column_name", F.col("labels").alias("expected")).crossJoin(runs.select("run"))
    both = want.join(predicted.select(*key, F.col("labels").alias("predicted")), key, "full_outer")
    outcome = F.when(F.col("predicted").isNull(), "missing").when(F.col("expected").isNull(), "invented").when(label_set(F.col("expected")) == label_set(F.col("predicted")), "right").otherwise("wrong")
    return both.select(*key, label_set(F.col("expected")).alias("expected"), label_set(F.col("predicted")).alias("predicted"), outcome.alias("outcome"))


def confusion(scored: DataFrame, labels: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """run, label, tp, fp, fn."""
    rows = scored.select("run", "expected", "predicted", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    e, p = F.array_contains("expected", F.col("label")), F.array_contains("predicted", F.col("label"))
    return rows.groupBy("run", "label").agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"))


def rates(confused: DataFrame) -> DataFrame:
    """confused with precision and recall to four places; null where undefined."""
    share = lambda whole: F.when(whole > 0, ratio(F.col("tp"), whole, 4))
    return confused.withColumn("precision", share(F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp") + F.col("fn")))


def verdicts(scored: DataFrame, rated: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """run, reasons (array), passed: exact coverage, evidence, pii recall and precision. unresolved: run of each citation that fails."""
    cover = scored.groupBy("run").agg(F.count_if(F.col("outcome") == "missing").alias("missing"), F.count_if(F.col("outcome") == "invented").alias("invented"))
    pii = rated.filter("label = 'pii'").select("run", "precision", "recall")
    rows = cover.join(pii, "run", "left")
    rows = rows.join(unresolved.groupBy("run").agg(F.count(F.lit(1)).alias("bad")), "run", "left") if unresolved is not None else rows.withColumn("bad", F.lit(0))
    rules = [
        ("missing_columns", F.col("missing") > 0),
        ("invented_columns", F.col("invented") > 0),
        ("unresolved_evidence", F.coalesce("bad", F.lit(0)) > 0),
        ("recall_undefined", F.col("recall").isNull()),
        ("low_recall", F.col("recall") < LEAST_RECALL),
        ("precision_undefined", F.col("precision").isNull()),
        ("low_precision", F.col("precision") < LEAST_PRECISION),
    ]
    reasons = F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules)))
    return rows.select("run", reasons.alias("reasons"), (F.size(reasons) == 0).alias("passed"))


def gate(verdict: DataFrame, runs: int = RUNS) -> DataFrame:
    """One row: runs, passed; every one of the wanted runs passes on its own, and no runs is no pass."""
    return verdict.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.bool_and("passed") & (F.count(F.lit(1)) == runs), F.lit(False)).alias("passed"))


def disagreements(predicted: DataFrame) -> DataFrame:
    """Columns on which runs differ in labels, or in confidence or citations (an array) where predicted has them, with each run's answer."""
    answer = [label_set(F.col("labels")).alias("labels")]
    answer += [F.col("confidence")] if "confidence" in predicted.columns else []
    answer += [F.array_sort(F.array_distinct(F.coalesce("citations", F.array()))).alias("citations")] if "citations" in predicted.columns else []
    rows = predicted.groupBy("table_name", "column_name").agg(F.count_distinct(F.struct(*answer)).alias("answers"), F.array_sort(F.collect_list(F.struct("run", *answer))).alias("by_run"))
    return rows.filter("answers > 1")


def evidence_failures(scored: DataFrame, unresolved: DataFrame) -> DataFrame:
    """scored with failures: how many citations of each run and column equal no stored fact. unresolved: run, asset_id (the table's name), column_name."""
    key = ["run", "table_name", "column_name"]
    bad = unresolved.withColumnRenamed("asset_id", "table_name").groupBy(*key).agg(F.count(F.lit(1)).alias("failures"))
    return scored.join(bad, key, "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
