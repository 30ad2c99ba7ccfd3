"""Classification proposals: a rule classifier and a pluggable one, validation, coverage, evidence, and convergent proposing.

proposals: proposal_id, asset_id, profile_version, prompt_version, model_alias, columns (array of struct(column_name, labels, confidence, evidence)).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The labels and the kinds of evidence.
LABELS = ("pii", "phi", "financial", "none")
KINDS = ("column_name", "data_type", "masked_sample", "distinct_ratio", "null_ratio", "semantic_type")
#: Words of column names that the rule classifier goes by.
NAME_RULES = {
    "pii": r"(^|_)(name|email|phone|mobile|address|street|zip|birth|dob|passport|ssn|mrn|user|customer|cust|patient|person|ip)(_|\z)",
    "phi": r"(^|_)(patient|diagnosis|icd|treatment|medication|mrn|allergy|lab)(_|\z)",
    "financial": r"(^|_)(card|iban|account|acct|acctbal|balance|amount|price|totalprice|extendedprice|retailprice|discount|tax|salary|payment)(_|\z)",
}
DERIVED = r"(^|_)(hash|digest|domain|code|source|length|count|key|segment|priority|status)(_|\z)"


def classify(profiles: DataFrame) -> DataFrame:
    """Labels and evidence for each column of a profile (table_name, name, semantic_type, ...), by name and semantic type."""
    name = F.regexp_replace(F.lower("name"), r"^[a-z]_", "")
    derived = name.rlike(DERIVED)
    by_type = {"pii": F.col("semantic_type").isin("email", "phone", "ip_address"), "financial": F.col("semantic_type") == "credit_card"}
    found: list[Column] = []
    for label, pattern in NAME_RULES.items():
        hit = (name.rlike(pattern) & ~derived) | by_type.get(label, F.lit(False))
        found.append(F.when(hit, label))
    labels = F.array_compact(F.array(*found))
    sensitive = F.size(labels) > 0
    cite = lambda kind, value: F.struct(F.col("name").alias("column_name"), F.lit(kind).alias("kind"), value.alias("locator"))
    evidence = F.array(cite("column_name", F.col("name")), cite("semantic_type", F.col("semantic_type")))
    confidence = F.when(F.col("semantic_type").isin("email", "credit_card"), 0.95).when(sensitive, 0.8).otherwise(0.7).cast("decimal(3,2)")
    return profiles.select(
        "table_name", F.col("name").alias("column_name"), F.when(sensitive, labels).otherwise(F.array(F.lit("none"))).alias("labels"), confidence.alias("confidence"),
        F.when(sensitive, evidence).otherwise(F.array().cast("array<struct<column_name:string,kind:string,locator:string>>")).alias("evidence"),
    )


def classify_with(profiles: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, by: str = "table_name") -> DataFrame:
    """Any classifier: a function from one asset's profile frame to its labels. A group is the columns of one table."""
    return profiles.groupBy(by).applyInPandas(fn, schema)


def label_problems(profile_version: Column, column: Column) -> Column:
    """What is wrong with a column's labels and evidence, as an array of rule names, in order."""
    labels, evidence = column["labels"], column["evidence"]
    sensitive = F.exists(labels, lambda x: x != "none")
    rules = [
        ("no_labels", F.size(labels) == 0),
        ("unknown_label", F.exists(labels, lambda x: ~x.isin(*LABELS))),
        ("duplicate_label", F.size(labels) != F.size(F.array_distinct(labels))),
        ("none_not_alone", F.array_contains(labels, "none") & sensitive),
        ("sensitive_without_evidence", sensitive & (F.size(evidence) == 0)),
        ("repeated_citation", F.size(evidence) != F.size(F.array_distinct(F.transform(evidence, lambda e: F.struct(e["kind"], e["locator"]))))),
        ("foreign_citation", F.exists(evidence, lambda e: e["column_name"] != column["column_name"])),
        ("wrong_version", F.exists(evidence, lambda e: e["profile_version"] != profile_version)),
        ("bad_confidence", ~column["confidence"].between(0, 1)),
    ]
    return F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules)))


def column_problems(proposals: DataFrame) -> DataFrame:
    """(proposal_id, column_name, problems) for each proposed column."""
    rows = proposals.select("proposal_id", "profile_version", F.explode("columns").alias("c"))
    return rows.select("proposal_id", F.col("c.column_name").alias("column_name"), label_problems(F.col("profile_version"), F.col("c")).alias("problems"))


def proposal_problems(proposals: DataFrame) -> DataFrame:
    """(proposal_id, valid, repeated_columns): columns named twice, and whether no column has a problem."""
    names = F.transform("columns", lambda c: c["column_name"])
    repeated = F.array_distinct(F.filter(names, lambda n: F.size(F.filter(names, lambda m: m == n)) > 1))
    bad = F.exists("columns", lambda c: F.size(label_problems(F.col("profile_version"), c)) > 0)
    return proposals.select("proposal_id", F.array_sort(repeated).alias("repeated_columns"), (~bad & (F.size(repeated) == 0)).alias("valid"))


def sensitive_columns(proposals: DataFrame) -> DataFrame:
    """(proposal_id, n_sensitive, sensitive): columns with a label other than none."""
    found = F.filter("columns", lambda c: F.exists(c["labels"], lambda x: x != "none"))
    names = F.array_sort(F.transform(found, lambda c: c["column_name"]))
    return proposals.select("proposal_id", F.size(names).alias("n_sensitive"), names.alias("sensitive"))


def coverage(proposed: DataFrame, profiled: DataFrame) -> DataFrame:
    """(asset_id, missing, unknown): profiled columns without a label and labelled columns without a profile. Both: asset_id, column_name."""
    a = proposed.select("asset_id", "column_name", F.lit(True).alias("p")).distinct()
    b = profiled.select("asset_id", "column_name", F.lit(True).alias("q")).distinct()
    both = a.join(b, ["asset_id", "column_name"], "full_outer").filter("p is null or q is null")
    names = lambda empty: F.array_sort(F.collect_list(F.when(F.col(empty).isNull(), F.col("column_name"))))
    return both.groupBy("asset_id").agg(names("p").alias("missing"), names("q").alias("unknown"))


def facts(profiled: DataFrame) -> DataFrame:
    """(asset_id, version, column_name, kind, locator): every value of a profile that a citation may name."""
    pairs = [("column_name", F.col("column_name")), ("data_type", F.col("data_type")), ("null_ratio", F.col("null_ratio").cast("string")), ("distinct_ratio", F.col("distinct_ratio").cast("string")), ("semantic_type", F.col("semantic_type"))]
    plain = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("locator")) for k, v in pairs))
    samples = F.transform("samples", lambda s: F.struct(F.lit("masked_sample").alias("kind"), s.alias("locator")))
    return profiled.select("asset_id", "version", "column_name", F.explode(F.concat(plain, samples)).alias("f")).select("asset_id", "version", "column_name", "f.kind", "f.locator").filter("locator is not null").distinct()


def unresolved(citations: DataFrame, known: DataFrame) -> DataFrame:
    """Citations (asset_id, version, column_name, kind, locator, ...) that equal no stored fact."""
    return citations.join(known, ["asset_id", "version", "column_name", "kind", "locator"], "left_anti")


PROPOSAL_KEY = ["asset_id", "profile_version", "prompt_version", "model_alias"]


def propose(proposals: DataFrame, stored: DataFrame) -> DataFrame:
    """Proposals to add, pending review: the first of each key that is not stored, numbered on from the asset's last version."""
    first = Window.partitionBy(*PROPOSAL_KEY).orderBy("created_at", "proposal_id")
    fresh = proposals.withColumn("turn", F.row_number().over(first)).filter("turn = 1").drop("turn").join(stored.select(*PROPOSAL_KEY), PROPOSAL_KEY, "left_anti")
    last = stored.groupBy("asset_id").agg(F.max("version").alias("last"))
    number = F.row_number().over(Window.partitionBy("asset_id").orderBy("created_at", "proposal_id"))
    return fresh.join(last, "asset_id", "left").withColumn("version", F.coalesce("last", F.lit(0)) + number).drop("last").withColumn("status", F.lit("pending_review"))
