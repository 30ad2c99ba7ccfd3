"""Quality rules, retrieval and its metrics, agreement, and health over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.operators import profile

#: Queries' distinct terms up to this number are broadcast.
POSTINGS = 1_000_000


def rules(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rule, failed, total: rows for which each condition does not hold; nulls fail. One pass for all rules."""
    counted = df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(f"r{i}") for i, c in enumerate(checks.values())))
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("failed"), F.col("total")) for i, n in enumerate(checks)))
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, for a uniqueness rule."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    return df.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


def stability(base: DataFrame, now: DataFrame, column: str) -> DataFrame:
    """psi: population stability index of two samples of a categorical column, empty bins counted as half a row."""
    a, b = (df.groupBy(column).agg(F.count(F.lit(1)).alias(n)) for df, n in ((base, "a"), (now, "b")))
    both = a.join(b, column, "full_outer").select(*(F.coalesce(F.col(n).cast("double"), F.lit(0.5)).alias(n) for n in "ab"))
    totals = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.col("a") / F.col("ta"), F.col("b") / F.col("tb")
    return both.join(F.broadcast(totals)).agg(F.round(F.sum((q - p) * F.log(q / p)), 6).alias("psi"))


def freshness(df: DataFrame, at: str, now: Column, most_seconds: int, *by: str) -> DataFrame:
    """by, latest, age_seconds, fresh: whether the newest row (of each group) is at most so old. Without a time at all it is not fresh."""
    rows = df.groupBy(*by).agg(F.max(at).alias("latest"))
    age = F.timestamp_diff("SECOND", F.col("latest"), now)
    return rows.withColumn("age_seconds", age).withColumn("fresh", F.coalesce(F.col("age_seconds") <= most_seconds, F.lit(False)))


def name_tokens(name: Column) -> Column:
    """An identifier and its parts, in lower case."""
    parts = F.split(F.lower(name), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.concat(F.array(F.lower(name)), F.filter(parts, lambda p: p != "")))


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents (doc_id, tokens) of each query (query_id, tokens). Common terms stay: only words that no query asks for are dropped, and those only after lengths are taken."""
    asked = queries.select("query_id", F.explode("tokens").alias("term")).distinct()
    few = asked.count() <= POSTINGS  # then no term's rows meet in one task
    small = F.broadcast if few else lambda df: df
    wanted = small(asked.select("term").distinct())
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("mean"))
    spread = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one exchange by document serves its term frequencies and its scores
    words = docs.repartition("doc_id").select("doc_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    terms = words.groupBy("doc_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    hits = terms.join(small(asked.join(spread, "term")), "term").join(F.broadcast(size))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))
    return top(scored, k)


def top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse(rankings: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings (query_id, doc_id, rank) from several sources."""
    return top(rankings.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score")), k)


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, recall, reciprocal_rank, ndcg at k; relevant: query_id, doc_id."""
    wanted = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    hits = ranked.filter(F.col("rank") <= k).join(relevant, ["query_id", "doc_id"])
    gains = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("wanted", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    rows = wanted.join(gains, "query_id", "left")
    return rows.select(
        "query_id", F.round(F.coalesce("found", F.lit(0)) / F.col("wanted"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"),
    )


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters' columns, to six places; null where chance agreement is complete."""
    both = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    left, right = (both.groupBy(F.col(c).alias("value")).agg(F.sum("n").alias(c)) for c in ("x", "y"))
    chance = left.join(right, "value").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("chance"))
    total = both.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    pe, po = F.col("chance") / (F.col("n").cast("double") * F.col("n")), F.col("same") / F.col("n")
    return total.join(F.broadcast(chance)).select(F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"))


def reconcile(truth: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """key, state: missing, extra or changed where a derived index differs from the truth; both have a digest."""
    a, b = truth.select(key, F.col("digest").alias("t")), index.select(key, F.col("digest").alias("i"))
    state = F.when(F.col("i").isNull(), "missing").when(F.col("t").isNull(), "extra").when(F.col("t") != F.col("i"), "changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).filter("state is not null")


def regressions(now: DataFrame, base: DataFrame, most: float = 1.2) -> DataFrame:
    """task_type, ratio of mean costs to the baseline's, and whether it is within most."""
    a, b = (df.groupBy("task_type").agg(F.avg("cost").alias(n)) for df, n in ((now, "now"), (base, "base")))
    ratio = F.col("now") / F.col("base")
    return a.join(b, "task_type").select("task_type", F.round(ratio, 4).alias("ratio"), (ratio <= most).alias("within"))


def hit_at(ranked: DataFrame, truth: DataFrame, k: int = 3) -> DataFrame:
    """incident_id, hit: whether the true cause is among the first k of causes (an array)."""
    rows = ranked.join(truth, "incident_id")
    return rows.select("incident_id", F.array_contains(F.slice("causes", 1, k), F.col("cause")).alias("hit"))


def health(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """window start, dead tasks, all events and the largest age in seconds; for streams and tables alike."""
    return events.groupBy(F.window("at", width)).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("state") == "dead").alias("dead"), F.max("age_seconds").alias("oldest_seconds")).select(F.col("window.start").alias("start"), "events", "dead", "oldest_seconds")


#: Characters that numbers, booleans, times and arrays of them are written with.
PLAIN = r"^[-+0-9.:,\[\]{} ENaInfityruelsTZ]*\z"


def holds_text(kind: T.DataType) -> bool:
    """Whether values of a type may have other characters than those of PLAIN."""
    if isinstance(kind, T.ArrayType):
        return holds_text(kind.elementType)
    return not isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def leaks(df: DataFrame, tokens: DataFrame, name: str) -> DataFrame:
    """token, table_name, rows: in how many rows of a table each token (a short list, which meets every row) occurs, in any column.

    Tokens that no number or time can hold are looked for in the other columns alone. Without tokens of a kind its part of the plan is empty, and nothing is read for it.
    """
    wanted = tokens.select("token").distinct()
    plain = F.col("token").rlike(PLAIN)
    parts = []
    for own, fields in ((wanted.filter(~plain), [f for f in df.schema if holds_text(f.dataType)]), (wanted.filter(plain), list(df.schema))):
        if fields:
            row = df.select(F.concat_ws("\x1f", *(profile.rendered(f.name, f.dataType) for f in fields)).alias("row"))
            parts.append(row.join(own, F.contains(F.col("row"), F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("rows")))
    return reduce(DataFrame.unionByName, parts).select("token", F.lit(name).alias("table_name"), "rows")
