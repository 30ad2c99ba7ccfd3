"""Run and cost ledgers over tables of tasks, charges, checkpoints, spans and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = ("steps", "tokens", "cost", "wall_clock")


def run_status(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """run_id and status: failed if a task failed or died, succeeded if all are done, else as it was; cancelled runs and those without tasks stay."""
    counts = tasks.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state").isin("failed", "dead")).alias("bad"), F.count_if(F.col("state") == "done").alias("done"))
    rows = runs.join(counts, "run_id", "left")
    status = F.when((F.col("status") == "cancelled") | F.col("n").isNull(), F.col("status")).when(F.col("bad") > 0, "failed").when(F.col("done") == F.col("n"), "succeeded").otherwise(F.col("status"))
    return rows.select("run_id", status.alias("status"))


def usage(charges: DataFrame, *by: str) -> DataFrame:
    """Sums of the four dimensions, by run or task."""
    return charges.groupBy(*by).agg(*(F.sum(d).alias(d) for d in DIMENSIONS))


def ledger_cost(cost: Column) -> Column:
    """Money to six places, half up."""
    return F.round(cost, 6)


def clamped(charges: DataFrame, budgets: DataFrame) -> DataFrame:
    """Each charge with what of it was applied and what was overspent: usage stops at the budget, wall clock does not.

    Charges are not negative, so the sequential min(used + x, cap) is min(running sum, cap). Order: seq, then the charge itself; charges
    that are equal in all follow each other in any order. A run's log is one window: it grows with the run, not with the table.
    """
    order = Window.partitionBy("run_id").orderBy("seq", *(c for c in charges.columns if c not in ("run_id", "seq"))).rowsBetween(Window.unboundedPreceding, 0)
    rows = charges.withColumn("cost", ledger_cost(F.col("cost"))).join(budgets, "run_id")
    out = []
    for d in ("steps", "tokens", "cost"):
        running = F.sum(d).over(order)
        used = F.least(running, F.col(f"{d}_cap"))
        before = F.least(running - F.col(d), F.col(f"{d}_cap"))
        out += [used.alias(f"{d}_used"), (used - before).alias(f"{d}_applied"), (F.col(d) - (used - before)).alias(f"{d}_over")]
    return rows.select("run_id", "seq", *out, F.sum("wall_clock").over(order).alias("wall_clock_used"))


def over(prefix_used: str = "", suffix_cap: str = "_cap") -> Column:
    """The dimensions in which usage is over its cap, as an array."""
    return F.array_compact(F.array(*(F.when(F.col(f"{prefix_used}{d}") > F.col(f"{d}{suffix_cap}"), d) for d in DIMENSIONS)))


def remaining(rows: DataFrame) -> DataFrame:
    """Budgets less usage, floored at zero."""
    return rows.select("*", *(F.greatest(F.col(f"{d}_cap") - F.col(d), F.lit(0)).alias(f"{d}_left") for d in DIMENSIONS))


def reservation(tasks: DataFrame, goals: DataFrame) -> DataFrame:
    """run_id and the dimensions in which the tasks' budgets together exceed the goal's."""
    total = tasks.groupBy("run_id").agg(*(F.sum(f"{d}_budget").alias(d) for d in DIMENSIONS))
    return total.join(goals, "run_id").select("run_id", over().alias("over"))


def unaffordable(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """task_id and the dimensions in which the run's usage and the task's remainder exceed the run's cap."""
    rows = tasks.join(runs.select("run_id", *(F.col(d).alias(f"run_{d}") for d in DIMENSIONS), *(f"{d}_cap" for d in DIMENSIONS)), "run_id")
    need = [F.when(F.col(f"run_{d}") + F.greatest(F.col(f"{d}_budget") - F.col(f"{d}_used"), F.lit(0)) > F.col(f"{d}_cap"), d) for d in DIMENSIONS]
    return rows.select("task_id", F.array_compact(F.array(*need)).alias("unaffordable"))


def retry_delay(attempts: Column, base: float = 1.0, cap: float = 300.0) -> Column:
    """Seconds before the next attempt: base, doubled with each attempt made, up to cap."""
    doublings = F.least(F.greatest(attempts, F.lit(1)) - 1, F.lit(60))  # the cap is reached long before
    return F.least(F.lit(base) * F.pow(F.lit(2.0), doublings), F.lit(cap))


def stale(tasks: DataFrame, now: str) -> DataFrame:
    """Claimed or running tasks whose lease is over: dead if no attempt is left, else pending."""
    rows = tasks.filter(F.col("state").isin("claimed", "running") & (F.col("lease_expires_at") < F.lit(now).cast("timestamp_ntz")))
    return rows.select("task_id", F.col("state").alias("before"), F.when(F.col("attempts") >= F.col("max_attempts"), "dead").otherwise("pending").alias("after"))


def failure_outcome(failures: DataFrame) -> DataFrame:
    """task_id, state and delay after a failure. failures: task_id, attempts, max_attempts, retryable, affordable."""
    again = F.col("retryable") & (F.col("attempts") < F.col("max_attempts")) & F.col("affordable")
    state = F.when(again, "pending").when(F.col("retryable"), "dead").otherwise("failed")
    return failures.select("task_id", state.alias("state"), F.when(again, retry_delay(F.col("attempts"))).alias("delay"))


def deduplicated(tasks: DataFrame) -> DataFrame:
    """The first task of each run and digest of type and payload."""
    digest = F.sha2(F.concat_ws("\x1f", "task_type", "payload"), 256)
    order = Window.partitionBy("run_id", "digest").orderBy("task_id")
    return tasks.withColumn("digest", digest).withColumn("turn", F.row_number().over(order)).filter("turn = 1").drop("turn")


def idempotent(requests: DataFrame, body: list[str]) -> DataFrame:
    """Requests (key, at, id and body columns) with outcome: created, replayed or conflict."""
    order = Window.partitionBy("key").orderBy("at", "id")
    same = F.struct(*body).eqNullSafe(F.first(F.struct(*body)).over(order))
    return requests.select("*", F.when(F.row_number().over(order) == 1, "created").when(same, "replayed").otherwise("conflict").alias("outcome"))


def single_flight(runs: DataFrame) -> DataFrame:
    """The earliest pending or running run of each goal and payload."""
    open_ = runs.filter(F.col("status").isin("pending", "running"))
    return open_.groupBy("goal", "payload").agg(F.min_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """Of each task the state of its last step; the last write of a step wins."""
    return checkpoints.groupBy("task_id").agg(F.max("step").alias("step"), F.max_by("state", F.struct("step", "updated_at")).alias("state"))


def stale_writers(writes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Writes whose holder and attempt are not the task's, or whose task has ended or is unknown."""
    now = tasks.select("task_id", F.col("claimed_by").alias("holder_now"), F.col("attempts").alias("attempt_now"), "state")
    rows = writes.join(now, "task_id", "left")
    fine = F.col("holder").eqNullSafe(F.col("holder_now")) & F.col("attempt").eqNullSafe(F.col("attempt_now")) & F.coalesce(F.col("state").isin("claimed", "running"), F.lit(False))
    return rows.filter(~fine).select(*writes.columns)


def model_cost(calls: DataFrame, prices: DataFrame, *by: str) -> DataFrame:
    """Cost of calls (alias, tokens_in, tokens_out): the dearest of the alias's bindings."""
    dear = calls.join(prices, "alias", "left").groupBy("call_id", *by).agg(F.max(F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")).alias("cost"))
    return dear.groupBy(*by).agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("calls"))


def unaudited(mutations: DataFrame, audits: DataFrame) -> DataFrame:
    """Mutations (entity_type, entity_id) without an audit row."""
    return mutations.join(audits, ["entity_type", "entity_id"], "left_anti")


def audit_counts(audits: DataFrame) -> DataFrame:
    return audits.groupBy("entity_type").agg(F.count(F.lit(1)).alias("rows"))


def trace_gaps(tasks: DataFrame, spans: DataFrame) -> DataFrame:
    """Tasks without a span on their run's trace, or with generation spans that lack a prompt version."""
    own = spans.groupBy("task_id", "trace_id").agg(F.count(F.lit(1)).alias("spans"), F.count_if((F.col("kind") == "generation") & F.col("prompt_version").isNull()).alias("unversioned"))
    rows = tasks.join(own, ["task_id", "trace_id"], "left")
    gap = F.when(F.col("spans").isNull(), "no_span").when(F.col("unversioned") > 0, "no_prompt_version")
    return rows.withColumn("gap", gap).filter("gap is not null").select("task_id", "gap")


def trace_id(seed: Column) -> Column:
    return F.substring(F.sha2(seed, 256), 1, 32)
