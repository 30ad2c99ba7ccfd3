"""Drift of a numeric column between two samples, exactly: stability index over quantile bins and the Kolmogorov-Smirnov distance.

Both are read from one table of distinct values with how often each sample has them, in order, with running counts. Nulls are left out; NaN is a value, above all others;
ties are one value. A sample without values has no drift to speak of: the result is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.operators import order


def counted(base: DataFrame, now: DataFrame, column: str) -> DataFrame:
    """(value, a, b, run_a, run_b): how often each value occurs in either sample, and how often it or a smaller one does."""
    both = base.select(F.col(column).alias("value"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(now.select(F.col(column).alias("value"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = both.filter("value is not null").groupBy("value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return order.staged(order.running(counts, "value", "a", "b"), "values")


def distance(values: DataFrame) -> DataFrame:
    """n_base, n_now and ks, the largest difference of the two distribution functions, to nine places. values: as counted gives them."""
    totals = values.agg(F.sum("a").alias("n_base"), F.sum("b").alias("n_now"))
    apart = F.abs(F.try_divide("run_a", "n_base") - F.try_divide("run_b", "n_now"))
    rows = totals.join(values.select("run_a", "run_b"), F.lit(True), "left")  # totals are one row
    return rows.groupBy("n_base", "n_now").agg(F.round(F.max(apart), 9).alias("ks"))


def edges(values: DataFrame, bins: int) -> DataFrame:
    """One row: the distinct inner edges of bins that hold equal shares of the base; the value at a quantile is the smallest that so many rows do not exceed."""
    total = values.agg(F.sum("a").alias("n"))
    reached = [F.min(F.when(F.col("run_a") * bins >= F.col("n") * q, F.col("value"))) for q in range(1, bins)]
    return values.join(F.broadcast(total)).agg(F.array_sort(F.array_distinct(F.array_compact(F.array(*reached)))).alias("edges"))  # total is one row


def binned(values: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, a, b): rows of either sample above that many edges; a value at an edge is below it."""
    rows = values.join(F.broadcast(edges(values, bins)))  # edges are one row
    place = F.size(F.filter("edges", lambda e: e < F.col("value")))
    return rows.groupBy(place.alias("bin")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def stability(values: DataFrame, bins: int = 10) -> DataFrame:
    """psi to six places; an empty bin counts as half a row, as for categories."""
    held = binned(values, bins).select(*(F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(0.5)).cast("double").alias(c) for c in "ab"))
    sums = held.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.col("a") / F.col("ta"), F.col("b") / F.col("tb")
    some = values.agg((F.max("run_a") > 0) & (F.max("run_b") > 0)).toDF("some")
    found = held.join(F.broadcast(sums)).agg(F.round(F.sum((q - p) * F.log(q / p)), 6).alias("psi"))
    return found.join(F.broadcast(some)).select(F.when(F.col("some"), F.col("psi")).alias("psi"))  # all of these are one row
