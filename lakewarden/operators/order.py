"""Running sums over a whole table in an order, without a window that sees the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.streaming import streams


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: it is computed once, and its partitions stay as they were."""
    path = streams.folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: str, *sums: str) -> DataFrame:
    """df with run_<column> for each of sums: its total over all rows up to this one. Values of order are unique.

    Rows are dealt by ranges of the order; within a range they are summed in a window, and each range adds what those before it hold. Only one row
    for each range meets in one task.
    """
    dealt = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    rows = staged(dealt, "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(*(F.sum(c).alias(f"_sum_{c}") for c in sums))
    shift = staged(totals.select("_part", *(F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums)), "totals")
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", *(F.sum(c).over(within).alias(f"_run_{c}") for c in sums)).join(shift, "_part")
    return summed.select(*df.columns, *((F.col(f"_run_{c}") + F.col(f"_before_{c}")).alias(f"run_{c}") for c in sums))
