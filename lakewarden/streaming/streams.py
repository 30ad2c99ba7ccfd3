"""Where streams keep their state and rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares, as spark.checkpoint.dir names it. Where it is unset, a temporary one if all runs in one process (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lakewarden-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table of a given schema; an empty one if nothing has been written there yet."""
    found = spark.read.schema(schema)
    try:
        table = found.parquet(path)
        table.isEmpty()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    return table


def fed(df: DataFrame, key: str, parts: int, name: str, drain: Callable[[DataFrame, str], None], late: DataFrame | None = None) -> str:
    """Writes a table's rows in so many parts by ascending key, one after the other, and drains a stream of the files after each: so files come in order, and each part is a batch.

    drain(stream, folder) runs the stream to its end, with its state in the folder, which is returned. late: rows that come with the last part.
    """
    spark = df.sparkSession
    home = folder(spark, name)
    edges = df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    for part in range(parts):
        above = F.lit(True) if part == 0 or not edges else F.col(key) > F.lit(edges[part - 1])
        upto = F.lit(True) if part == parts - 1 or not edges else F.col(key) <= F.lit(edges[part])
        rows = df.filter(above & upto) if edges or part == 0 else df.limit(0)
        rows = rows.unionByName(late) if late is not None and part == parts - 1 else rows
        rows.write.mode("append").parquet(f"{home}/source")
        drain(spark.readStream.schema(df.schema).parquet(f"{home}/source"), home)
    return home
