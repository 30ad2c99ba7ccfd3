"""Append-only versions: the latest, a new one only if the digest differs, one at a version, and the state as of a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(versions: DataFrame, key: str = "asset_id", version: str = "version") -> DataFrame:
    """The row of the highest version of each key."""
    best = versions.groupBy(key).agg(F.max_by(F.struct(*versions.columns), version).alias("row"))
    return best.select("row.*")


def record(computed: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows to append: (asset_id, digest, ...) whose digest differs from the latest version's, numbered from there."""
    last = versions.groupBy("asset_id").agg(F.max("version").alias("last"), F.max_by("digest", "version").alias("last_digest"))
    joined = computed.join(last, "asset_id", "left").filter(~F.col("digest").eqNullSafe(F.col("last_digest")))
    return joined.withColumn("version", F.coalesce("last", F.lit(0)) + 1).drop("last", "last_digest")


def in_order(versions: DataFrame, newest_first: bool = False) -> DataFrame:
    return versions.orderBy("asset_id", F.desc("version") if newest_first else F.asc("version"))


def at_version(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of exactly the wanted (asset_id, version)."""
    return versions.join(wanted.select("asset_id", "version"), ["asset_id", "version"], "left_semi")


def asset_states(assets: DataFrame, versions: DataFrame) -> DataFrame:
    """asset_id, lifecycle and latest_version (0 if there is none)."""
    last = versions.groupBy("asset_id").agg(F.max("version").alias("latest_version"))
    return assets.select("asset_id", "lifecycle").join(last, "asset_id", "left").withColumn("latest_version", F.coalesce("latest_version", F.lit(0)))


def as_of(versions: DataFrame, moment: str) -> DataFrame:
    """The latest version of each asset at a moment."""
    return latest(versions.filter(F.col("created_at") <= F.lit(moment).cast(versions.schema["created_at"].dataType)))


def as_of_each(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """For each request (request_id, asset_id, at) the version that stood then, or null: one sort by asset and time instead of a range join."""
    rows = versions.select("asset_id", F.col("created_at").alias("at"), F.lit(0).alias("side"), "version", F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"))
    asked = requests.select("asset_id", "at", F.lit(1).alias("side"), F.lit(None).cast(versions.schema["version"].dataType).alias("version"), "request_id")
    before = Window.partitionBy("asset_id").orderBy("at", "side", "version").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(asked).withColumn("version", F.last("version", ignorenulls=True).over(before))
    return found.filter("side = 1").select("request_id", "asset_id", "at", "version")
