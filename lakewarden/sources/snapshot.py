"""One snapshot of a table of files for all passes over it: a manifest is fixed first, every scan reads its files alone, and a file that has changed since is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.operators import order, profile

MANIFEST = ["path", "length", "modificationTime"]


class Changed(RuntimeError):
    """A file of a snapshot is gone or is not what it was."""


class Snapshot:
    """The files of a table as they are listed now: path, length and time of each. Files that are added later are not part of it."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = "*.parquet") -> None:
        self.spark = spark
        # only names and sizes are listed; contents are not read
        listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(*MANIFEST)
        self.files = [tuple(r) for r in listed.orderBy("path").collect()]  # the driver lists a table's files for any scan
        if not self.files:
            raise FileNotFoundError(path)

    def manifest(self) -> DataFrame:
        return self.spark.createDataFrame(self.files, "path string, length bigint, modificationTime timestamp")

    def table(self) -> DataFrame:
        """The table, of the snapshot's files alone."""
        return self.spark.read.parquet(*(f[0] for f in self.files))

    def check(self) -> None:
        """Raises Changed if a file is gone, or has another length or time."""
        try:
            now = self.spark.read.format("binaryFile").load([f[0] for f in self.files]).select(*MANIFEST)
            held = {tuple(r) for r in now.collect()}
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            raise Changed("a file is gone") from error
        if other := sorted(f[0] for f in set(self.files) - held):
            raise Changed(f"changed since the snapshot: {other[0]} and {len(other) - 1} more")


def profile_snapshot(snapshot: Snapshot, k: int = 5) -> DataFrame:
    """The profile of a snapshot: all its passes read the same files. The result is written before they are looked at again, so that what is returned was read from unchanged files."""
    found = order.staged(profile.profile(snapshot.table(), k), "profile")
    snapshot.check()
    return found.orderBy(F.col("ordinal"))
