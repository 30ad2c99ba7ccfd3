"""Streams: task states with leases, usage clamped charge by charge, request deduplication, cumulated profiles and health over time.

Watermarks need timestamps with a zone; cast event times first. Rows older than the watermark are late and dropped, so files must arrive in order of event
time, but for the delay. The keyed states need the RocksDB state store (`rocks`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lakewarden.operators import history, profile
from lakewarden.streaming import streams

TASK = "task_id long, state string, attempts long, at timestamp"
ENDED = ("done", "failed", "dead", "cancelled")
LEASED = ("claimed", "running")
STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """While a query is started: the state store that keyed states need."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


#: Shards that keyed states are kept in: a call of a state takes about a millisecond, whether it holds one key or thousands.
SHARDS = 128


def shard(key: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard")


class TaskFold(StatefulProcessor):
    """The last states of a shard's tasks, as one value, and a timer for what is next: the end of a lease, or of the memory of an ended task."""

    def __init__(self, lease_ms: int, max_attempts: int, keep_ms: int) -> None:
        self.lease_ms, self.max_attempts, self.keep_ms = lease_ms, max_attempts, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "task_id array<long>, state array<string>, attempts array<long>, ms array<long>, seq array<long>")

    def _held(self) -> pd.DataFrame:
        parts = self.held.get() if self.held.exists() else ([], [], [], [], [])
        return pd.DataFrame({c: pd.Series(list(x), dtype="object" if c == "state" else "int64") for c, x in zip(("task_id", "state", "attempts", "ms", "seq"), parts, strict=True)})

    def _hold(self, held: pd.DataFrame) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if held.empty:
            self.held.clear()
            return
        self.held.update(tuple(held[c].tolist() for c in ("task_id", "state", "attempts", "ms", "seq")))
        due = self._due(held).min()
        if pd.notna(due):
            self.handle.registerTimer(int(due))

    def _due(self, held: pd.DataFrame) -> pd.Series:
        waits = pd.Series(np.nan, held.index, dtype="float64").mask(held["state"].isin(ENDED), self.keep_ms + 1).mask(held["state"].isin(LEASED), self.lease_ms + 1)
        return held["ms"] + waits

    def _lapsed(self, held: pd.DataFrame) -> pd.DataFrame:
        """The states that follow when the leases of these are over."""
        return held.assign(state=np.where(held["attempts"] >= self.max_attempts, "dead", "pending"), ms=held["ms"] + self.lease_ms, seq=-1)

    @staticmethod
    def _rows(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"task_id": rows["task_id"], "state": rows["state"], "attempts": rows["attempts"], "at": pd.to_datetime(rows["ms"], unit="ms")}).reset_index(drop=True)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # a shard's rows of one batch are those since the last trigger
        given = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        given = pd.DataFrame({"task_id": given["task_id"].astype("int64"), "state": given["state"], "attempts": given["attempts"].astype("int64"), "ms": given["at"].astype("datetime64[us]").astype("int64") // 1000, "seq": given["seq"].astype("int64"), "new": True})
        every = pd.concat([self._held().assign(new=False), given], ignore_index=True).sort_values("task_id", kind="stable", ignore_index=True)
        # What is not after all that its task had before, by (ms, seq), changes nothing: times ascend but for the held one's.
        top = every.groupby("task_id")["ms"].cummax()
        newest = every["seq"].where(every["ms"] == top).groupby([every["task_id"], top]).cummax().groupby([every["task_id"], top]).shift()
        every = every[~every["new"] | ((every["ms"] == top) & ~(newest >= every["seq"]))].reset_index(drop=True)
        # A lease that was over before its task's next row lapses between the two.
        over = (every["task_id"] == every["task_id"].shift(-1)) & every["state"].isin(LEASED) & (every["ms"].shift(-1) > every["ms"] + self.lease_ms)
        every = pd.concat([every, self._lapsed(every[over]).assign(new=True)]).sort_index(kind="stable").reset_index(drop=True)
        # What has ended stays ended.
        ends = every["state"].isin(ENDED).astype("int64")
        every = every[ends.groupby(every["task_id"]).cumsum() - ends == 0]
        self._hold(every.groupby("task_id").tail(1))
        if every["new"].any():
            yield self._rows(every[every["new"]])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self._held()
        due = self._due(held) <= expiredTimerInfo.getExpiryTimeInMs()
        lapsed = self._lapsed(held[due & held["state"].isin(LEASED)])
        self._hold(pd.concat([held[~due], lapsed]))
        if not lapsed.empty:
            yield self._rows(lapsed)

    def close(self) -> None:
        pass


def fold_tasks(events: DataFrame, lease_ms: int, max_attempts: int = 3, delay: str = "0 seconds", keep_ms: int = 0, shards: int = SHARDS) -> DataFrame:
    """Each state that a task takes, and when; a claimed or running task whose lease ends in event time becomes pending, or dead without attempts left.

    events: task_id, state, attempts, at, and optionally seq, which orders rows of one time. A lease that ends before the task's next row is over whether its timer has run by then or not, so
    that batches do not matter. An ended task stays ended: it is remembered until the watermark is keep_ms past its end; rows of before its end are late by
    then. State: one row of a few bytes for each task that is open or remembered, in shards by the task's hash: a batch reads and writes those it meets, and sorts
    their rows. A checkpoint goes with its number of shards.
    """
    rows = events if "seq" in events.columns else events.withColumn("seq", F.lit(0).cast("bigint"))
    keyed = rows.select(shard("task_id", shards), "task_id", "state", "attempts", "at", "seq").withWatermark("at", delay).groupBy("shard")
    return keyed.transformWithStateInPandas(TaskFold(lease_ms, max_attempts, keep_ms), TASK, "Update", "EventTime")


CAPPED = ("steps", "tokens", "cost")
CHARGED = "run_id long, seq long, " + ", ".join(f"{d}_used long, {d}_applied long, {d}_over long" for d in CAPPED) + ", wall_clock_used long"


class UsageClamp(StatefulProcessor):
    """What a shard's runs have used so far, in whole units; costs are in millionths."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", ", ".join(f"{c} array<long>" for c in ("run_id", *CAPPED, "wall_clock")))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values(["run_id", "seq", "task_id"], kind="stable")
        parts = self.used.get() if self.used.exists() else ([],) * 5
        used = pd.DataFrame({c: np.array(x, np.int64) for c, x in zip(("run_id", *CAPPED, "wall_clock"), parts, strict=True)}).set_index("run_id")
        runs, first, sizes = np.unique(given["run_id"].to_numpy(np.int64), return_index=True, return_counts=True)
        last, before = first + sizes - 1, used.reindex(runs, fill_value=0)

        def summed(column: str) -> np.ndarray:
            """What each run had before, and its charges up to each."""
            charge = given[column].to_numpy(np.int64)
            total = np.cumsum(charge)
            return total + np.repeat(before[column].to_numpy(np.int64) - (total - charge)[first], sizes)

        out: dict[str, Any] = {"run_id": np.repeat(runs, sizes), "seq": given["seq"].to_numpy(np.int64)}
        ends = {}
        for d in CAPPED:
            charge = given[d].to_numpy(np.int64)
            # charges are not negative, so that min(used + x, cap), charge by charge, is the least of the running sum and the cap
            after = np.minimum(summed(d), given[f"{d}_cap"].to_numpy(np.int64))
            applied = np.diff(after, prepend=0)
            applied[first] = after[first] - np.minimum(before[d].to_numpy(np.int64), after[first])
            out |= {f"{d}_used": after, f"{d}_applied": applied, f"{d}_over": charge - applied}
            ends[d] = after[last]
        out["wall_clock_used"] = summed("wall_clock")
        ends["wall_clock"] = out["wall_clock_used"][last]
        held = pd.concat([used[~used.index.isin(runs)], pd.DataFrame(ends, index=runs)])
        self.used.update((held.index.tolist(), *(held[c].tolist() for c in (*CAPPED, "wall_clock"))))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def clamp_usage(charges: DataFrame, budgets: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Each charge with what is used after it, what of it was applied and what was overspent, in every capped dimension, as ledger.clamped gives them for a table.

    charges: run_id, task_id, seq, steps, tokens, cost, wall_clock; budgets: run_id and a cap of steps, tokens and cost, a table. Charges arrive in order of seq from batch to batch; within a
    batch they are sorted. Wall clock is summed, not capped. State: four numbers for each run, in shards by the run's hash; a shard's charges of one batch are one group,
    bounded by what a trigger takes. A checkpoint goes with its number of shards.
    """
    millionths = lambda c: (F.round(F.col(c), 6) * 1_000_000).cast("bigint").alias(c)
    rows = charges.select("run_id", "task_id", "seq", "steps", "tokens", millionths("cost"), "wall_clock").join(budgets.select("run_id", "steps_cap", "tokens_cap", millionths("cost_cap")), "run_id")
    found = rows.select(shard("run_id", shards), "*").groupBy("shard").transformWithStateInPandas(UsageClamp(), CHARGED, "Append", "None")
    money = [(F.col(f"cost_{x}") / 1_000_000).cast("decimal(20,6)").alias(f"cost_{x}") for x in ("used", "applied", "over")]
    return found.select(*(c for c in found.columns if not c.startswith("cost_")), *money)


def usage_totals(charges: DataFrame, caps: DataFrame | None = None) -> DataFrame:
    """Running totals of each run, in update mode; with caps (run_id, cost_cap) what is used stops at them."""
    totals = charges.groupBy("run_id").agg(F.sum("steps").alias("steps"), F.sum("cost").alias("cost"))
    return totals if caps is None else totals.join(caps, "run_id").withColumn("cost_used", F.least("cost", "cost_cap"))


def first_requests(requests: DataFrame, within: str) -> DataFrame:
    """Requests without repeats of a key within a time."""
    return requests.withWatermark("at", within).dropDuplicatesWithinWatermark(["key"])


def health(tasks: DataFrame, width: str = "1 hour", delay: str = "0 seconds") -> DataFrame:
    """start, events, dead and oldest_seconds of each window of event time, once it is closed (append mode). tasks: at, state, age_seconds.

    A window is closed when the watermark, the newest time less the delay, reaches its end. A late row counts as long as its window is open and is dropped after that.
    """
    counted = tasks.withWatermark("at", delay).groupBy(F.window("at", width))
    found = counted.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("state") == "dead").alias("dead"), F.max("age_seconds").alias("oldest_seconds"))
    return found.select(F.col("window.start").alias("start"), "events", "dead", "oldest_seconds")


VERSIONS = "asset_id string, version long, digest string, row_count long, batch_id long"


def record_profiles(path: str, asset_id: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds the batch to the asset's profile state under `path`/state and appends a version of the profile of all rows so far to `path`/versions if its digest is new.

    A batch id that comes again replaces what it has added, and so changes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = profile.State(spark, f"{path}/state", batch.schema)
        state.add(batch, batch_id)
        stored = streams.stored(spark, f"{path}/versions", VERSIONS).filter(F.col("asset_id") == asset_id)
        document = profile.table_document(state.profile())
        computed = document.select(F.lit(asset_id).alias("asset_id"), profile.digest("row_count", "columns").alias("digest"), "row_count", F.lit(batch_id).cast("long").alias("batch_id"))
        fresh = history.record(computed, stored)
        fresh.select("asset_id", F.col("version").cast("long").alias("version"), "digest", "row_count", "batch_id").write.mode("append").parquet(f"{path}/versions")

    return run
