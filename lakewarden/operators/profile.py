"""Profiles: counts, ratios, typed extrema and top values of every column of a table, masked, in one distributed pass.

Empty tables have counts and ratios of zero and no extrema; nulls are counted, never profiled as values.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions import text
from lakewarden.streaming import streams

#: Values of more characters are grouped by a digest and their first characters, so that long texts are not shuffled.
LONG = 256
#: Places of what is no top value, among a column's rows.
LOW, HIGH, DISTINCT = -1, -2, -3


def orderable(kind: T.DataType) -> bool:
    """Whether the engine has an order, and so min and max, for a type."""
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def rendered(name: str, kind: T.DataType) -> Column:
    """A column's values as text."""
    column = F.col(f"`{name.replace('`', '``')}`")
    return F.to_json(column) if isinstance(kind, (T.MapType, T.VariantType)) else column.cast("string")


def may_be_long(kind: T.DataType) -> bool:
    """Whether values of a type can have more than LONG characters as text; those of numbers, times and the like have not."""
    return not isinstance(kind, T.AtomicType) or isinstance(kind, (T.StringType, T.BinaryType, T.VariantType))


def long_form(df: DataFrame, which: Callable[[T.DataType], bool] = lambda kind: True) -> DataFrame:
    """(ordinal, value): each non-null value of each column, or of those of some types, as text."""
    pairs = [F.struct(F.lit(i).alias("ordinal"), rendered(f.name, f.dataType).alias("value")) for i, f in enumerate(df.schema, 1) if which(f.dataType)]
    return df.select(F.explode(F.array(*pairs)).alias("pair")).select("pair.*").filter("value is not null")


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def extrema(df: DataFrame) -> DataFrame:
    """One row: row_count, and of each column the values that are there and its least and greatest one, in its own type (n1, low1, high1, n2, ...)."""
    aggregates = [F.count(F.lit(1)).alias("row_count")]
    for i, f in enumerate(df.schema, 1):
        ends = [g(quoted(f.name)) if orderable(f.dataType) else F.lit(None).cast("string") for g in (F.min, F.max)]
        aggregates += [F.count(quoted(f.name)).alias(f"n{i}"), ends[0].alias(f"low{i}"), ends[1].alias(f"high{i}")]
    return df.agg(*aggregates)


def described(found: DataFrame, schema: T.StructType) -> DataFrame:
    """(ordinal, name, data_type, row_count, present, low, high): what extrema gives, as one row for each column."""
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col("row_count"),
            F.col(f"n{i}").alias("present"), F.col(f"low{i}").cast("string").alias("low"), F.col(f"high{i}").cast("string").alias("high"),
        )
        for i, f in enumerate(schema, 1)
    ]
    return found.select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def statistics(df: DataFrame) -> DataFrame:
    """(ordinal, name, data_type, row_count, present, low, high): one row for each column, from one aggregate over the table."""
    return described(extrema(df), df.schema)


def frequencies(df: DataFrame) -> DataFrame:
    """(ordinal, short, digest, count): how often each value occurs; digest is null for values that are short themselves."""
    value = F.col("value")
    keyed = long_form(df).select("ordinal", F.substring(value, 1, LONG).alias("short"), F.when(F.length(value) > LONG, F.sha2(value, 256)).alias("digest"))
    return keyed.groupBy("ordinal", "short", "digest").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, counted: DataFrame, k: int) -> DataFrame:
    """(ordinal, value, count, place): the k most frequent values of each column, ties by value."""
    near = counted.withColumn("place", F.rank().over(Window.partitionBy("ordinal").orderBy(F.desc("count"), "short"))).filter(F.col("place") <= k).drop("place")
    if not any(may_be_long(f.dataType) for f in df.schema):
        whole = near.select("ordinal", F.col("short").alias("value"), "count")
    else:
        wanted = near.filter("digest is not null").select("ordinal", "digest")
        full = long_form(df, may_be_long).filter(F.length("value") > LONG).select("ordinal", "value", F.sha2("value", 256).alias("digest"))
        full = full.join(wanted, ["ordinal", "digest"], "left_semi").groupBy("ordinal", "digest").agg(F.min("value").alias("value"))
        whole = near.join(full, ["ordinal", "digest"], "left").select("ordinal", F.coalesce("value", "short").alias("value"), "count")
    order = Window.partitionBy("ordinal").orderBy(F.desc("count"), "value")
    return whole.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def raw_counts(df: DataFrame) -> DataFrame:
    """(name, row_count, null_count, null_ratio, distinct_count, distinct_ratio)"""
    if not df.columns:
        return df.agg(F.count(F.lit(1)).alias("row_count")).filter("false").selectExpr("'' as name", "row_count", "row_count as null_count", "cast(0 as decimal(20,6)) as null_ratio", "row_count as distinct_count", "cast(0 as decimal(20,6)) as distinct_ratio")
    distinct = frequencies(df).groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct_count"))
    joined = statistics(df).join(distinct, "ordinal", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
    nulls = F.col("row_count") - F.col("present")
    return joined.select("name", "row_count", nulls.alias("null_count"), text.ratio(nulls, F.col("row_count")).alias("null_ratio"), "distinct_count", text.ratio(F.col("distinct_count"), F.col("row_count")).alias("distinct_ratio"))


def row_count(df: DataFrame) -> DataFrame:
    """Rows of a table, also of one without columns."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def vote(types: Column) -> Column:
    """A column's type from its samples' types: empty ones abstain; none is unknown, several are mixed."""
    kinds = F.array_distinct(F.filter(types, lambda t: t != "empty"))
    return F.when(F.size(kinds) == 0, "unknown").when(F.size(kinds) > 1, "mixed").otherwise(F.element_at(kinds, 1))


def profile(df: DataFrame, k: int = 5) -> DataFrame:
    """One row for each column, in the table's order: its counts and ratios, masked extrema and top values, and its semantic type."""
    counted = frequencies(df)
    return assembled(statistics(df), distinct_counts(counted), top_values(df, counted, k))


@functools.cache
def masked_value() -> Column:
    """The mask of a column named value: some thousand calls build it, so it is built once."""
    return text.mask(F.col("value"))


def distinct_counts(counted: DataFrame, *keys: str) -> DataFrame:
    """(keys, ordinal, count): distinct values of each column. Every value counts, but by all that top values need of it, so that both read the one exchange of the frequencies."""
    there = F.col("count") > 0
    there = there & (F.col("digest").isNull() | F.col("long").isNotNull()) if "long" in counted.columns else there
    return counted.groupBy(*keys, "ordinal").agg(F.count_if(there).alias("count"))


def assembled(stats: DataFrame, distinct: DataFrame, tops: DataFrame, *keys: str) -> DataFrame:
    """A profile from its parts: statistics, distinct counts and top values; with keys, the profiles of all tables that these tell apart.

    A column of one or two distinct values publishes the constant mask alone, so that no mask tells them apart.
    """
    # Facts, extrema and top values of a column as rows, so that every value is masked by one expression.
    facts = ["name", "data_type", "row_count", "present"]
    no = lambda *names: [F.lit(None).cast({"count": "bigint", "row_count": "bigint", "present": "bigint"}.get(n, "string")).alias(n) for n in names]
    part = lambda place, value: F.struct(F.lit(place).alias("place"), value.alias("value"))
    ends = F.array(part(LOW, F.col("low")), part(HIGH, F.col("high")))
    rows = stats.select(*keys, "ordinal", *facts, F.explode(ends).alias("p")).select(*keys, "ordinal", "p.place", "p.value", *no("count"), *facts)
    rows = rows.unionByName(distinct.select(*keys, "ordinal", F.lit(DISTINCT).alias("place"), *no("value"), "count", *no(*facts)))
    rows = rows.unionByName(tops.select(*keys, "ordinal", "place", "value", "count", *no(*facts)))
    masked = rows.withColumn("masked", masked_value())
    only = lambda place, c: F.max(F.when(F.col("place") == place, F.col(c)))
    top = F.when(F.col("place") > 0, F.struct("place", F.col("masked").alias("value"), "count"))
    rows = masked.groupBy(*keys, "ordinal").agg(
        *(F.max(c).alias(c) for c in facts), F.coalesce(only(DISTINCT, "count"), F.lit(0)).alias("distinct_count"),
        only(LOW, "masked").alias("low"), only(HIGH, "masked").alias("high"), F.array_sort(F.collect_list(top)).alias("tops"),  # k tops a column
    )
    rows = rows.withColumn("semantic_type", vote(F.transform("tops", lambda t: t["value"]["semantic_type"])))
    hidden = F.struct(F.lit(text.RUN).alias("masked"), F.col("semantic_type"), F.lit(None).cast("int").alias("length"))
    low = F.col("distinct_count").between(1, text.LOW_CARDINALITY) | F.size("tops").between(1, text.LOW_CARDINALITY)
    extremum = lambda c: F.when(F.col(c).isNull(), F.lit(None)).when(low, hidden).otherwise(F.col(c))
    shown = F.transform("tops", lambda t: F.struct(F.when(low, hidden).otherwise(t["value"]).alias("value"), t["count"].alias("count")))
    nulls = F.col("row_count") - F.col("present")
    return rows.select(
        *keys, "ordinal", "name", "data_type", "row_count", nulls.alias("null_count"), text.ratio(nulls, F.col("row_count")).alias("null_ratio"),
        "distinct_count", text.ratio(F.col("distinct_count"), F.col("row_count")).alias("distinct_ratio"),
        extremum("low").alias("min_value"), extremum("high").alias("max_value"), shown.alias("top_values"), "semantic_type",
    ).orderBy(*keys, "ordinal")


class State:
    """What a profile of all rows so far can be read from, as deltas in a folder: one for each batch, merged as they are read.

    A delta holds a batch's counts and typed extrema in one row, and its values with how often they occur, long ones with their digest. Counts add up, extrema
    are taken again, and equal values meet by their first characters and digest, so that deltas may come in any order. A batch whose id comes again replaces its
    delta. `compact` merges deltas into a new generation, which counts once it is whole and listed. Only counts are shuffled, never rows. All batches have one schema;
    one process writes a state.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        listed = streams.stored(spark, f"{path}/generations", "generation long").agg(F.max("generation")).first()[0]
        self.generation = listed or 0

    def _folder(self, part: str, generation: int) -> str:
        return f"{self.path}/generation-{generation}/{part}"

    def add(self, batch: DataFrame, batch_id: int) -> None:
        value = F.col("value")
        keyed = long_form(batch).select("ordinal", F.substring(value, 1, LONG).alias("short"), F.when(F.length(value) > LONG, F.sha2(value, 256)).alias("digest"), F.when(F.length(value) > LONG, value).alias("long"))
        self._write(extrema(batch), keyed.groupBy("ordinal", "short", "digest").agg(F.count(F.lit(1)).alias("count"), F.min("long").alias("long")), batch_id, self.generation)

    def _write(self, ends: DataFrame, values: DataFrame, batch_id: int, generation: int) -> None:
        ends.write.mode("overwrite").parquet(f"{self._folder('extrema', generation)}/batch={batch_id}")
        values.write.mode("overwrite").parquet(f"{self._folder('values', generation)}/batch={batch_id}")

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(self._folder(part, self.generation))

    @staticmethod
    def _extrema(found: DataFrame) -> DataFrame:
        merge = {"n": F.sum, "l": F.min, "h": F.max, "r": F.sum}
        return found.agg(*(merge[c[0]](c).alias(c) for c in found.columns if c != "batch"))

    @staticmethod
    def _values(found: DataFrame) -> DataFrame:
        """(ordinal, short, digest, count, long): the frequencies; long is the whole of a long value."""
        return found.groupBy("ordinal", "short", "digest").agg(F.sum("count").alias("count"), F.min("long").alias("long"))

    def compact(self, before: int) -> None:
        """Writes the deltas of batches before a number, which must not come again, as one delta of a new generation, and the others as they are."""
        ends, values, new = self._read("extrema"), self._read("values"), self.generation + 1
        old = F.col("batch") < before
        self._write(self._extrema(ends.filter(old)), self._values(values.filter(old)), before - 1, new)
        for (batch,) in ends.filter(~old).select("batch").distinct().collect():  # those few that have come since
            self._write(*(df.filter(F.col("batch") == batch).drop("batch") for df in (ends, values)), batch, new)
        self.spark.createDataFrame([(new,)], "generation long").write.mode("append").parquet(f"{self.path}/generations")
        self.generation = new

    def profile(self, k: int = 5) -> DataFrame:
        """The profile of all rows so far, as `profile` gives it for a table of them."""
        values = self._values(self._read("values"))
        near = values.withColumn("place", F.rank().over(Window.partitionBy("ordinal").orderBy(F.desc("count"), "short"))).filter(F.col("place") <= k)
        whole = near.select("ordinal", F.coalesce("long", "short").alias("value"), "count")
        place = F.row_number().over(Window.partitionBy("ordinal").orderBy(F.desc("count"), "value"))
        tops = whole.withColumn("place", place).filter(F.col("place") <= k)
        return assembled(described(self._extrema(self._read("extrema")), self.schema), distinct_counts(values), tops)


def flat(profiled: DataFrame) -> DataFrame:
    """A profile with its structs written as text, for reports and comparisons."""
    shown = lambda s: F.concat_ws("|", s["masked"], s["semantic_type"], F.coalesce(s["length"].cast("string"), F.lit("-")))
    tops = F.array_join(F.transform("top_values", lambda t: F.concat_ws("|", shown(t["value"]), t["count"])), ";")
    value = lambda c: F.when(F.col(c).isNotNull(), shown(F.col(c))).alias(c)
    keys = ["table_name"] if "table_name" in profiled.columns else []
    return profiled.select(*keys, "ordinal", "name", "row_count", "null_count", "null_ratio", "distinct_count", "distinct_ratio", value("min_value"), value("max_value"), tops.alias("top_values"), "semantic_type")


def table_document(profiled: DataFrame) -> DataFrame:
    """One row: row_count and columns, an array of structs in column order."""
    fields = [c for c in profiled.columns if c != "row_count"]
    columns = F.array_sort(F.collect_list(F.struct("ordinal", *[c for c in fields if c != "ordinal"])))
    return profiled.agg(F.coalesce(F.max("row_count"), F.lit(0)).alias("row_count"), columns.alias("columns"))


def profile_estate(tables: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """The profiles of many tables as one frame with a column table_name; masks are built and run once for all of them."""
    parts = []
    for name, df in sorted(tables.items()):
        counted = frequencies(df)
        parts.append([part.withColumn("table_name", F.lit(name)) for part in (statistics(df), distinct_counts(counted), top_values(df, counted, k))])
    return assembled(*(reduce(DataFrame.unionByName, same) for same in zip(*parts, strict=True)), "table_name")


def digest(*columns: str) -> Column:
    """sha-256 of the columns as canonical JSON: sorted names, nulls kept."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def state_digest(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """rows and an order-insensitive digest of a table without its ids and clocks; equal tables give equal rows."""
    kept = [c for c in df.columns if c not in drop]
    row = F.conv(F.substring(F.md5(F.to_json(F.struct(*sorted(kept)), {"ignoreNullFields": "false"})), 1, 15), 16, 10)  # 60 bits of it
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))
