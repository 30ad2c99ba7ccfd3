"""Catalog convergence: what changes when an observed schema meets the stored one, and the state after it.

observed: schema_name, name, asset_type, column_name, data_type, ordinal, nullable. A table without columns is a row without a column.
stored: the same with asset_lifecycle and column_lifecycle. Keys are unique in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSET = ["schema_name", "name"]
COLUMN = [*ASSET, "column_name"]


def asset_changes(observed: DataFrame, stored: DataFrame) -> DataFrame:
    """insert_asset, update_asset and missing_asset rows with type and lifecycle before and after; unchanged assets have none."""
    new = observed.groupBy(*ASSET).agg(F.min("asset_type").alias("type_after"))
    old = stored.groupBy(*ASSET).agg(F.min("asset_type").alias("type_before"), F.min("asset_lifecycle").alias("lifecycle_before"))
    both = new.join(old, ASSET, "full_outer")
    change = (
        F.when(F.col("type_before").isNull(), "insert_asset")
        .when(F.col("type_after").isNull() & (F.col("lifecycle_before") == "active"), "missing_asset")
        .when(F.col("type_after").isNotNull() & (~F.col("type_after").eqNullSafe(F.col("type_before")) | (F.col("lifecycle_before") != "active")), "update_asset")
    )
    return both.withColumn("change", change).filter("change is not null").select(*ASSET, "change", "type_before", "type_after", "lifecycle_before")


def column_changes(observed: DataFrame, stored: DataFrame) -> DataFrame:
    """insert_column, update_column and missing_column rows with facts before and after. Columns of assets that were missing already are left."""
    facts = lambda side: F.struct("data_type", "ordinal", "nullable").alias(side)
    new = observed.filter("column_name is not null").select(*COLUMN, facts("after"))
    old = stored.filter("column_name is not null").select(*COLUMN, facts("before"), "column_lifecycle", "asset_lifecycle")
    both = new.join(old, COLUMN, "full_outer")
    change = (
        F.when(F.col("before").isNull(), "insert_column")
        .when(F.col("after").isNull() & (F.col("column_lifecycle") == "active") & (F.col("asset_lifecycle") == "active"), "missing_column")
        .when(F.col("after").isNotNull() & (~F.col("after").eqNullSafe(F.col("before")) | (F.col("column_lifecycle") != "active")), "update_column")
    )
    return both.withColumn("change", change).filter("change is not null").select(*COLUMN, "change", "before", "after")


def plan(observed: DataFrame, stored: DataFrame) -> DataFrame:
    """The whole plan: schema_name, name, column_name (null for assets), change, before, after (JSON). Empty if nothing changed."""
    assets = asset_changes(observed, stored).select(
        *ASSET, F.lit(None).cast("string").alias("column_name"), "change",
        F.when(F.col("type_before").isNotNull(), F.to_json(F.struct(F.col("type_before").alias("asset_type"), F.col("lifecycle_before").alias("lifecycle")))).alias("before"),
        F.when(F.col("type_after").isNotNull(), F.to_json(F.struct(F.col("type_after").alias("asset_type"), F.lit("active").alias("lifecycle")))).alias("after"),
    )
    columns = column_changes(observed, stored).select(*COLUMN, "change", F.to_json("before").alias("before"), F.to_json("after").alias("after"))
    return assets.unionByName(columns)


def stable_order(planned: DataFrame) -> DataFrame:
    return planned.orderBy(*ASSET, F.col("column_name").asc_nulls_first(), "change")


def apply(observed: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored table after the plan: what was not observed is missing, the rest active with its new facts; ids of stored rows stay."""
    ids = [c for c in ("asset_id", "column_id") if c in stored.columns]
    facts = ["asset_type", "data_type", "ordinal", "nullable"]
    # The row of a table without columns goes by the empty name, and away once the table has columns.
    named = lambda df: df.withColumn("column_name", F.coalesce("column_name", F.lit("")))
    filled = observed.filter("column_name is not null").select(*ASSET).distinct()
    bare = stored.filter("column_name is null").join(filled, ASSET, "left_anti")
    observed, stored = named(observed), named(stored.filter("column_name is not null").unionByName(bare))
    # A missing column keeps the asset's lifecycle unless the asset is gone too.
    seen = observed.select(*ASSET).distinct().withColumn("asset_seen", F.lit(True))
    both = observed.select(*COLUMN, *(F.col(c).alias(f"new_{c}") for c in facts)).join(stored, COLUMN, "full_outer").join(seen, ASSET, "left")
    here = F.col("new_asset_type").isNotNull()
    types = observed.groupBy(*ASSET).agg(F.min("asset_type").alias("now_type"))
    both = both.join(types, ASSET, "left")
    key = lambda *c: F.sha2(F.concat_ws("\x1f", *c), 256)
    made = {"asset_id": key(*ASSET), "column_id": key(*COLUMN)}
    asset_life = F.when(F.col("asset_seen"), "active").when(F.col("asset_lifecycle") == "active", "missing").otherwise(F.col("asset_lifecycle"))
    column_life = F.when(here, "active").when((F.col("column_lifecycle") == "active") & (F.coalesce(F.col("asset_seen"), F.lit(False)) | (F.col("asset_lifecycle") == "active")), "missing").otherwise(F.col("column_lifecycle"))
    return both.select(
        *(F.coalesce(F.col(c), made[c]).alias(c) for c in ids), *ASSET, F.nullif("column_name", F.lit("")).alias("column_name"), F.coalesce("now_type", "asset_type").alias("asset_type"),
        *(F.when(here, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in facts[1:]), asset_life.alias("asset_lifecycle"), column_life.alias("column_lifecycle"),
    )


def events(planned: DataFrame) -> DataFrame:
    """(action, entity_type, entity_id, before, after): asset.discovered and the like, for the audit sink."""
    verbs = {"insert": "discovered", "update": "changed", "missing": "missing"}
    kind = F.when(F.col("column_name").isNull(), "asset").otherwise("column")
    verb: Column = F.lit(None).cast("string")
    for word, shown in verbs.items():
        verb = F.when(F.col("change").startswith(word), shown).otherwise(verb)
    return planned.select(F.concat_ws(".", kind, verb).alias("action"), kind.alias("entity_type"), F.concat_ws(".", *COLUMN).alias("entity_id"), "before", "after")


def summary(observed: DataFrame, planned: DataFrame) -> DataFrame:
    """One row: assets, columns, changes and whether anything changed."""
    seen = observed.agg(F.count_distinct(*ASSET).alias("assets"), F.count("column_name").alias("columns"))
    changes = planned.agg(F.count(F.lit(1)).alias("changes"))
    return seen.join(F.broadcast(changes)).withColumn("changed", F.col("changes") > 0)  # two rows of one aggregate each


def page(assets: DataFrame, after: tuple[str, str, str] | None = None, limit: int = 50, source_id: str | None = None) -> DataFrame:
    """A keyset page ordered by (schema_name, name, asset_id), of 50 to 200 rows, and the cursor after it; a short page has no cursor."""
    limit = max(50, min(200, limit))
    keys = ["schema_name", "name", "asset_id"]
    rows = assets.filter(F.col("source_id") == source_id) if source_id else assets
    if after:
        rows = rows.filter(F.struct(*keys) > F.struct(*(F.lit(x).cast("string").alias(k) for k, x in zip(keys, after, strict=True))))
    rows = rows.orderBy(*keys).limit(limit)
    full = F.count(F.lit(1)).over(Window.partitionBy()) == limit  # over the page's rows, 200 at most
    return rows.withColumn("cursor", F.when(full, encode_cursor(*map(F.col, keys))))


def encode_cursor(*parts: Column) -> Column:
    """base64url of the parts, joined by a unit separator."""
    return F.translate(F.regexp_replace(F.base64(F.encode(F.concat_ws("\x1f", *parts), "UTF-8")), "[\r\n]", ""), "+/", "-_")


def decode_cursor(cursor: Column, parts: int = 3) -> Column:
    """The parts of a cursor; one of another form is an error."""
    found = F.split(F.decode(F.unbase64(F.translate(cursor, "-_", "+/")), "UTF-8"), "\x1f")
    return F.when(F.size(found) == parts, found).otherwise(F.raise_error(F.lit("bad cursor")))


def targets(columns: DataFrame) -> DataFrame:
    """Active columns in the order in which a profile names them."""
    return columns.filter("column_lifecycle = 'active'").orderBy(*ASSET, "ordinal", "column_name")


def lookup(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key columns are among keys."""
    return df.join(keys, keys.columns, "left_semi")


def profilable(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """asset_id and refusal (null if it may be profiled): unknown_asset, inactive_asset."""
    known = assets.select("asset_id", "lifecycle", F.lit(True).alias("known"))
    refusal = F.when(F.col("known").isNull(), "unknown_asset").when(F.col("lifecycle") != "active", "inactive_asset")
    return requests.join(known, "asset_id", "left").select(*requests.columns, refusal.alias("refusal"))


def classifiable(requests: DataFrame, assets: DataFrame, latest: DataFrame) -> DataFrame:
    """asset_id, profile_version and refusal, the first that holds: unknown_asset, inactive_asset, unprofiled_asset, stale_profile, no_columns.

    requests: asset_id, profile_version; latest: asset_id, version, n_columns.
    """
    known = assets.select("asset_id", "lifecycle", F.lit(True).alias("known"))
    rows = requests.join(known, "asset_id", "left").join(latest.select("asset_id", "version", "n_columns"), "asset_id", "left")
    refusal = (
        F.when(F.col("known").isNull(), "unknown_asset")
        .when(F.col("lifecycle") != "active", "inactive_asset")
        .when(F.col("version").isNull(), "unprofiled_asset")
        .when(F.col("version") != F.col("profile_version"), "stale_profile")
        .when(F.col("n_columns") == 0, "no_columns")
    )
    return rows.select("asset_id", "profile_version", refusal.alias("refusal"))
