"""Where tables come from and where rows go: schema scans, source registration, stored catalogs, fixtures, append-only sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVED = "schema_name string, name string, asset_type string, column_name string, data_type string, ordinal int, nullable boolean"


def scan(tables: dict[tuple[str, str], DataFrame], views: frozenset[tuple[str, str]] = frozenset()) -> DataFrame:
    """One row for each column of each table (schema, name): its type, place and nullability; a table without columns has one row, without a column. Reads schemas only."""
    spark = SparkSession.active()
    rows = []
    for (schema, name), df in sorted(tables.items()):
        kind = "view" if (schema, name) in views else "table"
        own = [(schema, name, kind, f.name, f.dataType.simpleString(), i, f.nullable) for i, f in enumerate(df.schema, 1)]
        rows += own or [(schema, name, kind, None, None, None, None)]
    return spark.createDataFrame(rows, OBSERVED)


def scan_catalog(spark: SparkSession, database: str) -> DataFrame:
    """The same for the tables and views of a database that the session's catalog knows."""
    found = spark.catalog.listTables(database)
    tables = {(database, t.name): spark.table(f"`{database}`.`{t.name}`" if not t.isTemporary else f"`{t.name}`") for t in found}
    return scan(tables, frozenset((database, t.name) for t in found if t.tableType in ("VIEW", "TEMPORARY")))


SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast", "mysql", "performance_schema", "sys")


def jdbc_query(include: list[str], exclude: list[str]) -> str:
    """The query of scan_jdbc; tables without columns have a row too. Names are quoted as literals."""
    literals = lambda names: ", ".join("'" + n.replace("'", "''") + "'" for n in names)
    kept = f"t.table_schema not in ({literals([*SYSTEM_SCHEMAS, *exclude])})" + (f" and t.table_schema in ({literals(include)})" if include else "")
    return (
        "select t.table_schema as schema_name, t.table_name as name, case when t.table_type like '%VIEW' then 'view' else 'table' end as asset_type, "
        "c.column_name, c.data_type, c.ordinal_position as ordinal, c.is_nullable = 'YES' as nullable "
        "from information_schema.tables t left join information_schema.columns c on t.table_schema = c.table_schema and t.table_name = c.table_name "
        f"where {kept}"
    )


def scan_jdbc(spark: SparkSession, url: str, include: list[str] | None = None, exclude: list[str] | None = None, **options: str) -> DataFrame:
    """The same from the information schema of a database, without its system schemas; include (empty: all) and exclude name schemas."""
    return spark.read.format("jdbc").options(url=url, query=jdbc_query(include or [], exclude or []), **options).load()


def filtered(observed: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Schemas in include (empty: all) and not in exclude."""
    kept = ~F.col("schema_name").isin(exclude) if exclude else F.lit(True)
    return observed.filter(kept & (F.col("schema_name").isin(include) if include else F.lit(True)))


def canonical(names: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(names, F.array().cast("array<string>"))))


NATURAL_KEY = ["engine", "host", "database", "include_schemas", "exclude_schemas"]


def register(requests: DataFrame, stored: DataFrame, order: str = "requested_at") -> DataFrame:
    """Sources to add: the first request of each natural key that is not stored. Ids are digests of the key."""
    clean = lambda df: df.withColumn("include_schemas", canonical(F.col("include_schemas"))).withColumn("exclude_schemas", canonical(F.col("exclude_schemas")))
    first = Window.partitionBy(*NATURAL_KEY).orderBy(order, "name")
    fresh = clean(requests).withColumn("turn", F.row_number().over(first)).filter("turn = 1").drop("turn")
    known = clean(stored).select(*(F.col(c).alias(f"known_{c}") for c in NATURAL_KEY))
    same = [F.col(c).eqNullSafe(F.col(f"known_{c}")) for c in NATURAL_KEY]  # a source without a host is known too
    fresh = fresh.join(known, reduce(Column.__and__, same), "left_anti")
    return fresh.withColumn("source_id", F.sha2(F.to_json(F.struct(*NATURAL_KEY)), 256))


def load_state(assets: DataFrame, columns: DataFrame, source_id: str) -> DataFrame:
    """The stored catalog of one source, a row for each column."""
    return assets.filter(F.col("source_id") == source_id).join(columns, "asset_id")


def append_version(df: DataFrame, path: str, by: str = "asset_id") -> None:
    """Adds rows to an append-only history."""
    df.write.mode("append").partitionBy(by).parquet(path)


LABELLED = T.StructType([
    T.StructField("tables", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("row_count", T.LongType()),
        T.StructField("columns", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()), T.StructField("data_type", T.StringType()), T.StructField("semantic_type", T.StringType()),
            T.StructField("null_ratio", T.StringType()), T.StructField("distinct_ratio", T.StringType()),
            T.StructField("masked_samples", T.ArrayType(T.StructType([T.StructField("masked", T.StringType()), T.StructField("semantic_type", T.StringType()), T.StructField("length", T.IntegerType())]))),
            T.StructField("expected", T.ArrayType(T.StringType())),
        ]))),
    ]))),
])


def load_fixture(spark: SparkSession, path: str) -> DataFrame:
    """A labelled set, a row for each column; absent or malformed input is an error."""
    read = spark.read.schema(LABELLED).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    tables = read.select(F.explode("tables").alias("t"))
    return tables.select(F.col("t.name").alias("table_name"), F.col("t.row_count").alias("row_count"), F.explode("t.columns").alias("c")).select(
        "table_name", "row_count", F.col("c.name").alias("column_name"), "c.data_type", "c.semantic_type", "c.null_ratio", "c.distinct_ratio", "c.masked_samples", "c.expected"
    )


def write_artifact(df: DataFrame, path: str) -> None:
    """An evaluation's rows as JSON lines, one folder for each run; a run that is written again is replaced, the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(path)


def audit(entity: str, actor: str, branches: list[tuple[DataFrame, str, Column, Column, Column]]) -> DataFrame:
    """(actor, action, entity_type, entity_id, before, after) from branches of (rows, action, id, before, after)."""
    rows = [df.select(F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.lit(entity).alias("entity_type"), key.alias("entity_id"), before.alias("before"), after.alias("after")) for df, action, key, before, after in branches]
    return reduce(DataFrame.unionByName, rows)


def qualified_name(*parts: str) -> Column:
    return F.concat_ws(".", *parts)
