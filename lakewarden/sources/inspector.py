"""Schema scans as a data source: spark.read.format("schema_inspector") reads column facts on executors, one partition for each schema.

What an inspector sees is pluggable: it lists schemas and, for each, its tables with their columns. The one here sees folders of Parquet files: a folder
under the root is a schema, what lies in it are its tables, named by file or folder without its ending. Only footers are read. Roots are paths or addresses
that pyarrow's file systems know; a path that only Spark can read is scanned by `sources.catalog.scan`.

Filters on schema_name choose the partitions, where spark.sql.python.filterPushdown.enabled is set. Cases: a root without folders has no schemas; an empty folder has none of its own rows; a file that is no Parquet file is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from lakewarden.sources.catalog import OBSERVED

Column = tuple[str, str, int, bool]


class Inspector(Protocol):
    """Where schemas come from. Both methods may run in any process."""

    def schemas(self) -> list[str]: ...

    def tables(self, schema: str) -> Iterator[tuple[str, str, list[Column]]]:
        """(table, kind, columns as (name, type, place from 1, nullable)) of each table of a schema."""
        ...


NAMES = {pa.int8(): "tinyint", pa.int16(): "smallint", pa.int32(): "int", pa.int64(): "bigint", pa.float32(): "float", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary", pa.date32(): "date"}


def type_name(kind: pa.DataType) -> str:
    """An Arrow type as Spark's short text for it."""
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return f"array<{type_name(kind.value_type)}>"
    if pa.types.is_struct(kind):
        return "struct<" + ",".join(f"{f.name}:{type_name(f.type)}" for f in kind) + ">"
    if pa.types.is_map(kind):
        return f"map<{type_name(kind.key_type)},{type_name(kind.item_type)}>"
    if pa.types.is_timestamp(kind):
        return "timestamp" if kind.tz else "timestamp_ntz"
    if pa.types.is_decimal(kind):
        return f"decimal({kind.precision},{kind.scale})"
    return NAMES.get(kind, str(kind))


class ParquetFolders:
    def __init__(self, root: str) -> None:
        self.root = root

    def _list(self, *below: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        system, path = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        found = system.get_file_info(fs.FileSelector("/".join([path.rstrip("/"), *below])))
        return system, sorted((f for f in found if not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)

    def schemas(self) -> list[str]:
        return [f.base_name for f in self._list()[1] if f.type == fs.FileType.Directory]

    def tables(self, schema: str) -> Iterator[tuple[str, str, list[Column]]]:
        system, found = self._list(schema)
        for info in found:
            files = [info] if info.type == fs.FileType.File else self._list(schema, info.base_name)[1]
            fields = pq.read_schema(files[0].path, filesystem=system) if files else []
            yield info.base_name.removesuffix(".parquet"), "table", [(f.name, type_name(f.type), i, f.nullable) for i, f in enumerate(fields, 1)]


@dataclass
class SchemaPartition(InputPartition):
    schema: str


class Reader(DataSourceReader):
    def __init__(self, inspector: Inspector) -> None:
        self.inspector = inspector
        self.wanted: set[str] | None = None

    def partitions(self) -> list[InputPartition]:
        return [SchemaPartition(s) for s in self.inspector.schemas() if self.wanted is None or s in self.wanted]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, SchemaPartition):
            for table, kind, columns in self.inspector.tables(partition.schema):
                yield from ((partition.schema, table, kind, *c) for c in columns or [(None, None, None, None)])


class FilteringReader(Reader):
    """The same where the session lets Python sources take filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for given in filters:
            names = (given.value,) if isinstance(given, EqualTo) else given.value if isinstance(given, In) else None
            if names is not None and tuple(given.attribute) == ("schema_name",):
                self.wanted = set(names) if self.wanted is None else self.wanted & set(names)
            else:
                yield given


class SchemaInspector(DataSource):
    """The data source of Parquet folders; one for another kind of inspector overrides inspector() and name()."""

    @classmethod
    def name(cls) -> str:
        return "schema_inspector"

    def inspector(self) -> Inspector:
        return ParquetFolders(self.options["path"])

    def schema(self) -> StructType | str:
        return OBSERVED

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteringReader if self.options.get("filters") == "true" else Reader)(self.inspector())


def inspect(spark: SparkSession, source: type[DataSource] = SchemaInspector, **options: str):
    """The rows that a schema scan gives (as sources.catalog.scan), read on executors."""
    spark.dataSource.register(source)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(source.name()).options(filters=filters, **options).load()
