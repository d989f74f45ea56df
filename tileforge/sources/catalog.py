"""Registered tables: where they lie, their keys and partition columns, and what identifies their files."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tileforge.errors import EngineError
from tileforge.operators.keys import Key


@dataclass
class Table:
    schema_name: str
    name: str
    path: str
    primary_key: Key | None = None
    ordered_keys: dict[str, Key] = field(default_factory=dict)
    partition_columns: tuple[str, ...] = ()
    schema: StructType | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as it is now; its schema, once known, isn't looked up in the files again."""
        reader = spark.read if self.schema is None else spark.read.schema(self.schema)
        return reader.parquet(self.path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path objects for a path, so that any store works."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of names, lengths and modification times of the data files."""
    fs, root = file_system(spark, path)
    found, queue = [], [root]
    while queue:
        for status in fs.listStatus(queue.pop()):
            name = status.getPath().getName()
            if status.isDirectory() and not name.startswith(("_", ".")):
                queue.append(status.getPath())
            elif not name.startswith(("_", ".")):
                found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


#: Folders by which table formats with a log of their own are known.
_LOGS = ("_delta_log", ".hoodie", "metadata")


def assert_plain(spark: SparkSession, table: Table) -> None:
    """The table is bare Parquet: files that a log has replaced would count as rows by their place."""
    fs, root = file_system(spark, table.path)
    for log in _LOGS:
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(root, log)):
            raise EngineError("42809", f"blocks need plain Parquet, but {table.name} has {log}")


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[tuple[str, str], Table] = {}

    def register(self, table: Table) -> Table:
        schema = table.schema = table.read(self.spark).schema
        if table.primary_key:
            table.primary_key = table.primary_key.resolve(schema)
        table.ordered_keys = {n: Key(k.columns, (), n, k.declared).resolve(schema) for n, k in table.ordered_keys.items()}
        if missing := [c for c in table.partition_columns if c not in schema.names]:
            raise EngineError("22023", f"no partition column {missing[0]}")
        self._tables[table.schema_name, table.name] = table
        return table

    def get(self, schema_name: str, name: str) -> Table:
        if not any(s == schema_name for s, _ in self._tables):
            raise EngineError("3F000", f"no schema {schema_name}")
        if (schema_name, name) not in self._tables:
            raise EngineError("42P01", f"no table {schema_name}.{name}")
        return self._tables[schema_name, name]

    def key(self, table: Table, chunk_by: str, ordered_key: str | None) -> Key | None:
        """The key that a strategy chunks by; None for blocks."""
        if (chunk_by == "ordered_key") != (ordered_key is not None):
            raise EngineError("22023", "a boundary key is named for ordered_key only, and must be")
        if chunk_by == "blocks":
            return None
        if chunk_by == "primary_key":
            if table.primary_key is None:
                raise EngineError("22023", f"{table.name} has no primary key")
            return table.primary_key
        if ordered_key in table.ordered_keys:
            return table.ordered_keys[ordered_key]
        other = next((t.name for t in self._tables.values() if ordered_key in t.ordered_keys), None)
        raise EngineError("42704", f"no key {ordered_key} on {table.name}", f"it is a key of {other}" if other else None)
