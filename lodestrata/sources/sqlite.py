"""A read-only SQLite reader as a Python data source: ``spark.read.format("sqlite_ro").option("path", ...).option("table", ...)``."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Rows of one partition, by row id.
STRIDE = 100_000


class RowRange(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


def opened(path: str) -> sqlite3.Connection:
    """Opened so that neither the file nor a journal beside it can change."""
    return sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True)


def named(table: str) -> str:
    return '"' + table.replace('"', '""') + '"'


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str]) -> None:
        self.path, self.table, self.columns = path, table, columns

    def partitions(self) -> list[RowRange]:
        with opened(self.path) as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {named(self.table)}").fetchone()
        return [RowRange(0, 0)] if low is None else [RowRange(at, min(at + STRIDE, high + 1)) for at in range(low, high + 1, STRIDE)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        listed = ", ".join(map(named, self.columns))
        with opened(self.path) as db:
            for row in db.execute(f"select {listed} from {named(self.table)} where rowid >= ? and rowid < ?", (partition.low, partition.high)):
                yield tuple(None if v is None else v.decode(errors="replace") if isinstance(v, bytes) else str(v) for v in row)


class SqliteSource(DataSource):
    """All columns as strings. The file must be at the same path on every executor."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def schema(self) -> StructType:
        with opened(self.options["path"]) as db:
            names = [r[1] for r in db.execute(f"pragma table_info({named(self.options['table'])})")]
        if not names:
            raise ValueError(f"no table {self.options['table']!r}")
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema.names)


def read_table(spark: SparkSession, path: str, table: str):  # noqa: ANN201
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_ro").option("path", path).option("table", table).load()
