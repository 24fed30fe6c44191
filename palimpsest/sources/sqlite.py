"""A Python data source for tables of SQLite files: spark.read.format("sqlite_file").option("path", ...).option("table", ...)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: SQLite's declared types.
KINDS = (("INT", "BIGINT"), ("CHAR", "STRING"), ("TEXT", "STRING"), ("CLOB", "STRING"), ("REAL", "DOUBLE"), ("FLOA", "DOUBLE"), ("DOUB", "DOUBLE"))


def _open(path: str):
    import sqlite3

    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Runs of row ids are partitions, so a large table is read in parallel and a lost task reads its run again."""

    def __init__(self, schema: StructType, options: dict):
        self.fields, self.path, self.table, self.step = [f.name for f in schema.fields], options["path"], options["table"].replace('"', '""'), int(options.get("rows", 100_000))

    def partitions(self):
        with _open(self.path) as con:
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return [Rows(k, min(k + self.step, high + 1)) for k in range(low, high + 1, self.step)] if low is not None else [Rows(0, 0)]

    def read(self, partition):
        names = ", ".join(f'"{f}"' for f in self.fields)
        with _open(self.path) as con:
            yield from con.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    @classmethod
    def name(cls):
        return "sqlite_file"

    def schema(self):
        table = self.options["table"].replace('"', '""')
        with _open(self.options["path"]) as con:
            columns = con.execute(f'PRAGMA table_info("{table}")').fetchall()
        kind = lambda t: next((k for part, k in KINDS if part in (t or "").upper()), "STRING")
        return ", ".join(f"`{c[1]}` {kind(c[2])}" for c in columns)

    def reader(self, schema):
        return SqliteReader(schema, self.options)


def read_table(spark: SparkSession, path: str, table: str):
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_file").option("path", path).option("table", table).load()
