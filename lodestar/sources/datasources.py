"""Python data sources over standard-library formats: SQLite tables and ZIP members.

The files must lie where the executors see them. Register with register(spark), then
spark.read.format("sqlite").option("path", ...).option("table", ...).load() or
spark.read.format("zip_members").option("path", ...).load().
"""

from __future__ import annotations

import hashlib
import json
import sqlite3
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lodestar import ship

#: SQLite's type affinities
KINDS = {"INTEGER": "long", "INT": "long", "REAL": "double", "TEXT": "string", "BLOB": "binary"}


class RowRange(InputPartition):
    def __init__(self, first: int, past: int):
        self.first, self.past = first, past


class SqliteSource(DataSource):
    """A table in ranges of its row id. Options: path, table, partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _table(self) -> str:
        name = self.options["table"]
        if not name.replace("_", "").isalnum():
            raise ValueError(f"not a table name: {name!r}")
        return name

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f"PRAGMA table_info({self._table()})").fetchall()
        if not columns:
            raise ValueError(f"no table {self._table()} in {self.options['path']}")
        return ", ".join(f"`{c[1]}` {KINDS.get(c[2].upper(), 'string')}" for c in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options["path"], self._table(), int(self.options.get("partitions", 4)), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, parts: int, schema: StructType):
        self.path, self.table, self.parts, self.columns = path, table, parts, [f.name for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        if low is None:
            return [RowRange(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [RowRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f"SELECT {names} FROM {self.table} WHERE rowid >= ? AND rowid < ?", (partition.first, partition.past))


class ZipSource(DataSource):
    """Members of an archive with a signature. Options: path, suffixes (comma-separated), content (true: their bytes), partitions."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        more = ", content binary" if self.options.get("content", "false") == "true" else ""
        return f"member string, length long, signature string{more}"

    def reader(self, schema: StructType) -> DataSourceReader:
        suffixes = [s for s in self.options.get("suffixes", "").lower().split(",") if s]
        return ZipReader(self.options["path"], suffixes, "content" in schema.names, int(self.options.get("partitions", 4)))


class Members(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class ZipReader(DataSourceReader):
    def __init__(self, path: str, suffixes: list[str], content: bool, parts: int):
        self.path, self.suffixes, self.content, self.parts = path, suffixes, content, parts

    def partitions(self) -> list[InputPartition]:
        with zipfile.ZipFile(self.path) as z:
            names = sorted(m.filename for m in z.infolist() if not m.is_dir() and (not self.suffixes or PurePosixPath(m.filename).suffix.lower() in self.suffixes))
        return [Members(names[i :: self.parts]) for i in range(min(self.parts, len(names)))] or [Members([])]

    def read(self, partition: Members) -> Iterator[tuple]:
        with zipfile.ZipFile(self.path) as z:
            for name in partition.names:
                m = z.getinfo(name)
                told = {"compress_size": m.compress_size, "crc": m.CRC, "date_time": list(m.date_time), "file_size": m.file_size, "member": name}
                signature = hashlib.sha256(json.dumps(told, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
                yield (name, m.file_size, signature, *((z.read(name),) if self.content else ()))


def register(spark: SparkSession) -> None:
    ship(spark)
    for source in (SqliteSource, ZipSource):
        spark.dataSource.register(source)
