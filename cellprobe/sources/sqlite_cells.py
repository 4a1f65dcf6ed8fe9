"""A batch data source that reads a table of a SQLite file as cells, in ranges of rowid.

``spark.read.format("sqlite_cells").option("path", file).option("table", name).load()``; option ``columns``
(a JSON list) projects, ``partitions`` sets the number of ranges. The file is opened read-only. Every executor
must see it under that path.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructField, StructType

from cellprobe.functions.cells import CELL
from cellprobe.sources.catalog import connect, quoted


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


#: Rows of a batch.
_BATCH = 4096
_KINDS = {int: "integer", float: "real", str: "text", bytes: "blob"}


def _column(values: tuple) -> pa.StructArray:
    """The values of a column as cells; NULL is a null cell."""
    kinds = [_KINDS.get(type(v)) for v in values]
    of = lambda kind: [v if k == kind else None for v, k in zip(values, kinds, strict=True)]
    parts = [pa.array(kinds, pa.string()), pa.array(of("integer"), pa.int64()), pa.array(of("real"), pa.float64()), pa.array(of("text"), pa.string()), pa.array(of("blob"), pa.binary())]
    return pa.StructArray.from_arrays(parts, names=CELL.fieldNames(), mask=pa.array([k is None for k in kinds], pa.bool_()))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.table, self.columns = options["path"], options["table"], columns
        self.ranges = int(options.get("partitions", 8))

    def partitions(self):
        with connect(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # no rowid: one range
                return [_Range(None, None)]
        if not isinstance(low, int) or not isinstance(high, int):
            return [_Range(None, None)]
        step = max(1, -(-(high - low + 1) // self.ranges))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        select = f"SELECT {', '.join(map(quoted, self.columns))} FROM {quoted(self.table)}"
        bounds = () if partition.low is None else (partition.low, partition.high)
        with connect(self.path) as db:
            found = db.execute(select + " WHERE rowid BETWEEN ? AND ?" * bool(bounds), bounds)
            while rows := found.fetchmany(_BATCH):
                yield pa.RecordBatch.from_arrays([_column(c) for c in zip(*rows, strict=True)], names=self.columns)


class SqliteCells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_cells"

    def _columns(self) -> list[str]:
        if "columns" in self.options:
            return json.loads(self.options["columns"])
        with connect(self.options["path"]) as db:
            return [r[1] for r in db.execute(f"PRAGMA table_info({quoted(self.options['table'])})")]

    def schema(self) -> StructType:
        return StructType([StructField(c, CELL) for c in self._columns()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema.fieldNames())


def read_table(spark, path: str, table: str, columns: list[str] | None = None, partitions: int = 8):
    """A table of a file as cells."""
    spark.dataSource.register(SqliteCells)
    reader = spark.read.format("sqlite_cells").option("path", path).option("table", table).option("partitions", str(partitions))
    return (reader.option("columns", json.dumps(columns)) if columns else reader).load()


def read_ordered(spark, path: str, table: str, order: list[str], columns: list[str] | None = None):
    """The same in the order of key columns, by storage class and value as the source orders them."""
    df = read_table(spark, path, table, columns)
    by = [x for c in order for x in (f"CASE WHEN `{c}`.k IN ('integer', 'real') THEN 0 WHEN `{c}`.k = 'text' THEN 1 ELSE 2 END", f"coalesce(`{c}`.d, cast(`{c}`.i AS double))", f"`{c}`.i", f"`{c}`.s", f"`{c}`.b")]
    from pyspark.sql import functions as F

    return df.orderBy(*map(F.expr, by))
