"""A connector for tables kept as SQLite files in a folder: batch and stream, read and write, with filters at the source.

A write makes a file a task in a folder of its own, which the commit renames to `batch-<number>`: readers see a write whole
or not at all, files of lost attempts are dropped, and an aborted write leaves nothing. Committed files never change, so
readers need no locks. A stream's offset is the number of the last batch; as a sink, a stream's batch has its own number, so
one that is run again after a failure is not written twice. The folder must be one that driver and executors share.

Columns are integers, doubles, strings and binaries; anything else, and NaN, which SQLite would store as null, is an error.
"""

from __future__ import annotations

import math
import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull,
    LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from quillon.plans.registry import Registry
from quillon.session import table
from quillon.sources.shared import folder

registry = Registry()

_STORED = {LongType: "INTEGER", IntegerType: "INTEGER", DoubleType: "REAL", StringType: "TEXT", BinaryType: "BLOB"}
_READ = {"INTEGER": LongType(), "REAL": DoubleType(), "TEXT": StringType(), "BLOB": BinaryType()}
_ARROW = {LongType: pa.int64(), IntegerType: pa.int32(), DoubleType: pa.float64(), StringType: pa.string(), BinaryType: pa.binary()}
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Rows of a record batch, and of an insertion.
_ROWS = 10_000


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _name(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def _open(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro&immutable=1", uri=True)


def batches(path: str) -> list[int]:
    """Numbers of what has been committed, ascending."""
    return sorted(int(x.removeprefix("batch-")) for x in os.listdir(path) if x.startswith("batch-")) if os.path.isdir(path) else []


def _files(path: str, numbers: Iterable[int]) -> list[str]:
    return [f"{path}/batch-{n}/{f}" for n in numbers for f in sorted(os.listdir(f"{path}/batch-{n}"))]


@dataclass
class Slice(InputPartition):
    """Rows low to high of a file."""

    file: str
    low: int
    high: int


def _slices(files: Iterable[str], rows: int) -> list[InputPartition]:
    out: list[InputPartition] = []
    for file in files:
        with closing(_open(file)) as db:
            low, high = db.execute("SELECT min(rowid), max(rowid) FROM rows").fetchone()
        if low is not None:
            out += [Slice(file, at, min(at + rows - 1, high)) for at in range(low, high + 1, rows)]
    return out or [Slice("", 0, -1)]


def _read(part: Slice, schema: StructType, condition: str, values: Sequence[object]) -> Iterator[pa.RecordBatch]:
    if not part.file:
        return
    fields = pa.schema([(f.name, _ARROW[type(f.dataType)]) for f in schema])
    with closing(_open(part.file)) as db:
        found = db.execute(f"SELECT {', '.join(_name(f.name) for f in schema)} FROM rows WHERE rowid BETWEEN ? AND ?{condition}", (part.low, part.high, *values))
        while rows := found.fetchmany(_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, rows: int) -> None:
        self.path, self.rows, self.schema = path, rows, schema
        self.condition, self.values = "", []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Comparisons with constants and tests for null are left to SQLite, which orders texts by their bytes as Spark does."""
        for f in filters:
            column = _name(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            wanted = f.value if isinstance(f, In) else (f.value,) if type(f) in _COMPARED else ()
            if column and isinstance(f, (IsNull, IsNotNull)):
                self.condition += f" AND {column} IS {'NOT ' * isinstance(f, IsNotNull)}NULL"
            elif column and wanted and all(isinstance(v, (int, float, str)) and not isinstance(v, bool) and v == v for v in wanted):
                self.condition += f" AND {column} {_COMPARED[type(f)]} ?" if type(f) in _COMPARED else f" AND {column} IN ({', '.join('?' * len(wanted))})"
                self.values += wanted
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return _slices(_files(self.path, batches(self.path)), self.rows)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.schema, self.condition, self.values)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType, rows: int) -> None:
        self.path, self.rows, self.schema = path, rows, schema

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batch": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"batch": max(batches(self.path), default=-1)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _slices(_files(self.path, [n for n in batches(self.path) if start["batch"] < n <= end["batch"]]), self.rows)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.schema, "", ())


@dataclass
class Written(WriterCommitMessage):
    """What an attempt wrote. A stream's commit is another object than its writers, so the message names the folder."""

    job: str
    file: str


class _Job:
    """What a batch write and a stream's batch have in common."""

    def __init__(self, path: str, schema: StructType) -> None:
        for f in schema:
            if type(f.dataType) not in _STORED:
                raise ValueError(f"column {f.name}: SQLite files hold no {f.dataType.simpleString()}")
        self.path, self.schema, self.job = path, schema, f"{path}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        os.makedirs(self.job, exist_ok=True)
        file = f"{uuid.uuid4().hex}.db"
        with closing(sqlite3.connect(f"{self.job}/{file}")) as db:
            db.execute("PRAGMA journal_mode = OFF")
            db.execute(f"CREATE TABLE rows ({', '.join(f'{_name(f.name)} {_STORED[type(f.dataType)]}' for f in self.schema)})")
            put, held = f"INSERT INTO rows VALUES ({', '.join('?' * len(self.schema))})", []
            for row in iterator:
                if any(isinstance(v, float) and math.isnan(v) for v in row):
                    raise ValueError("SQLite files hold no NaN")
                held.append(tuple(bytes(v) if isinstance(v, bytearray) else v for v in row))
                if len(held) == _ROWS:
                    db.executemany(put, held)
                    held = []
            db.executemany(put, held)
            db.commit()
        return Written(self.job, file)

    def _publish(self, messages: list[WriterCommitMessage | None], number: int) -> bool:
        """Make what was written visible as the batch of this number; false if there is one already."""
        kept = [m for m in messages if m is not None]
        job = kept[0].job if kept else self.job
        os.makedirs(job, exist_ok=True)
        for stray in set(os.listdir(job)) - {m.file for m in kept}:
            os.remove(f"{job}/{stray}")
        if os.path.isdir(f"{self.path}/batch-{number}"):
            return False
        os.rename(job, f"{self.path}/batch-{number}")
        return True

    def _forget(self, messages: list[WriterCommitMessage | None]) -> None:
        for job in {self.job, *(m.job for m in messages if m is not None)}:
            shutil.rmtree(job, ignore_errors=True)


class Writer(_Job, DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        super().__init__(path, schema)
        self.overwrite = overwrite

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        old = batches(self.path)
        number = max(old, default=-1) + 1
        while not self._publish(messages, number):
            number += 1
        for n in old if self.overwrite else ():
            shutil.rmtree(f"{self.path}/batch-{n}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._forget(messages)


class StreamWriter(_Job, DataSourceStreamWriter):
    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        if not self._publish(messages, batchId):
            self._forget(messages)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        self._forget(messages)


class SqliteFolder(DataSource):
    """Format "sqlite". Options: path, and rows (of a task, by default 100,000)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    @property
    def path(self) -> str:
        return _local(self.options["path"])

    def schema(self) -> StructType:
        files = _files(self.path, batches(self.path)[-1:])
        if not files:  # what a stream is about to write
            return StructType()
        with closing(_open(files[0])) as db:
            return StructType([StructField(name, _READ[kind]) for _, name, kind, *_ in db.execute("PRAGMA table_info(rows)")])

    def reader(self, schema: StructType) -> DataSourceReader:
        if not len(schema):
            raise ValueError(f"no table at {self.path}")
        return Reader(self.path, schema, int(self.options.get("rows", 100_000)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.path, schema, overwrite)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        if not len(schema):
            raise ValueError(f"no table at {self.path}")
        return StreamReader(self.path, schema, int(self.options.get("rows", 100_000)))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return StreamWriter(self.path, schema)


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known, and filters be offered to it."""
    spark.dataSource.register(SqliteFolder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    return register(spark).read.format("sqlite").option("rows", rows).load(path)


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append df to the folder's table, or put it in the table's place (`overwrite`)."""
    register(df.sparkSession)
    df.write.format("sqlite").mode(mode).save(path)


@registry.query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey <= 900")
def connector_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as SQLite files in two batches and read again, the conditions being SQLite's."""
    path = f"{folder(spark)}/sqlite-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    for half in ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1"):
        write(orders.where(half), path)
    return read(spark, path).where("o_totalprice > 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey <= 900")
