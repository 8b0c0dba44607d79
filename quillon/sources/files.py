"""Sources and sinks: file formats, partitioned output, in-memory tables and a Python data source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMATS = ("parquet", "orc", "csv", "json", "xml", "text")
_OPTIONS = {"csv": {"header": "true"}, "xml": {"rowTag": "row"}}


def write(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = (), mode: str = "errorifexists", **options: str) -> None:
    """Write df in one of FORMATS, with a folder per value of the columns `by`."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    writer = df.write.format(kind).mode(mode).options(**_OPTIONS.get(kind, {}), **options)
    (writer.partitionBy(*by) if by else writer).save(path)


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Read files of one of FORMATS; a schema spares a pass over CSV, JSON and XML."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.format(kind).options(**_OPTIONS.get(kind, {}), **options)
    return (reader.schema(schema) if schema else reader).load(path)


class Sequence(DataSource):
    """Numbers from 0 to `rows`, read in `parts` partitions: a connector written in Python."""

    @classmethod
    def name(cls) -> str:
        return "sequence"

    def schema(self) -> str:
        return "n long"

    def reader(self, schema) -> DataSourceReader:
        rows, parts = int(self.options.get("rows", 100)), int(self.options.get("parts", 4))

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return [InputPartition(i) for i in range(parts)]

            def read(self, partition: InputPartition) -> Iterator[tuple]:
                return ((n,) for n in range(partition.value, rows, parts))

        return Reader()


def sequence(spark: SparkSession, rows: int, parts: int = 4) -> DataFrame:
    spark.dataSource.register(Sequence)
    return spark.read.format("sequence").option("rows", rows).option("parts", parts).load()
