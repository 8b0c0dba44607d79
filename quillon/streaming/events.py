"""Structured Streaming over event files: event-time windows, deduplication, interval joins, custom state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, files_per_batch: int = 1, late: str = "1 hour") -> DataFrame:
    """A stream of a folder's Parquet files with a watermark. Times must be stored as instants (see `publish`)."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withWatermark("ts", late)


def publish(events: DataFrame, folder: str, files: int) -> None:
    """Write events as files, each a span of time; wall-clock times become instants of the session's zone."""
    events.withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    return events.groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def first_of_kind(events: DataFrame) -> DataFrame:
    """One event of each user and type within the watermark."""
    return events.dropDuplicatesWithinWatermark(["user_id", "event_type"])


def clicks_then_purchases(clicks: DataFrame, purchases: DataFrame, within: str = "2 hours") -> DataFrame:
    a = clicks.where("event_type = 'click'").select(F.col("user_id").alias("cu"), F.col("ts").alias("ct"), F.col("event_id").alias("click_id"))
    b = purchases.where("event_type = 'purchase'").select(F.col("user_id").alias("pu"), F.col("ts").alias("pt"), F.col("event_id").alias("purchase_id"))
    return a.join(b, F.expr(f"cu = pu AND pt > ct AND pt <= ct + INTERVAL {within}")).select("click_id", "purchase_id")


def running_totals(events: DataFrame) -> DataFrame:
    """A user's events and value so far, one row a user and batch: state that Spark has no operator for."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n, total = n + len(part), total + float(part.value.sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


class Totals(StatefulProcessor):
    """A user's events so far, in a value state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = (self.seen.get()[0] if self.seen.exists() else 0) + sum(map(len, rows))
        self.seen.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    def close(self) -> None:
        pass


def running_counts(events: DataFrame) -> DataFrame:
    """As `running_totals`, by transformWithState: needs the RocksDB state store (`ROCKSDB` as the session's provider class)."""
    return events.groupBy("user_id").transformWithStateInPandas(Totals(), "user_id long, n long", "Update", "None")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def each_batch(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what is there, each batch into a folder of its own: a batch that is run again replaces its folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into an in-memory table, for small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what is there into Parquet files, exactly once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def to_console(stream: DataFrame, rows: int = 20, mode: str = "append") -> None:
    """Run a stream over what is there and print each batch's first rows, to look at."""
    stream.writeStream.format("console").option("numRows", rows).option("truncate", "false").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
