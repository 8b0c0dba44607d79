"""Streams with their own state and clock: sessions closed by event-time timers, and streams as queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.plans.registry import Registry
from quillon.session import table
from quillon.sources.shared import folder
from quillon.streaming import events as ev

registry = Registry()


class Sessions(StatefulProcessor):
    """A user's open sessions in a list state, and one timer at the first end among them.

    Events may come in any order within the watermark: one that lies within the gap of two sessions, or just at its
    end, joins them, as `session_window` does. A timer closes every session whose end is past, so a user costs one
    timer a batch, however many sessions. Events without a time are a session, one a batch.
    """

    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms * 1000  # times are held in microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, last long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = [tuple(s) for s in self.open.get()]
        timer, timeless = self._first_end(known), 0
        for part in rows:
            times = part.ts.dropna()
            timeless += len(part) - len(times)
            known += [(t, t, 1) for t in times.astype("datetime64[us]").astype("int64").tolist()]
        joined: list[tuple[int, int, int]] = []
        for start, last, n in sorted(known):
            if joined and start <= joined[-1][1] + self.gap:
                joined[-1] = (joined[-1][0], max(joined[-1][1], last), joined[-1][2] + n)
            else:
                joined.append((start, last, n))
        self._keep(joined, timer)
        if timeless:  # the others leave by their timer
            yield self._rows(key, [None], [timeless])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        known = [tuple(s) for s in self.open.get()]
        done = [s for s in known if self._closes(s) <= now]
        self._keep([s for s in known if self._closes(s) > now], expiredTimerInfo.getExpiryTimeInMs())
        if done:
            yield self._rows(key, [s[0] for s in done], [s[2] for s in done])

    @staticmethod
    def _rows(key: tuple, starts: list, counts: list[int]) -> pd.DataFrame:
        users = pd.Series([None if key[1] else key[0]] * len(starts), dtype="Int64")
        return pd.DataFrame({"user_id": users, "start": pd.to_datetime(pd.Series(starts, dtype="Int64"), unit="us"), "n": counts})

    def _closes(self, session: tuple[int, int, int]) -> int:
        """The first millisecond at which no event can join it."""
        return (session[1] + self.gap) // 1000 + 1

    def _first_end(self, sessions: list[tuple[int, int, int]]) -> int | None:
        return min(map(self._closes, sessions), default=None)

    def _keep(self, sessions: list[tuple[int, int, int]], timer: int | None) -> None:
        """The open sessions, and a timer for their first end instead of the one that was set."""
        if sessions:
            self.open.put(sessions)
        else:
            self.open.clear()
        end = self._first_end(sessions)
        if timer is not None and timer != end:
            self.handle.deleteTimer(timer)
        if end is not None and timer != end:
            self.handle.registerTimer(end)

    def close(self) -> None:
        pass


def sessions(events: DataFrame, gap_ms: int = 30 * 60 * 1000) -> DataFrame:
    """user_id, start and n of each session once the watermark is past its end. Needs the RocksDB state store."""
    # a null user is a user too, but a null among the keys of a batch would make pandas' floats of them all
    named = events.select("ts", F.coalesce("user_id", F.lit(0)).cast("long").alias("user"), F.col("user_id").isNull().alias("nameless"))
    return named.groupBy("user", "nameless").transformWithStateInPandas(Sessions(gap_ms), "user_id long, start timestamp, n long", "Append", "EventTime")


# ---- streams as queries: over files of the events table, until all of it has been read


def _streamed(spark: SparkSession, sf_dir: str, result: Callable[[DataFrame], DataFrame], schema: str, spans: int = 3) -> DataFrame:
    """The rows of a stream over the events, which arrive by span of time: one is written and streamed, then the next.

    Files that are there together may be read in any order, as tasks end in any order, and the watermark would drop
    the earlier span's events; so the stream goes on from its checkpoint for each span, which is one batch. A last event
    two days on moves the watermark past them all.
    """
    path = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    micros = F.unix_micros("ts")
    low, high = events.agg(F.min(micros), F.max(micros)).first()
    # rows without a time come with the first span
    span = F.coalesce(F.floor((micros - low) * F.lit(spans) / F.lit(high - low + 1)), F.lit(0)) if low is not None else F.lit(0)
    for i in range(spans):
        events.where(span == i).write.mode("append").parquet(f"{path}/events")
        if i == spans - 1 and low is not None:
            last = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.timestamp_micros(F.lit(high + 2 * 86_400_000_000)).alias("ts"))
            last = last.selectExpr("event_id", "ts", "-1L AS user_id", "'end' AS event_type", "0D AS value", "'{}' AS props")
            last.write.mode("append").parquet(f"{path}/events")
        ev.to_files(result(ev.source(spark, f"{path}/events", 1_000_000)), f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(schema).parquet(f"{path}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


@registry.query(
    """SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s
       FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""
)
def stream_sessions_by_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, ev.ROCKSDB)
    try:
        return _streamed(spark, sf_dir, sessions, "user_id long, start timestamp, n long")
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


@registry.query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, ev.tumbling, "start timestamp, event_type string, n long")
