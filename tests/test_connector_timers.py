"""The SQLite connector (batch, stream, filters, lost attempts), streams with timers, and the table-valued function."""

import os
import random
import sqlite3
from datetime import datetime, timedelta
from types import SimpleNamespace

import duckdb
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, StringContains
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillon.functions import user_defined  # noqa: F401
from quillon.plans import catalog
from quillon.sources import sqlite
from quillon.streaming import events as ev
from quillon.streaming import timers

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, ev.ROCKSDB)
    yield
    spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def rows(d):
    return sorted(map(tuple, d.collect()), key=repr)


def test_sqlite_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    d = spark.createDataFrame([(i, None if i % 5 == 0 else i / 3, f"é'\"{i}" if i % 7 else None, bytearray([i % 256])) for i in range(-50, 300)], 'k long, x double, `odd "name` string, b binary').repartition(3)
    sqlite.write(d, path)
    assert rows(sqlite.read(spark, path, rows=40)) == rows(d)
    assert sqlite.read(spark, path).schema == d.schema
    sqlite.write(d, "file://" + path)
    assert sqlite.batches(path) == [0, 1] and sqlite.read(spark, path).count() == 700
    sqlite.write(d.limit(4), path, "overwrite")
    assert sqlite.read(spark, path).count() == 4
    sqlite.write(d.limit(0), path, "overwrite")
    assert sqlite.read(spark, path).collect() == []


def test_sqlite_filters_skip_rows_at_the_source(spark, tmp_path):
    path = str(tmp_path / "t")
    d = spark.createDataFrame([(i, None if i % 4 == 0 else "bcé"[i % 3] * (i % 5)) for i in range(200)], "k long, s string")
    sqlite.write(d.coalesce(1), path)
    for condition in ("k = 7", "k > 190 AND s IS NOT NULL", "s IS NULL AND k <= 20", "s >= 'c' AND k IN (1, 2, 3, 50)", "s <=> NULL", "k < 5 OR k > 195", "s LIKE '%é%'", "k % 2 = 1 AND s = 'b'", "NOT (k >= 3)", "s = ''"):
        assert rows(sqlite.read(spark, path, rows=30).where(condition)) == rows(d.where(condition)), condition
    schema = StructType([StructField("k", LongType()), StructField("s", StringType())])
    reader = sqlite.Reader(path, schema, 1000)
    kept = list(reader.pushFilters([EqualTo(("k",), 7), StringContains(("s",), "b"), In(("k",), (7, 8)), IsNotNull(("s",)), GreaterThan(("k",), True)]))
    assert [type(f) for f in kept] == [StringContains, GreaterThan]
    read = lambda r: sum(b.num_rows for p in r.partitions() for b in r.read(p))
    assert read(reader) == 1 and read(sqlite.Reader(path, schema, 1000)) == 200
    nulls = sqlite.Reader(path, schema, 1000)
    assert list(nulls.pushFilters([IsNull(("s",))])) == [] and read(nulls) == 50


def test_sqlite_refuses_what_it_cannot_hold(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises((PySparkException, ValueError)):
        sqlite.write(spark.sql("SELECT DATE'2024-01-01' AS d"), path)
    with pytest.raises((PySparkException, ValueError)):
        sqlite.write(spark.sql("SELECT CAST('NaN' AS DOUBLE) AS x"), path)
    assert sqlite.batches(path) == [] and not [x for x in os.listdir(path) if x.startswith("_writing")]


def test_sqlite_commit_drops_lost_attempts(tmp_path):
    schema = StructType([StructField("k", LongType())])
    job = sqlite.Writer(str(tmp_path), schema, False)
    kept, _ = job.write(iter([(1,), (2,)])), job.write(iter([(3,)]))  # the second attempt is never told
    job.commit([kept, None])
    (file,) = os.listdir(tmp_path / "batch-0")
    assert sqlite3.connect(tmp_path / "batch-0" / file).execute("SELECT count(*) FROM rows").fetchone() == (2,)
    again = sqlite.StreamWriter(str(tmp_path), schema)
    again.commit([again.write(iter([(9,)]))], 0)  # this batch is there already
    assert os.listdir(tmp_path) == ["batch-0"] and os.listdir(tmp_path / "batch-0") == [file]


def test_sqlite_streams_go_on_where_they_stopped(spark, tmp_path):
    source, sink, at = (str(tmp_path / x) for x in ("source", "sink", "checkpoint"))
    numbers = lambda a, b: spark.range(a, b).selectExpr("id AS k", "CAST(id AS STRING) AS s").repartition(2)

    def run():
        stream = sqlite.register(spark).readStream.format("sqlite").option("rows", 7).load(source)
        stream.where("k % 2 = 0").writeStream.format("sqlite").option("path", sink).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.k for r in sqlite.read(spark, sink).collect())

    sqlite.write(numbers(0, 30), source)
    assert run() == list(range(0, 30, 2))
    assert run() == list(range(0, 30, 2))  # nothing new
    sqlite.write(numbers(30, 50), source)
    sqlite.write(numbers(50, 60), source)
    assert run() == list(range(0, 60, 2))


def test_sessions_of_late_and_joining_events(spark, tmp_path, rocksdb):
    """Out of order within the watermark, equal times, a gap that is met exactly, a session that two others grow into."""
    rng = random.Random(5)
    noon = datetime(2024, 1, 1, 12)
    made = [(i, noon + timedelta(minutes=rng.choice([0, 10, 20, 30, 31, 45, 60, 95, 125, 155, 400, 429, 460])), rng.randrange(6), "click", 1.0, "{}") for i in range(60)]
    made += [(100, noon, 9, "click", 1.0, "{}"), (101, noon + timedelta(minutes=50), 9, "click", 1.0, "{}"), (102, noon + timedelta(minutes=25), 9, "click", 1.0, "{}")]
    path = str(tmp_path / "e")
    for part in (made[:20], made[20:40], made[40:], [(999, noon + timedelta(days=2), -1, "end", 0.0, "{}")]):
        spark.createDataFrame(part, ev.SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ev.SCHEMA).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "12 hours")
    got = ev.drain(timers.sessions(stream), "t_timer_sessions")
    want = ev.sessions(spark.read.parquet(path).where("user_id >= 0")).select("user_id", "start", "n")
    assert rows(got) == rows(want) and (9, noon, 3) in rows(got)


def test_streams_read_spans_in_order(spark, tmp_path):
    """The first span's file is the last to be finished if all are written at once; some rows have no time or no user."""
    events = spark.range(3000).selectExpr("id AS event_id", "timestampadd(SECOND, CAST(id * 60 + pmod(hash(id), 3000) AS INT), timestamp_ntz '2024-01-01 00:00:00') AS ts", "id % 20 AS user_id", "'click' AS event_type", "1D AS value", "if(id < 1000, repeat(sha2(CAST(id AS STRING), 256), 500), '{}') AS props")
    odd = events.where("event_id < 40").selectExpr("event_id + 5000 AS event_id", "if(event_id < 3, NULL, ts) AS ts", "if(event_id < 20, NULL, user_id) AS user_id", "event_type", "value", "props")
    events.unionByName(odd).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = catalog.queries()["stream_sessions_by_timers"](spark, str(tmp_path))
    want = duck.sql(catalog.oracle_sql()["stream_sessions_by_timers"])
    assert rows(got.select(*want.columns)) == sorted(want.fetchall(), key=repr)
    got = catalog.queries()["stream_tumbling_counts"](spark, str(tmp_path))
    assert got.groupBy().sum("n").first()[0] == 3040 - 3  # those without a time have no hour


def test_streams_of_no_events(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_sessions_by_timers", "stream_tumbling_counts"):
        assert catalog.queries()[name](spark, str(tmp_path)).collect() == []


def test_sessions_cost_one_timer_a_user():
    """However many sessions are open, one timer is set, and one call closes all that are past."""
    timers_set, told = set(), []
    state = SimpleNamespace(rows=[], get=lambda: iter(state.rows), put=lambda x: setattr(state, "rows", x), clear=lambda: setattr(state, "rows", []))
    handle = SimpleNamespace(getListState=lambda *_: state, registerTimer=lambda t: (timers_set.add(t), told.append(t)), deleteTimer=timers_set.discard, listTimers=lambda: iter(sorted(timers_set)))
    made = timers.Sessions(1000)
    made.init(handle)
    hour = [pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i) for i in range(60)]
    now = lambda t: SimpleNamespace(getCurrentWatermarkInMs=lambda: int(t.timestamp() * 1000), getExpiryTimeInMs=lambda: min(timers_set))
    assert list(made.handleInputRows((1, False), iter([pd.DataFrame({"ts": hour})]), now(hour[0]))) == []
    assert len(timers_set) == len(told) == 1
    (out,) = made.handleExpiredTimer((1, False), now(hour[40]), now(hour[40]))
    assert out.n.tolist() == [1] * 40 and out.start.tolist() == hour[:40] and len(state.rows) == 20 and len(timers_set) == 1


@pytest.mark.parametrize("name", ["stream_sessions_by_timers", "stream_tumbling_counts"])
def test_streams_as_queries_leave_the_session_as_it_was(spark, name):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    assert catalog.queries()[name](spark, SF).count() > 0 and spark.conf.get(key, None) == old


def test_table_function_checks_its_arguments(spark):
    catalog.queries()["udtf_sessions"](spark, SF)
    with pytest.raises(PySparkException):
        spark.sql("SELECT * FROM sessionize(row => TABLE(SELECT 1 AS x), gap => 30)").collect()
    one = spark.sql("SELECT * FROM sessionize(row => TABLE(SELECT 5L AS user_id, explode(array(TIMESTAMP_NTZ'2024-01-01 00:00:00', TIMESTAMP_NTZ'2024-01-01 00:30:01', TIMESTAMP_NTZ'2024-01-01 01:00:01')) AS ts) PARTITION BY user_id ORDER BY ts, gap => 30)")
    assert [(r.user_id, r.n) for r in one.orderBy(F.col("start")).collect()] == [(5, 1), (5, 2)]
