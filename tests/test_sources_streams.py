"""Formats round trip; streams agree with batch results behind the watermark."""

import collections
from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException

from quillon.sources import files
from quillon.streaming import events as ev

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "json", "xml"])
def test_formats(spark, tmp_path, kind):
    d = spark.createDataFrame([(1, "a"), (2, "b c"), (3, None)], "k long, v string")
    files.write(d, str(tmp_path / kind), kind)
    assert sorted(files.read(spark, str(tmp_path / kind), kind, "k long, v string").collect()) == sorted(d.collect())


def test_text_format(spark, tmp_path):
    d = spark.createDataFrame([("a",), ("b c",), ("",)], "value string")
    files.write(d, str(tmp_path / "text"), "text")
    assert sorted(files.read(spark, str(tmp_path / "text"), "text").collect()) == sorted(d.collect())


def test_partitioned_write_prunes(spark, tmp_path):
    d = spark.range(10).selectExpr("id", "id % 2 AS part")
    files.write(d, str(tmp_path / "p"), by=("part",))
    assert files.read(spark, str(tmp_path / "p")).where("part = 1").count() == 5


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        files.read(spark, "x", "avro")


def test_python_source(spark):
    assert sorted(r.n for r in files.sequence(spark, 10, 3).collect()) == list(range(10))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "files")
    ev.publish(spark.read.parquet(f"{SF}/events.parquet"), path, 3)
    return path


def test_tumbling_stream(spark, folder):
    batch = {tuple(r) for r in ev.tumbling(spark.read.parquet(folder)).collect()}
    got = {tuple(r) for r in ev.drain(ev.tumbling(ev.source(spark, folder, 100)), "t_tumbling").collect()}
    closed = max(r[0] for r in batch) - timedelta(hours=2)
    assert {r for r in batch if r[0] < closed} <= got <= batch


def closed(found, hours):
    """What must have left a stream whose last watermark lies an hour behind the last event."""
    end = max(r.ts for r in found.collect()) - timedelta(hours=1)
    return lambda start: start + timedelta(hours=hours) < end


def test_session_stream(spark, folder):
    batch = {tuple(r) for r in ev.sessions(spark.read.parquet(folder)).collect()}
    got = {tuple(r) for r in ev.drain(ev.sessions(ev.source(spark, folder, 100)), "t_sessions").collect()}
    gone = closed(spark.read.parquet(folder), 12)  # no session here lasts so long
    want = {r for r in batch if gone(r[1])}
    assert len(want) > 100 and want <= got <= batch


def test_sliding_stream(spark, folder):
    batch = {tuple(r) for r in ev.sliding(spark.read.parquet(folder)).collect()}
    got = {tuple(r) for r in ev.drain(ev.sliding(ev.source(spark, folder, 100)), "t_sliding").collect()}
    gone = closed(spark.read.parquet(folder), 1)
    want = {r for r in batch if gone(r[0])}
    assert len(want) > 100 and want <= got <= batch


def test_tumbling_stream_complete(spark, folder):
    batch = {tuple(r) for r in ev.tumbling(spark.read.parquet(folder)).collect()}
    assert {tuple(r) for r in ev.drain(ev.tumbling(ev.source(spark, folder, 100)), "t_complete", "complete").collect()} == batch


def test_deduplication_stream(spark, folder):
    got = [(r.user_id, r.event_type) for r in ev.drain(ev.first_of_kind(ev.source(spark, folder, 100)), "t_first").collect()]
    want = {(r.user_id, r.event_type) for r in spark.read.parquet(folder).collect()}
    assert set(got) == want and len(got) == len(want)  # one batch: nothing leaves the watermark in between


def test_stream_stream_join(spark, folder):
    plain = spark.read.parquet(folder)
    batch = {tuple(r) for r in ev.clicks_then_purchases(plain, plain).collect()}
    got = ev.drain(ev.clicks_then_purchases(ev.source(spark, folder, 100), ev.source(spark, folder, 100)), "t_join")
    assert {tuple(r) for r in got.collect()} == batch and batch


def test_late_rows_are_dropped(spark, tmp_path):
    path = str(tmp_path / "late")
    row = lambda i, at: (i, at, 1, "click", 1.0, "{}")
    noon = datetime(2024, 1, 1, 12)
    for batch in ([row(1, noon), row(2, noon + timedelta(hours=5))], [row(4, noon + timedelta(hours=9))], [row(3, noon)], [row(5, noon + timedelta(hours=12))]):
        spark.createDataFrame(batch, ev.SCHEMA).coalesce(1).write.mode("append").parquet(path)
    got = {tuple(r) for r in ev.drain(ev.tumbling(ev.source(spark, path, 1)), "t_late").collect()}
    assert (noon, "click", 1) in got  # row 3 came behind the watermark


def test_files_and_batches(spark, folder, tmp_path):
    want = sorted(r.event_id for r in spark.read.parquet(folder).collect())
    for run in (ev.to_files, ev.each_batch):
        out = str(tmp_path / run.__name__)
        run(ev.source(spark, folder), out, out + "-checkpoint")
        assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == want


def test_console(spark, folder):
    """Prints by the driver's JVM, beside what pytest captures: it ends, and refuses a mode that the query has not."""
    counts = ev.tumbling(spark.readStream.schema(ev.SCHEMA).parquet(folder))
    ev.to_console(counts, 5, "complete")
    with pytest.raises(AnalysisException):
        ev.to_console(counts)  # no watermark


def test_counts_stream(spark, folder):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ev.ROCKSDB)
    try:
        want = {r.user_id: r["count"] for r in spark.read.parquet(folder).groupBy("user_id").count().collect()}
        got = collections.defaultdict(int)
        for r in ev.drain(ev.running_counts(ev.source(spark, folder)), "t_counts", "update").collect():
            got[r.user_id] = max(got[r.user_id], r.n)
        assert got == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if old is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_totals_stream(spark, folder):
    want = {r.user_id: r.n for r in spark.read.parquet(folder).groupBy("user_id").count().withColumnRenamed("count", "n").collect()}
    got = {}
    for r in ev.drain(ev.running_totals(ev.source(spark, folder)), "t_totals", "update").collect():
        got[r.user_id] = max(got.get(r.user_id, 0), r.n)
    assert got == want
