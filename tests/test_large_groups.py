"""Ranks, quantiles and sketches against plain versions: nulls, ties, hot groups, extreme values, empty tables."""

import bisect
import collections
import math
import random
import statistics
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.operators import joins, quantiles, ranking, sketches
from quillon.plans import catalog
from quillon.sources import buckets

SF = "/root/testdata/sf0.001"


def groups(rows):
    out = collections.defaultdict(list)
    for g, *rest in rows:
        out[g].append(tuple(rest))
    return out


def brute_ranks(rows, tiles):
    """rows (g, x, i), nulls first: (i -> the six ranks)."""
    out = {}
    low = lambda x: (x is not None, x or 0)
    for members in groups(rows).values():
        members.sort(key=lambda m: (low(m[0]), m[1]))
        n, xs = len(members), [low(m[0]) for m in members]
        cut = [n // tiles + (t < n % tiles) for t in range(tiles)]
        tile = [t + 1 for t, size in enumerate(cut) for _ in range(size)]
        distinct = sorted(set(xs))
        for k, (_, i) in enumerate(members):
            first, last = bisect.bisect_left(xs, xs[k]), bisect.bisect_right(xs, xs[k])
            out[i] = (k + 1, first + 1, bisect.bisect_left(distinct, xs[k]) + 1, first / (n - 1) if n > 1 else 0.0, last / n, tile[k])
    return out


@pytest.mark.parametrize("ties", [3, 4096])
def test_ranks(spark, monkeypatch, ties):
    monkeypatch.setattr(ranking, "TIES", ties)
    rng = random.Random(1)
    # a hot group, a null group, a group of one row, ties, nulls; a column with a name that the operator might take
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.choice([None, 1, 1, 1, 2, 3, 5, 8]), i) for i in range(900)] + [(7, 4, 900)]
    d = spark.createDataFrame([(*r, 0) for r in rows], "g int, x int, i int, __at int").repartition(5)
    names = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")
    got = {r.i: tuple(r[c] for c in names) for r in ranking.ranked(d, ["g"], ["x"], ["i"], 4).collect()}
    want = brute_ranks(rows, 4)
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i] == pytest.approx(w)


def test_numbers_of_the_whole_table_and_of_nothing(spark):
    d = spark.range(100).selectExpr("id", "id % 7 AS x").repartition(6)
    got = [(r.id, r.n, r.rows) for r in ranking.numbered(d, [], ["x", "id"], "n", "rows", descending=["x"]).collect()]
    order = sorted(range(100), key=lambda i: (-(i % 7), i))
    assert sorted(got) == sorted((i, k + 1, 100) for k, i in enumerate(order))
    assert ranking.numbered(d.limit(0), ["x"], ["id"]).collect() == []
    assert ranking.ranked(d.limit(0), ["x"], ["id"]).collect() == []
    with pytest.raises(ValueError):
        ranking.ranked(d.withColumnRenamed("x", "Rank"), ["Rank"], ["id"])


def test_a_hot_group_lies_in_many_partitions(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(ranking, "staged", lambda d, name, put=ranking.staged: kept.append(put(d, name)) or kept[-1])
    d = spark.range(0, 4000, 1, 8).selectExpr("1 AS g", "(id * 7919) % 4000 AS x")
    assert ranking.numbered(d, ["g"], ["x"]).where("row_number <> x + 1").count() == 0
    parts = kept[0].groupBy(F.shiftright("__at", 33)).count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) < 2500


def test_quantiles(spark):
    rng = random.Random(2)
    kinds = {
        "plain": [rng.gauss(0, 1000) for _ in range(700)], "ties": [rng.choice([1.0, 2.0]) for _ in range(500)], "one": [5.5], "hot": [3.25] * 400,
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(400)] + [0.0, -0.0], "close": [1 + k * 2**-52 for k in range(300)],
        "ends": [math.inf, -math.inf, 1.0, 2.0, 1e308, -1e308, 5e-324],
    }
    rows = [(None if g == "ties" else g, x) for g, xs in kinds.items() for x in xs] + [("plain", None), ("none", None)]
    rng.shuffle(rows)
    wanted = {f"{k}_{i}": (k, q) for k in ("cont", "disc") for i, q in enumerate((0, 0.01, 0.25, 0.5, 0.75, 0.999, 1))}
    got = {r.g: r for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", wanted).collect()}
    assert got.keys() == {None if g == "ties" else g for g in kinds}
    for g, xs in kinds.items():
        xs = sorted(xs)
        for name, (kind, q) in wanted.items():
            if kind == "disc":
                want = xs[max(math.ceil(q * len(xs)) - 1, 0)]
            else:
                at = q * (len(xs) - 1)
                a, b = xs[math.floor(at)], xs[math.ceil(at)]
                want = a if math.floor(at) == math.ceil(at) else a + (at - math.floor(at)) * (b - a)
            r = got[None if g == "ties" else g][name]
            assert r == want or (math.isnan(r) and math.isnan(want)), (g, name, r, want)
    assert statistics.median(kinds["plain"]) == pytest.approx(got["plain"].cont_3)


def test_quantiles_of_nan_and_of_nothing(spark):
    d = spark.createDataFrame([(1.0,), (math.nan,), (math.nan,), (2.0,), (None,)], "x double")
    r = quantiles.exact_quantiles(d, [], "x", {"low": ("disc", 0.5), "high": ("disc", 1.0)}).collect()[0]
    assert r.low == 2.0 and math.isnan(r.high)
    assert [r.m for r in quantiles.exact_quantiles(d.limit(0), [], "x", {"m": ("cont", 0.5)}).collect()] == [None]
    assert quantiles.exact_quantiles(d.limit(0).withColumn("g", F.lit(1)), ["g"], "x", {"m": ("cont", 0.5)}).collect() == []
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(d, [], "x", {"m": ("cont", 1.5)})


def test_sketches_are_replaced_by_part(spark, tmp_path):
    d = spark.range(1000).selectExpr("id % 4 AS part", "id % 3 AS g", "id % 300 AS item", "CAST(id AS DOUBLE) AS x")
    path = str(tmp_path / "s")
    sketches.store(sketches.summarised(d, "part", ["g"], "item", "x"), path, "part")
    sketches.store(sketches.summarised(d.where("part = 1"), "part", ["g"], "item", "x"), path, "part")  # the same again
    stored = spark.read.parquet(path)
    assert sum(r.n for r in sketches.merged(stored, ["g"]).collect()) == 1000
    r = sketches.merged(stored.where("part < 2"), []).select("n", sketches.distinct("items_hll").alias("d"), sketches.top("items_top", 2).alias("t")).collect()[0]
    assert r.n == 500 and abs(r.d - 150) <= 8 and all(t["count"] == 4 for t in r.t)


def test_count_min_is_additive_and_never_low(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b"]) if rng.random() < 0.5 else f"k{rng.randrange(400)}",) for _ in range(3000)] + [(None,)]
    d = spark.createDataFrame(rows, "k string")
    true = collections.Counter(k for (k,) in rows if k)
    whole, halves = sketches.counters(d, "k", 64, 4), sketches.added(sketches.counters(d.where("k < 'b'"), "k", 64, 4), sketches.counters(d.where("k >= 'b'"), "k", 64, 4))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, halves.collect()))
    asked = spark.createDataFrame([(k,) for k in [*true, "absent"]], "k string")
    got = {r.k: r.estimate for r in sketches.estimated(whole, asked, "k", 64, 4).collect()}
    assert got.keys() == {*true, "absent"} and all(got[k] >= n for k, n in true.items())
    assert sum(got[k] - true[k] > 2.72 / 64 * 3000 for k in got) <= 0.05 * len(got)


def test_as_of_matches_null_values_as_the_other_engine(spark):
    rng = random.Random(4)
    at = lambda m: datetime(2024, 1 + m // 20, 1 + m % 20)
    left = [(i, rng.choice([1, 2, None]), rng.choice([at(rng.randrange(60)), None])) for i in range(120)]
    right = [(k, at(m), rng.choice([None, rng.randrange(9)])) for k in (1, 2) for m in rng.sample(range(60), 25)] + [(None, at(3), 5), (1, None, 6)]
    con = duckdb.connect()
    con.execute("CREATE TABLE l (i INT, k INT, t TIMESTAMP)")
    con.execute("CREATE TABLE r (k INT, t TIMESTAMP, v INT)")
    con.executemany("INSERT INTO l VALUES (?, ?, ?)", left)
    con.executemany("INSERT INTO r VALUES (?, ?, ?)", right)
    want = con.sql("SELECT i, v FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.t >= r.t").fetchall()
    got = joins.as_of(spark.createDataFrame(left, "i int, k int, t timestamp"), spark.createDataFrame(right, "k int, t timestamp, v int"), "k", "t", "v", "out").select("i", "out").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_broadcast_behind_a_size(spark):
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    few = spark.range(10)
    assert "broadcast" in plan(spark.range(5).join(joins.small(few, 10), "id")) and "broadcast" not in plan(spark.range(5).join(joins.small(few, 9), "id"))


def test_bucketed_tables_join_without_an_exchange(spark):
    a = spark.range(500).selectExpr("id % 90 AS k", "id AS a")
    b = spark.range(100).selectExpr("id AS k", "id * 2 AS b")
    left, right = buckets.bucketed(a, "k", 6), buckets.bucketed(b, "k", 6)
    both = buckets.joined(spark, left, right, "k")
    for d in (both, both.groupBy("k").count()):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, a.join(b, "k").collect()))
    for name in (left, right):
        spark.sql(f"DROP TABLE {name}")


def test_largest_counts_of_more_items_than_are_tracked(spark, tmp_path, monkeypatch):
    """Counts stay those of the table where a sketch's would be estimates; events without a type or a time are rows too."""
    monkeypatch.setattr(sketches, "TRACKED", 50)
    made = spark.range(4000).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(CAST(id % 5 AS INT)) AS ts", "CASE WHEN id < 9 THEN 7 WHEN id < 15 THEN 8 WHEN id % 200 = 50 THEN NULL ELSE id DIV 2 END AS user_id", "IF(id % 2 = 0, 'click', 'view') AS event_type", "CAST(id AS DOUBLE) AS value")
    odd = made.where("event_id < 60").selectExpr("event_id + 5000 AS event_id", "IF(event_id < 30, NULL, ts) AS ts", "user_id", "IF(event_id < 30, event_type, NULL) AS event_type", "value")
    made.unionByName(odd).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = duck.sql(catalog.oracle_sql()["sketches_merged"])
    got = catalog.queries()["sketches_merged"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
