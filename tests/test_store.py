"""Stored logs: stamped once, typed order, restarts, racing writers, hot keys, point reads without jobs; subscriptions as tables."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from rillflow.engine import Engine
from rillflow.errors import ConfigurationError, RillError, StreamNotFound, SubscriptionError
from rillflow.files import Files
from rillflow.store import StoredLog
from rillflow.subscription import Subscription, Subscriptions
from rillflow.udf import ColumnMap, Fold

CONFIG = """
[schema.note]
k = "string"
v = "int64"
[schema.both]
k = "string"
a = "int64"
b = "int64"
[streams.a]
schema = "note"
partition_key = "k"
[streams.b]
schema = "note"
partition_key = "k"
[streams.twice]
base = "a"
type = "map"
schema = "note"
partition_key = "k"
fn = "twice"
[streams.sums]
base = "twice"
type = "reduce"
schema = "note"
partition_key = "k"
fn = "sum"
[streams.both]
base = "a"
type = "join"
schema = "both"
partition_key = "k"
join = ["b"]
map = { k = "a.k", a = "a.v", b = "b.v" }
"""


def fresh(spark, **more):
    e = Engine(spark, **more)
    e.register_udf("twice", ColumnMap(lambda c: {"v": c["v"] * 2}))
    e.register_udf("sum", Fold({"v": "sum"}))
    e.apply_config(CONFIG)
    return e


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("k", "_offset").collect()]


def jobs(spark, f):
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
        out = f()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_order_is_typed_and_given_once(spark):
    e = fresh(spark)
    e.produce("a", spark.createDataFrame([("x", v) for v in (9, 10, 2, 100)] + [(None, 1)], "k string, v bigint"), ["v"])
    e.produce("a", spark.createDataFrame([("x", 1), ("y", None)], "k string, v bigint").repartition(3), ["v"])
    assert rows(e.stream("a"), "k", "v", "_offset") == [("x", 2, 0), ("x", 9, 1), ("x", 10, 2), ("x", 100, 3), ("x", 1, 4), ("y", None, 0)]
    e.produce("a", spark.range(50).select(F.lit("z").alias("k"), F.col("id").alias("v")).repartition(5))
    first, second = (sorted(map(str, e.stream("a").collect())) for _ in range(2))
    assert first == second and len({r._timestamp for r in e.stream("a").collect()}) == 3
    early = e.stream("a").where("k = 'x'").agg(F.min("_timestamp")).first()[0]
    assert e.at_timestamp("a", early, "x").first()._offset == 0 and e.at_timestamp("a", early + dt.timedelta(days=1), "x").count() == 0


def test_joins_follow_arrival(spark):
    e = fresh(spark)
    e.produce_json("b", {"k": "1", "v": 7})
    e.produce_json("a", {"k": "1", "v": 1})
    assert rows(e.stream("both"), "_offset", "a", "b") == [(0, None, 7), (1, 1, 7)]
    # An event time may run against arrival.
    e.produce("b", spark.createDataFrame([("1", 8, dt.datetime(1990, 1, 1))], "k string, v bigint, t timestamp_ntz"), timestamp="t")
    assert rows(e.stream("both"), "a", "b")[2:] == [(1, 8)]


def test_many_appends_are_few_folders(spark):
    e = fresh(spark)
    for i in range(1000):
        e.produce_json("a", {"k": str(i % 3), "v": i})
    df = e.stream("a")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert e.stored("a").version < 20 and df.count() == 1000
    assert rows(df.where("k = '1'"), "v", "_offset")[:3] == [(1, 0), (4, 1), (7, 2)]
    for i in range(11):
        e.produce("b", spark.createDataFrame([("x", i)], "k string, v bigint"))
    assert len(e.stored("b").live()) == 2 and rows(e.stream("b"), "v", "_offset") == [(i, i) for i in range(11)]
    assert e.stream("b")._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_racing_writers_give_dense_offsets(spark, tmp_path):
    struct = fresh(spark).topography.struct("a")

    def writer(i):
        log = StoredLog(spark, str(tmp_path / "log"), "k", struct)  # a log object of its own, so only the commit decides
        for j in range(2):
            at = F.lit("2024-01-01").cast("timestamp_ntz")
            log.append(spark.createDataFrame([("one", i * 10 + j), (str(i), j)], "k string, v bigint").select("*", at.alias("_timestamp"), at.alias("_arrival")), ["v"], "2024-01-01 00:00:00")

    threads = [threading.Thread(target=writer, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = rows(StoredLog(spark, str(tmp_path / "log"), "k", struct).read(), "k", "_offset", "v")
    assert [o for k, o, _ in got if k == "one"] == list(range(6)) and sorted(v for k, _, v in got if k == "one") == sorted(i * 10 + j for i in range(3) for j in range(2))
    assert all([(o, v) for k, o, v in got if k == str(i)] == [(0, 0), (1, 1)] for i in range(3))
    files = Files(spark)
    assert files.put_new(str(tmp_path / "c" / "1"), "x") and not files.put_new(str(tmp_path / "c" / "1"), "y") and files.read(str(tmp_path / "c" / "1")) == "x"


def test_hot_batch_is_numbered_by_several_tasks(spark):
    cold, hot = fresh(spark), fresh(spark, hot_rows=20)
    r = random.Random(3)
    data = spark.createDataFrame([(r.choice(("h", "h", "h", "c")), v) for v in r.sample(range(1000), 300)], "k string, v bigint")
    for e in (cold, hot):
        e.produce("a", data, ["v"])
        e.bind_source("b", data, ["v"])
    assert hot.is_hot("sums") and hot.is_hot("b") and not cold.is_hot("b")
    for s in ("a", "b", "sums"):
        assert rows(cold.stream(s), "k", "_offset", "v") == rows(hot.stream(s), "k", "_offset", "v")
    assert hot.log("b").select("_stretch").distinct().count() > 1


def test_point_reads_start_no_job(spark, sf):
    from rillflow.plans import catalogue

    e = fresh(spark)
    e.produce("a", spark.createDataFrame([(str(i % 9), i) for i in range(90)], "k string, v bigint"), ["v"])
    for engine, stream, key in ((e, "a", "3"), (e, "sums", "3"), (catalogue.engine(spark, sf), "events", 7), (catalogue.engine(spark, sf), "doubled_total", 7)):
        for ask in (lambda: engine.at(stream, key, 3), lambda: engine.latest(stream, key), lambda: engine.at_timestamp(stream, "2024-01-05", key), lambda: engine.range(stream, key, 1, 2)):
            df, started = jobs(spark, ask)
            assert started == 0
            assert df.count() >= 0
    plan = e.at("a", "3", 4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(k,3)" in plan and "Exchange" not in plan
    assert e.record("a", "3", 4)["v"] == 39


def test_restart_has_everything(spark, tmp_path):
    store = f'[storage.s]\ntype = "file"\npath = "{tmp_path}/data"\n'
    e = fresh(spark, path=str(tmp_path / "meta"))
    e.apply_config(store)
    e.produce("a", spark.createDataFrame([("x", 1), ("x", 2)], "k string, v bigint"), ["v"])
    e.produce("b", spark.createDataFrame([("x", 5)], "k string, v bigint"))
    e.write("sums")
    again = Engine(spark, path=str(tmp_path / "meta"))
    assert rows(again.stream("sums"), "v", "_offset") == [(2, 0), (6, 1)] and again._is_written("sums")
    assert "map" not in again.stream("sums")._jdf.queryExecution().optimizedPlan().toString()
    again.produce("a", spark.createDataFrame([("x", 3)], "k string, v bigint"))
    assert rows(again.stream("sums"), "v", "_offset") == [(2, 0), (6, 1), (12, 2)]  # what was written is out of date, so it isn't read
    assert rows(again.stream("both"), "a", "b")[-2:] == [(2, 5), (3, 5)]
    for s in ("both", "sums", "twice"):
        again.drop_stream(s)
    with pytest.raises(ConfigurationError):
        again.apply_config(CONFIG.replace('v = "int64"', 'v = "string"'))
    third = Engine(spark, path=str(tmp_path / "meta"))
    with pytest.raises(StreamNotFound):
        third.stream("sums")
    assert third.metadata("a")["records"] == 3 and third.metadata("a")["children"] == []


def test_batches_tried_again_and_bound_sources(spark):
    e = fresh(spark)
    batch = spark.createDataFrame([("x", 1)], "k string, v bigint")
    for _ in range(3):
        e.produce("a", batch, token="one")
    assert e.stream("a").count() == 1
    e.bind_source("b", spark.createDataFrame([("x", 1), ("x", 2)], "k string, v bigint"), ["v"])
    e.produce("b", batch)
    assert rows(e.stream("b"), "v", "_offset") == [(1, 0), (2, 1), (1, 2)]
    e.bind_source("a", spark.createDataFrame([("x", 1), ("x", 1)], "k string, v bigint"), ["v"])
    with pytest.raises(RillError):
        e.write("a")  # the order ties
    e.produce("b", batch.limit(0))
    assert e.stream("b").count() == 3


def test_ingest_stores_each_micro_batch_once(spark, tmp_path):
    e = fresh(spark)
    for i in range(3):
        spark.createDataFrame([("x", i), ("y", i)], "k string, v bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("k string, v bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        e.ingest("a", source, str(tmp_path / "c"), ["v"]).awaitTermination(120)
    assert rows(e.stream("sums").where("k = 'x'"), "v", "_offset") == [(0, 0), (2, 1), (6, 2)]


def test_subscriptions_equal_the_state_machine(spark, tmp_path):
    r = random.Random(7)
    table, plain = Subscriptions(spark, str(tmp_path / "s"), "s", 100), Subscription("s", 100)
    ends, now = {}, 0
    for step in range(15):
        now += r.choice((10, 60, 120))
        what = r.choice(("produced", "take", "take", "acknowledge", "acknowledge", "expire"))
        if what == "produced":
            for k in r.sample("abcd", 2):
                ends[k] = ends.get(k, -1) + r.randrange(1, 6)
                plain.produced(k, ends[k])
            table.produced(spark.createDataFrame([*ends.items(), (None, 3)], "key string, end bigint"))
        elif what == "take":
            n, client = r.randrange(6), r.choice((1, 2))
            want = plain.take(client, n, now)
            assert sorted(tuple(x) for x in table.take(client, n, now).collect()) == sorted(want), step
        elif what == "acknowledge":
            ranges = sorted((k, a, a + r.randrange(4)) for k in r.sample("abcdz", 3) for a in [r.randrange(4) + (plain.cursors[k].committed if k in plain.cursors and r.random() < 0.8 else 0)])
            refused = len(plain.acknowledge_all(ranges))
            assert table.acknowledge(spark.createDataFrame(ranges, "key string, first bigint, last bigint")).count() == refused, step
        else:
            assert sorted(x.key for x in table.expire(now).collect()) == sorted(plain.expire(now))
        got = {x.key: (x.start, x.end, x.committed, x.inflight) for x in table.cursors().collect()}
        assert got == {k: (c.start, c.end, c.committed, c.inflight_ms) for k, c in plain.cursors.items()}, (step, what)
        assert {c: n for c, n in table.demand.items() if n} == {c: n for c, n in plain.demand.items() if n}
    assert sorted((x.key, x.first, x.last) for x in table.ranges().collect()) == sorted(plain.ranges())
    again = Subscriptions(spark, str(tmp_path / "s"))
    assert {x.key: (x.start, x.committed) for x in again.cursors().collect()} == {k: (c.committed, c.committed) for k, c in plain.cursors.items()}
    with pytest.raises(SubscriptionError):
        table.produced(spark.createDataFrame([("q", 1)], "key string, end bigint"))  # the other one moved it
    with pytest.raises(SubscriptionError):
        again.take(1, -1, 0)
    first = [tuple(x) for x in again.take(1, 2, now, "t").collect()]
    assert sorted(first) == sorted(tuple(x) for x in again.take(1, 2, now, "t").collect()) and again.demand.get(1, 0) == 0
