"""The engine on literal records, and batch against streaming."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from rillflow.engine import Engine
from rillflow.errors import FunctionNotFound, RecordNotFound, RillError, SourceError
from rillflow.operators.log import as_log
from rillflow.operators.reduce import apply_reduce
from rillflow.udf import ArrowMap, ColumnMap, Fold, PyFold

T0 = dt.datetime(2024, 1, 1)
# Schemas and records of the cases whose results must match.
CUSTOMERS = """
[schema.customer]
id = "string"
first_name = "string"
last_name = "string"
age = "int32"
[schema.address]
customer_id = "string"
address_line_1 = "string"
city = "string"
province = "string"
[schema.customer_address]
customer_id = "string"
customer_first_name = "string"
age = "int32"
address_line_1 = "string"
city = "string"
[streams.customer]
schema = "customer"
partition_key = "id"
[streams.address]
schema = "address"
partition_key = "customer_id"
[streams.customer_address]
type = "join"
schema = "customer_address"
partition_key = "customer_id"
base = "customer"
join = ["address"]
map = {
    customer_id = "customer.id",
    customer_first_name = "customer.first_name",
    age = "customer.age",
    address_line_1 = "address.address_line_1",
    city = "address.city",
}
"""
PIPELINE = """
[schema.reading]
id = "string"
data = "int32"
[schema.enriched]
id = "string"
data = "int32"
doubled = "int32"
[streams.readings]
schema = "reading"
partition_key = "id"
[streams.doubled]
base = "readings"
type = "map"
schema = "reading"
partition_key = "id"
fn = "double"
[streams.total]
base = "doubled"
type = "reduce"
schema = "reading"
partition_key = "id"
fn = "sum"
[streams.recent]
base = "total"
type = "window"
schema = "reading"
partition_key = "id"
window = { type = "count", interval = "5" }
[streams.enriched]
base = "readings"
type = "join"
schema = "enriched"
partition_key = "id"
join = ["doubled"]
map = { id = "readings.id", data = "readings.data", doubled = "doubled.data" }
"""


def pipeline(spark):
    e = Engine(spark)
    e.register_udf("double", ColumnMap(lambda c: {"data": c["data"] * 2}))
    e.register_udf("sum", Fold({"data": "sum"}))
    e.apply_config(PIPELINE)
    return e


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("id", "_offset").collect()]


def test_produce_map_reduce_window(spark):
    e = pipeline(spark)
    assert e.ping()
    e.produce_json("readings", [{"id": "1", "data": i} for i in (1, 2, 3)])
    e.produce_json("readings", ['{"id": "2", "data": 7}', '{"id": "1", "data": null}'])
    e.produce_json("readings", [{"id": "1", "data": i} for i in range(4, 10)])
    assert values(e.stream("readings"), "id", "_offset", "data") == [("1", 0, 1), ("1", 1, 2), ("1", 2, 3), ("1", 3, None), *[("1", i, i) for i in range(4, 10)], ("2", 0, 7)]
    assert values(e.stream("doubled").where("id = '1'"), "data")[:4] == [(2,), (4,), (6,), (None,)]
    assert values(e.stream("total").where("id = '1'"), "data")[:5] == [(2,), (6,), (12,), (12,), (20,)]
    w = values(e.stream("recent"), "id", "_offset", "first_offset", "last_offset", "data")
    assert w == [("1", 0, 0, 4, 20), ("1", 1, 5, 9, 90), ("2", 0, 0, 0, 14)]
    assert e.record("readings", "1", 2)["data"] == 3 and e.record("readings", "1")["_offset"] == 9
    with pytest.raises(RecordNotFound):
        e.record("readings", "1", 10)
    assert e.range("readings", "1", 2, 4).count() == 3
    with pytest.raises(SourceError):
        e.produce_json("readings", "[1]")
    with pytest.raises(SourceError):
        e.produce_json("doubled", {"id": "1"}) or e.bind_source("doubled", spark.range(1), ["id"])


def test_customer_address(spark):
    e = Engine(spark)
    e.apply_config(CUSTOMERS)
    at = dt.datetime(2024, 1, 1)
    e.bind_source("customer", spark.createDataFrame([("1", "John", "Doe", 30, at), ("2", "Ann", None, None, at)], "id string, first_name string, last_name string, age int, t timestamp_ntz"), ["t"])
    e.bind_source("address", spark.createDataFrame([("1", "1 John Road", "John City", "P", at + dt.timedelta(days=40)), ("1", None, "Other", "P", at + dt.timedelta(days=80)), ("3", "x", "y", "z", at)], "customer_id string, address_line_1 string, city string, province string, t timestamp_ntz"), ["t"])
    got = [tuple(r) for r in e.stream("customer_address").orderBy("customer_id", "_offset").select("customer_id", "customer_first_name", "age", "address_line_1", "city", "_offset").collect()]
    assert got == [("1", "John", 30, None, None, 0), ("1", "John", 30, "1 John Road", "John City", 1), ("1", "John", 30, None, "Other", 2), ("2", "Ann", None, None, None, 0), ("3", None, None, "x", "y", 0)]


def test_diamond_gives_each_arrival(spark):
    e = pipeline(spark)
    e.produce_json("readings", {"id": "1", "data": 21})
    assert values(e.stream("enriched"), "data", "doubled") == [(21, None), (21, 42)]


def test_missing_function_and_source(spark):
    e = Engine(spark)
    e.apply_config(PIPELINE)
    with pytest.raises(SourceError):
        e.stream("readings")
    e.bind_source("readings", spark.createDataFrame([("1", 1)], "id string, data int"), ["data"])
    with pytest.raises(FunctionNotFound):
        e.stream("doubled")
    e.register_udf("double", Fold({"data": "sum"}))
    with pytest.raises(FunctionNotFound):
        e.stream("doubled")
    with pytest.raises(RillError):
        e.register_udf("x", lambda c: c)
    with pytest.raises(SourceError):
        e.bind_source("readings", spark.createDataFrame([("1",)], "id string"), ["id"])
        e.stream("readings")


def test_ties_nulls_repeats_and_clashing_columns(spark):
    rows = [("a", 1, 5), ("a", 1, 5), (None, 1, 1), ("a", 0, None), ("a", 1, 3)]
    df = spark.createDataFrame(rows, "id string, t int, data int").withColumn("_offset", F.lit("mine")).withColumn("_timestamp", F.lit(1)).withColumn("__n", F.lit(1))
    out = [as_log(df.orderBy(F.rand(i)), {"id": "string", "data": "int32"}, "id", ["t"]).orderBy("_offset").collect() for i in range(2)]
    assert [(r.id, r._offset) for r in out[0]] == [("a", i) for i in range(4)] and out[0][0].data is None
    assert out[0] == out[1]
    e = Engine(spark)
    e.apply_config(PIPELINE)
    e.bind_source("readings", df, ["t"])
    with pytest.raises(RillError):
        e.validate_order("readings")
    assert as_log(df.limit(0), {"id": "string"}, "id", ["t"]).count() == 0


def test_running_values_over_stretches_equal_one_window(spark):
    r = random.Random(1)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(6000)), i, r.choice((None, r.randrange(100)))) for k, i in itertools.product("ab", range(150))]
    df = spark.createDataFrame(rows, "id string, t timestamp_ntz, n int, data int")
    fields = {"id": "string", "data": "int32", "n": "int32"}
    log = as_log(df, fields, "id", ["t", "n"])
    assert log.select("_stretch").distinct().count() > 20
    for key in "ab":
        mine = sorted((x for x in rows if x[0] == key), key=lambda x: (x[1], x[2]))
        for step, f in (("sum", lambda v: sum(v) if v else None), ("min", lambda v: min(v, default=None)), ("max", lambda v: max(v, default=None)), ("last", lambda v: v[-1] if v else None), ("first", lambda v: v[0] if v else None)):
            got = [x.data for x in apply_reduce(log, Fold({"data": step}), "id", fields).where(F.col("id") == key).orderBy("_offset").collect()]
            want = [f([x[3] for x in mine[: i + 1] if x[3] is not None]) for i in range(len(mine))]
            assert got == want, step
        got = [x.data for x in apply_reduce(log, PyFold(lambda p, c: {**c, "data": (p["data"] or 0) + (c["data"] or 0)}), "id", fields).where(F.col("id") == key).orderBy("_offset").collect()]
        assert got[-1] == sum(x[3] or 0 for x in mine)


def test_hot_sources_run_in_stretches(spark, sf):
    from rillflow.plans import catalogue

    usual = catalogue.engine(spark, sf)
    hot = catalogue.engine(spark, sf)
    hot.hot_rows = 10
    assert not usual.is_hot("doubled_total") and hot.is_hot("doubled_total") and hot.is_hot("enriched")
    for name in ("events", "doubled_total", "pairs", "enriched"):
        a, b = (sorted(map(str, e.stream(name).collect())) for e in (usual, hot))
        assert a == b
    plan = usual.stream("doubled_total")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1


def test_hot_windows_of_an_order_without_time(spark):
    r = random.Random(6)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(6000)), i, r.choice((None, r.randrange(100)))) for k, i in itertools.product("ab", range(60))]
    df = spark.createDataFrame(rows, "id string, t timestamp_ntz, n int, data int")
    config = '''
[schema.r]
id = "string"
n = "int32"
data = "int32"
[streams.r]
schema = "r"
partition_key = "id"
[streams.w]
type = "window"
schema = "r"
partition_key = "id"
base = "r"
window = { type = "count", interval = "4", slide = "2" }
'''
    steps = ("sum", "last", "first", "count")
    config += "".join(f'[streams.{s}]\ntype = "reduce"\nschema = "r"\npartition_key = "id"\nbase = "w"\nfn = "{s}"\n' for s in steps)
    got = []
    for hot_rows in (1000, 10):
        e = Engine(spark, hot_rows=hot_rows)
        for s in steps:
            e.register_udf(s, Fold({"data": s}))
        e.apply_config(config)
        e.bind_source("r", df, ["n"], "t")
        got.append({s: values(e.stream(s), "id", "_offset", "data") for s in steps})
    assert e.is_hot("sum") and got[0] == got[1]
    e.bind_source("r", df, ["t", "n"])  # a time that leads the order still spreads the key
    assert e.log("w").select("_stretch").distinct().count() > 15


def test_key_filter_reaches_the_scan(spark, sf):
    from rillflow.plans.catalogue import engine

    plan = engine(spark, sf).at("events", 7, 3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,7)" in plan and "props" not in plan


def test_arrow_map_must_keep_rows(spark):
    e = Engine(spark)
    e.apply_config(PIPELINE)
    e.register_udf("double", ArrowMap(lambda b: b.slice(0, 0)))
    e.produce_json("readings", {"id": "1", "data": 1})
    with pytest.raises(Exception, match="one row for each row"):
        e.stream("doubled").collect()


def test_subscription_over_a_stream(spark):
    e = pipeline(spark)
    e.produce_json("readings", [{"id": str(i % 2), "data": i} for i in range(7)])
    s = e.subscribe("readings")
    taken = s.take(1, 3, 0)
    assert sorted(tuple(r) for r in taken.collect()) == [("1", 0), ("1", 1), ("1", 2)]
    assert sorted(r.data for r in e.deliver(s, taken).collect()) == [1, 3, 5]


def test_write_and_topography(spark, tmp_path):
    e = pipeline(spark)
    e.apply_config(f'[storage.a]\ntype = "file"\npath = "{tmp_path}/store"\n')
    e.produce_json("readings", {"id": "1", "data": 1})
    at = e.write("readings")
    assert spark.read.parquet(at).count() == 1
    again = Engine(spark)
    again.apply_config(e.topography_toml())
    assert again.topography.config == e.topography.config
    assert spark.table(e.view("readings")).count() == 1
    with pytest.raises(RillError):
        e.drop_stream("readings")


def test_streaming_equals_batch(spark, tmp_path):
    from rillflow.operators.map import apply_map
    from rillflow.streaming import stateful as S

    r = random.Random(3)
    rows = [(r.choice("abc"), i, r.randrange(50)) for i in range(60)]
    schema = "id string, n int, data int"
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(0.2)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    def source():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    fields = {"id": "string", "n": "int32", "data": "int32"}
    log = as_log(spark.createDataFrame(rows, schema), fields, "id", ["n"])
    want = sorted(tuple(x) for x in apply_reduce(log, Fold({"data": "sum"}), "id", fields).select("id", "n", "data", "_offset").collect())
    got = run(S.stream_reduce(source(), "id", ["n"], lambda p, c: {**c, "data": p["data"] + c["data"]}), "reduced", "append")
    assert sorted(tuple(x) for x in got.select("id", "n", "data", "_offset").collect()) == want
    doubled = run(apply_map(source(), ColumnMap(lambda c: {"data": c["data"] * 2}), fields), "mapped", "append")
    assert sorted(x.data for x in doubled.collect()) == sorted(2 * x[2] for x in rows)
    windows = run(S.stream_window(source(), "id", ["n"], 4, 2), "windows", "update")
    newest = {}
    for x in windows.collect():
        k = (x.id, x.window_no)
        newest[k] = max(newest.get(k, (0, ())), (x.last_offset, tuple(y.n for y in x.records)))
    from rillflow.operators.window import apply_count_window

    batch = {(x.id, x._offset): (x.last_offset, tuple(y.n for y in x.records)) for x in apply_count_window(log, "id", ["data", "id", "n"], 4, 2).collect()}
    assert newest == batch
    joined = run(S.stream_join({"left": (source().where("data < 25").withColumn("t", F.timestamp_seconds("n")), "id"), "right": (source().where("data >= 25").withColumn("t", F.timestamp_seconds("n")), "id")}, "id", {"id": "left.id", "l": "left.n", "r": "right.n"}, {"left": "t", "right": "t"}), "joined", "append")
    held, want = {}, []
    for k, n, d in rows:
        held.setdefault(k, [None, None])[d >= 25] = n
        want.append((k, *held[k]))
    assert sorted((x.id, x.l, x.r) for x in joined.collect() if x.l is not None and x.r is not None) == sorted(w for w in want if None not in w)


def test_push_delivery_and_timed_windows(spark, tmp_path):
    from rillflow.streaming import stateful as S
    from rillflow.subscription import Subscriptions

    spark.createDataFrame([("a", i, T0 + dt.timedelta(minutes=i)) for i in range(4)] + [("b", 9, T0)], "id string, n int, t timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id string, n int, t timestamp_ntz").parquet(str(tmp_path / "in"))
    sub, taken = Subscriptions(spark, str(tmp_path / "cursors"), "s", 500), []
    sub.take(1, 3, 0)
    q = S.push(S.stream_offsets(source, "id", ["n"]), sub, "id", lambda df: taken.extend((r.id, r._offset, r.client) for r in df.collect()), lambda: 0, str(tmp_path / "c1"))
    q.awaitTermination(120)
    assert sorted(taken) == [("a", 0, 1), ("a", 1, 1), ("b", 0, 1)]
    w = S.stream_timed_window(source, "id", "t", "2 minutes", None, "1 minute", {"n": F.count(F.lit(1))})
    q = w.writeStream.format("memory").queryName("timed").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.id, r.n) for r in spark.table("timed").collect()) == [("a", 2), ("a", 2), ("b", 1)]


def test_push_delivers_again_after_expiry(spark, tmp_path):
    from rillflow.streaming import stateful as S
    from rillflow.subscription import Subscriptions

    def put(rows):
        spark.createDataFrame(rows, "id string, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def push(sub, now):
        taken = []
        source = spark.readStream.schema("id string, n int").parquet(str(tmp_path / "in"))
        S.push(S.stream_offsets(source, "id", ["n"]), sub, "id", lambda df: taken.extend((r.id, r._offset, r.n) for r in df.collect()), lambda: now, str(tmp_path / "c")).awaitTermination(120)
        return sorted(taken)

    sub = Subscriptions(spark, str(tmp_path / "cursors"), "s", 500)
    put([("a", 0), ("a", 1), ("b", 9)])
    sub.take(1, 3, 0)
    assert push(sub, 0) == [("a", 0, 0), ("a", 1, 1), ("b", 0, 9)]
    sub.acknowledge(spark.createDataFrame([("b", 0, 0)], "key string, first bigint, last bigint"))
    assert [r.key for r in sub.expire(600).collect()] == ["a"]
    put([("c", 5)])  # the later micro-batch has no record of a
    assert push(sub, 600) == [("a", 0, 0), ("c", 0, 5)]  # two came back; the smaller backlog goes first
    put([("a", 2)])
    again = Subscriptions(spark, str(tmp_path / "cursors"))  # after a restart, what wasn't acknowledged comes again
    again.demand[1] = 9
    assert push(again, 3000) == [("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("c", 0, 5)]
