"""Type tags, configurations, catalogue, window arithmetic and subscriptions: no Spark job."""

import pytest
from pyspark.sql import types as T

from rillflow import config
from rillflow.catalog import Topography
from rillflow.config import parse_interval
from rillflow.errors import ConfigurationError, CycleError, JoinError, OccupiedError, SchemaNotFound, StreamNotFound, SubscriptionError, TypeTagError, WindowError
from rillflow.operators.window import assign
from rillflow.subscription import Subscription
from rillflow.types import parse_tag, struct_type


@pytest.mark.parametrize(
    "tag, kind",
    [("string", T.StringType()), ("large_string", T.StringType()), ("bytes", T.BinaryType()), ("large_bytes", T.BinaryType()), ("fixed_bytes[5]", T.BinaryType()), ("int8", T.ByteType()), ("int16", T.ShortType()), ("int32", T.IntegerType()), ("int64", T.LongType()),
     ("uint8", T.ShortType()), ("uint16", T.IntegerType()), ("uint32", T.LongType()), ("uint64", T.DecimalType(20, 0)), ("float16", T.FloatType()), ("float32", T.FloatType()), ("float64", T.DoubleType()), ("bool", T.BooleanType()), ("date32", T.DateType()),
     ("date64", T.TimestampNTZType()), ("decimal[5,2]", T.DecimalType(5, 2)), ("decimal[38, 6, 256]", T.DecimalType(38, 6)), ("time[ns]", T.LongType()), ("timestamp[us]", T.TimestampNTZType()), ("timestamp[ms, Europe/Paris]", T.TimestampType())],
)
def test_tags(tag, kind):
    assert parse_tag(tag) == kind


@pytest.mark.parametrize("tag", ["int32foo", "decimal", "decimal[1,3]", "decimal[39,2]", "time[h]", "list[string]", ""])
def test_bad_tags(tag):
    with pytest.raises(TypeTagError):
        parse_tag(tag)


def test_schema_is_alphabetical_and_nullable():
    s = struct_type({"id": "string", "age": "int32", "at": "timestamp[us, UTC]"})
    assert s.names == ["age", "at", "id"] and all(f.nullable for f in s) and s["at"].metadata["zone"] == "UTC"


BASE = """
[schema.value]
id = "string"
data = "int32"
[streams.value]
schema = "value"
partition_key = "id"
"""


def test_multi_line_tables_and_round_trip():
    text = BASE + """
[streams.windowed]
base = "value"
type = "window"
schema = "value"
partition_key = "id"
window = {
    type = "count", # or timed
    interval = "5", slide = "2",
}
[storage.memory]
type = "memory"
"""
    c = config.parse(text)
    assert c.streams["windowed"].window.sizes() == (5, 2)
    again = config.parse(config.dump(c))
    assert again == c


@pytest.mark.parametrize(
    "extra, error",
    [('type = "map"\nbase = "value"', ConfigurationError), ('type = "aggregate"\nbase = "value"', ConfigurationError), ('type = "odd"\nbase = "value"', ConfigurationError), ('type = "map"\nbase = "gone"\nfn = "f"', StreamNotFound),
     ('type = "join"\nbase = "value"', JoinError), ('type = "join"\njoin = ["value"]', JoinError), ('type = "join"\njoin = ["value"]\nmap = { id = "value.id" }', JoinError), ('type = "join"\njoin = ["value"]\nmap = { id = "value.id", data = "value.gone" }', JoinError),
     ('type = "window"\nbase = "value"', WindowError), ('type = "window"\nbase = "value"\nwindow = { type = "count", interval = "x" }', WindowError), ('type = "window"\nbase = "value"\nwindow = { type = "count", interval = "5", slide = "1h" }', WindowError), ('base = "value"', ConfigurationError),
     ('type = "map"\nbase = "d"\nfn = "f"', CycleError)],
)
def test_refused_streams(extra, error):
    with pytest.raises(error):
        Topography().apply(BASE + f'\n[streams.d]\nschema = "value"\npartition_key = "id"\n{extra}\n')


def test_other_refusals():
    with pytest.raises(SchemaNotFound):
        Topography().apply('[streams.a]\nschema = "no"\npartition_key = "id"\n')
    with pytest.raises(ConfigurationError):
        config.parse("[schema.a]\n_offset = 'int64'\n")
    with pytest.raises(ConfigurationError):
        config.parse("no toml at all [")
    with pytest.raises(ConfigurationError):
        config.parse("[storage.x]\ntype = 'tape'\n")


def test_merge_is_idempotent_and_kept(tmp_path):
    t = Topography(tmp_path / "t.jsonl")
    assert t.apply(BASE) == ["value"] and t.apply(BASE) == []
    with pytest.raises(OccupiedError):
        t.apply(BASE.replace("int32", "int64"))
    t.apply('[streams.d]\nschema = "value"\npartition_key = "id"\nbase = "value"\ntype = "map"\nfn = "f"\n')
    again = Topography(tmp_path / "t.jsonl")
    assert again.config == t.config and again.order() == ["value", "d"]
    with pytest.raises(ConfigurationError):
        again.drop_stream("value")
    again.drop_stream("d")
    assert again.children("value") == [] and Topography(tmp_path / "t.jsonl").config == again.config  # a drop is kept


def test_storage_settings():
    c = config.parse('[storage.s3]\ntype = "s3"\naws_access_key_id = "a"\naws_secret_access_key = "b"\naws_endpoint = "http://x"\naws_allow_http = true\nbucket_name = "n"\n')
    s = c.storage["s3"]
    assert s.path() == "s3a://n" and s.spark_conf() == {"fs.s3a.access.key": "a", "fs.s3a.secret.key": "b", "fs.s3a.endpoint": "http://x", "fs.s3a.connection.ssl.enabled": "false"}


@pytest.mark.parametrize("text, us, timed", [("30s", 30_000_000, True), ("500ms", 500_000, True), ("200us", 200, True), ("5m", 300_000_000, True), ("2h", 7_200_000_000, True), ("7d", 604_800_000_000, True), ("100", 100, False)])
def test_intervals(text, us, timed):
    assert parse_interval(text) == (us, timed)


def test_window_assignment():
    assert assign(6, 5, 1, closed_end=True) == [(6, 11), (5, 10), (4, 9), (3, 8), (2, 7), (1, 6)]
    assert assign(6, 5, 1) == [(6, 11), (5, 10), (4, 9), (3, 8), (2, 7)]
    assert assign(5, 5, 5, closed_end=True) == [(5, 10), (0, 5)] and assign(5, 5, 5) == [(5, 10)]
    assert assign(3, 2, 5) == [] and assign(6, 2, 5) == [(5, 7)]


def sub(**ends):
    s = Subscription("s", 700)
    for k, e in ends.items():
        s.produced(k, e)
    return s


def test_take_in_order_of_backlog():
    s = sub(big=10, small=1)
    assert s.take(1, 5, 0) == [("small", 0), ("small", 1), ("big", 0), ("big", 1), ("big", 2)]
    assert sub(partition1=10).take(1, 5, 0) == [("partition1", i) for i in range(5)]


def test_acknowledge():
    s = sub(a=10)
    s.acknowledge("a", 0, 1)
    s.acknowledge("a", 1, 2)
    assert s.take(1, 2, 0) == [("a", 3), ("a", 4)]
    with pytest.raises(SubscriptionError):
        s.acknowledge("a", 5, 5)
    with pytest.raises(SubscriptionError):
        s.acknowledge("b", 0, 0)
    assert s.cursors["a"].committed == 3 and len(s.acknowledge_all([("a", 3, 3), ("a", 9, 9), ("x", 0, 0)])) == 2
    with pytest.raises(SubscriptionError):
        s.acknowledge("a", 4, 99)


def test_ranges():
    s = sub(a=0)
    assert s.ranges() == [("a", 0, 0)]
    s.acknowledge("a", 0, 0)
    assert s.ranges() == []
    s.produced("a", 3)
    assert s.ranges() == [("a", 1, 3)]


def test_redelivery_and_demand():
    s = sub(a=0)
    assert s.take(1, 1, 0) == [("a", 0)] and s.demand[1] == 0
    assert s.expire(699) == [] and s.expire(700) == ["a"] and s.demand[1] == 1
    assert s.deliver(1, 700) == [("a", 0)]
    s.acknowledge("a", 0, 0)
    assert s.expire(5000) == [] and s.deliver(1, 5000) == []


def test_two_clients_one_record():
    s = Subscription("s")
    assert s.take(1, 1, 0) == [] and s.take(2, 1, 0) == []
    s.produced("a", 0)
    assert s.deliver(1, 0) == [("a", 0)] and s.deliver(2, 0) == []
    assert s.state()["demand"] == {1: 0, 2: 1} and s.state()["keys"]["a"] == (1, 0)


def test_reload_starts_at_what_is_acknowledged(tmp_path):
    s = Subscription("s", 500, tmp_path / "c.json")
    s.produced("a", 5)
    s.take(1, 3, 0)
    s.acknowledge("a", 0, 0)
    s.save()
    again = Subscription("other", 1, tmp_path / "c.json")
    assert again.id == s.id and again.take(1, 9, 0) == [("a", i) for i in range(1, 6)]
