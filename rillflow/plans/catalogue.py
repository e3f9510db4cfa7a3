"""Queries over the test tables, one or more for each operator of the engine, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.engine import Engine
from rillflow.functions.keys import plain_key
from rillflow.operators import query
from rillflow.runtime import ensure_checkpoint_dir
from rillflow.sources.tables import table
from rillflow.subscription import Subscriptions
from rillflow.udf import ArrowMap, ColumnMap, Fold, PyFold

EVENT_TYPES = ("view", "click", "purchase")

CONFIG = """
[storage.memory]
type = "memory"

[schema.event]
user_id = "int64"
event_id = "int64"
event_type = "string"
cents = "int64"

[schema.tallied]
user_id = "int64"
event_id = "int64"
cents = "int64"

[schema.total]
user_id = "int64"
total = "int64"

[schema.enriched]
user_id = "int64"
event_id = "int64"
cents = "int64"
doubled = "int64"

[schema.pair]
user_id = "int64"
click_id = "int64"
click_cents = "int64"
purchase_id = "int64"
purchase_cents = "int64"

[schema.triple]
user_id = "int64"
view_id = "int64"
click_id = "int64"
purchase_id = "int64"

[schema.customer]
c_custkey = "int64"
c_name = "string"

[schema.order]
o_custkey = "int64"
o_orderkey = "int64"
o_orderstatus = "string"

[schema.customer_order]
custkey = "int64"
name = "string"
orderkey = "int64"
status = "string"

[streams.events]
schema = "event"
partition_key = "user_id"

[streams.views]
schema = "event"
partition_key = "user_id"

[streams.clicks]
schema = "event"
partition_key = "user_id"

[streams.purchases]
schema = "event"
partition_key = "user_id"

[streams.customers]
schema = "customer"
partition_key = "c_custkey"

[streams.orders]
schema = "order"
partition_key = "o_custkey"

[streams.doubled]
base = "events"
type = "map"
schema = "event"
partition_key = "user_id"
fn = "double"

[streams.doubled_arrow]
base = "events"
type = "map"
schema = "event"
partition_key = "user_id"
fn = "double_arrow"

[streams.doubled_total]
base = "doubled"
type = "reduce"
schema = "event"
partition_key = "user_id"
fn = "sum"

[streams.recent]
base = "doubled_total"
type = "window"
schema = "event"
partition_key = "user_id"
window = { type = "count", interval = "3" }

[streams.enriched]
base = "events"
type = "join"
schema = "enriched"
partition_key = "user_id"
join = ["doubled"]
map = { user_id = "events.user_id", event_id = "events.event_id", cents = "events.cents", doubled = "doubled.cents" }

[streams.pairs]
base = "clicks"
type = "join"
schema = "pair"
partition_key = "user_id"
join = ["purchases"]
map = { user_id = "clicks.user_id", click_id = "clicks.event_id", click_cents = "clicks.cents", purchase_id = "purchases.event_id", purchase_cents = "purchases.cents" }

[streams.triples]
type = "join"
schema = "triple"
partition_key = "user_id"
join = ["views", "clicks", "purchases"]
map = { user_id = "views.user_id", view_id = "views.event_id", click_id = "clicks.event_id", purchase_id = "purchases.event_id" }

[streams.customer_orders]
base = "customers"
type = "join"
schema = "customer_order"
partition_key = "custkey"
join = ["orders"]
map = { custkey = "customers.c_custkey", name = "customers.c_name", orderkey = "orders.o_orderkey", status = "orders.o_orderstatus" }
"""
STEPS = ("sum", "min", "max", "count", "last", "first")
CONFIG += "".join(f'\n[streams.reduce_{s}]\nbase = "events"\ntype = "reduce"\nschema = "event"\npartition_key = "user_id"\nfn = "{s}"\n' for s in (*STEPS, "udf_fold"))
#: name of the query: interval, slide (in offsets, or with a unit), closed end
WINDOWS = {
    "window_tumbling_5": ("5", None, False),
    "window_sliding_5_1": ("5", "1", False),
    "window_tumbling_5_closed": ("5", None, True),
    "window_sliding_6_2_closed": ("6", "2", True),
    "window_gap_2_5": ("2", "5", False),
}
CONFIG += "".join(
    f'\n[streams.{n}]\nbase = "events"\ntype = "window"\nschema = "event"\npartition_key = "user_id"\nwindow = {{ type = "count", interval = "{i}"{f", slide = {chr(34)}{s}{chr(34)}" if s else ""}{", closed_end = true" if c else ""} }}\n'
    for n, (i, s, c) in {**WINDOWS, "window_timed_1d": ("1d", None, False), "window_timed_2h_1h": ("2h", "1h", False)}.items()
)


def _double_arrow(batch):
    import pyarrow as pa
    import pyarrow.compute as pc

    return pa.RecordBatch.from_arrays([pc.multiply(batch.column(batch.schema.get_field_index("cents")), 2)], names=["cents"])


def _sum(prev: dict, curr: dict) -> dict:
    return {**curr, "cents": (prev["cents"] or 0) + (curr["cents"] or 0)}


def _functions(e: Engine) -> None:
    e.register_udf("double", ColumnMap(lambda c: {"cents": c["cents"] * 2}))
    e.register_udf("double_arrow", ArrowMap(_double_arrow))
    for s in STEPS:
        e.register_udf(s, Fold({"cents": s}))
    e.register_udf("udf_fold", PyFold(_sum))


def engine(spark: SparkSession, d: str) -> Engine:
    """The engine with the streams above over the tables of a folder."""
    e = _produced(spark)
    events = _events(spark, d)
    e.bind_source("events", events, ["ts", "event_id"])
    for kind in EVENT_TYPES:
        e.bind_source(f"{kind}s", events.where(F.col("event_type") == kind), ["ts", "event_id"])
    e.bind_source("customers", table(spark, d, "customer").withColumn("since", F.lit("1970-01-01").cast("timestamp_ntz")), ["since", "c_custkey"])
    e.bind_source("orders", table(spark, d, "orders"), ["o_orderdate", "o_orderkey"])
    return e


def entry(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).latest("doubled").select("user_id", "event_id", "cents", "_offset")


def _log(name: str):
    return lambda spark, d: engine(spark, d).stream(name).select("user_id", "event_id", "cents", "_offset")


def _window(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        w = engine(spark, d).stream(name)
        ids = F.array_join(F.transform("records", lambda r: r["event_id"].cast("string")), ",")
        return w.select("user_id", F.col("_offset").alias("window_no"), "window_start", "window_end", "first_offset", "last_offset", F.size("records").cast("bigint").alias("n"), ids.alias("ids"))

    return run


def _timed(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        w = engine(spark, d).stream(name, values={"cents": F.sum("cents")})
        return w.select("user_id", F.col("_offset").alias("window_no"), F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "cents")

    return run


def _timed_records(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).window_records("window_timed_2h_1h").select("user_id", "event_id", "_offset", "_window")


_JSON_NUMBERS = ("data", "i", "level_mm", "position", "seq")


def _source_json(spark: SparkSession, d: str) -> DataFrame:
    """The whole log of JSON records, produced as one stream, keyed by the stream each came from and its key."""
    names = [*(f"{c} = \"string\"" for c in ("place", "id", "meter_no", "device_id", "other_data", "some_data", "stream_name")), *(f"{c} = \"int64\"" for c in _JSON_NUMBERS)]
    e = Engine(spark)
    e.apply_config("[schema.posted]\n" + "\n".join(names) + '\n[streams.posted]\nschema = "posted"\npartition_key = "place"\n')
    rows = table(spark, d, "produced_record").where("partition_id is not null").withColumn("place", F.concat_ws("/", "stream_name", plain_key("partition_id")))
    e.produce_json("posted", rows, "data", ["arrived_at"], "arrived_at")
    texts = [F.count(c).alias(f"n_{c}") for c in ("other_data", "some_data")]
    return e.stream("posted").groupBy("stream_name", F.coalesce("id", "meter_no", "device_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), *texts, *[F.sum(c).alias(f"total_{c}") for c in _JSON_NUMBERS])


#: Ends of the batches in which events are produced.
BATCHES = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")


def _batches(rows: DataFrame) -> list[DataFrame]:
    edges = [F.lit(b).cast("timestamp_ntz") for b in BATCHES]
    return [rows.where(F.col("ts") < edges[0]), rows.where((F.col("ts") >= edges[0]) & (F.col("ts") < edges[1])), rows.where(F.col("ts") >= edges[1])]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))


def _produced(spark: SparkSession) -> Engine:
    e = Engine(spark)
    _functions(e)
    e.apply_config(CONFIG)
    return e


def _produce_append(spark: SparkSession, d: str) -> DataFrame:
    e = _produced(spark)
    for batch in _batches(_events(spark, d)):
        e.produce("events", batch, ["ts", "event_id"])
    return _sel(e.stream("reduce_sum"))


def _produce_json_log(spark: SparkSession, d: str) -> DataFrame:
    e = _produced(spark)
    for batch in _batches(_events(spark, d)):
        e.produce_json("events", batch.select("ts", "event_id", F.to_json(F.struct("user_id", "event_id", "event_type", "cents")).alias("body")), "body", ["ts", "event_id"], "ts")
    return _sel(e.latest("doubled"))


def _join_by_arrival(spark: SparkSession, d: str) -> DataFrame:
    """Purchases are produced before clicks: arrival, not the time of the events, is the order of a join."""
    e = _produced(spark)
    rows = _events(spark, d)
    for kind in ("purchase", "click"):
        e.produce(f"{kind}s", rows.where(F.col("event_type") == kind), ["ts", "event_id"], "ts")
    return e.stream("pairs").drop("_timestamp")


def _stored_latest(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    e.write("doubled_total")
    return _sel(e.latest("doubled_total"))


def _stored_at(spark: SparkSession, d: str) -> DataFrame:
    e = _produced(spark)
    e.produce("events", _events(spark, d), ["ts", "event_id"], "ts")
    return _sel(e.at("events", 7, 3))


def _take_first(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    sub = e.subscribe("events")
    return _sel(e.deliver(sub, sub.take(1, 500, 0)))


def _redelivered(spark: SparkSession, d: str) -> DataFrame:
    """300 records are taken, the first half of each key's is acknowledged, the rest comes back after the timeout."""
    e = engine(spark, d)
    sub = e.subscribe("events", 500)
    taken = sub.take(1, 300, 0).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sub.acknowledge(taken.select("key", F.lit(0).cast("bigint").alias("first"), F.expr("n div 2 - 1").alias("last")))
    sub.expire(500)
    return _sel(e.deliver(sub, sub.deliver(1, 501)))


def _rekeyed_log(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "produced_record").where("partition_id is not null and record_offset is not null")
    newest = rows.groupBy("stream_name", plain_key("partition_id").alias("partition_id"), "record_offset").agg(F.max("write_no").alias("write_no"))
    return query.latest(newest.withColumn("_offset", F.col("record_offset")).withColumn("k", F.concat_ws("/", "stream_name", "partition_id")), "k").select("stream_name", "partition_id", "record_offset", "write_no")


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 7).alias("_offset"))
    return engine(spark, d).lookup("events", wanted).select("user_id", "event_id", "cents", "_offset")


def _committed(spark: SparkSession, d: str) -> DataFrame:
    """All stored subscriptions as one table of cursors: their logs' ends, then every acknowledged range that lies in its log."""
    key = F.to_json(F.struct("subscription_id", "stream_name", plain_key("offset_key").alias("offset_key")))
    sub = Subscriptions(spark, f"{ensure_checkpoint_dir(spark)}/cursors-{uuid.uuid4().hex}")
    known = table(spark, d, "partition_offsets").withColumnRenamed("partition_id", "offset_key")
    sub.produced(known.select(key.alias("key"), F.col("range_end").alias("end")))
    sub.acknowledge(table(spark, d, "ack_range").select(key.alias("key"), F.col("range_start").alias("first"), F.col("range_end").alias("last")))
    return sub.state().select(F.from_json("key", "subscription_id string, stream_name string, offset_key string").alias("k"), "committed", "backlog").select("k.*", "committed", "backlog")


def _sel(df: DataFrame) -> DataFrame:
    return df.select("user_id", "event_id", "cents", "_offset")


MIDDLE = "2024-01-15 00:00:00"
QUERIES = {
    "offsets": _log("events"),
    "produce_append": _produce_append,
    "produce_json_log": _produce_json_log,
    "join_by_arrival": _join_by_arrival,
    "stored_latest": _stored_latest,
    "stored_at": _stored_at,
    "source_json": _source_json,
    "source_log_latest": _rekeyed_log,
    "map_double": _log("doubled"),
    "map_arrow_udf": _log("doubled_arrow"),
    **{f"reduce_{s}": _log(f"reduce_{s}") for s in (*STEPS, "udf_fold")},
    "join_two": lambda s, d: engine(s, d).stream("pairs").drop("_timestamp"),
    "join_three_way": lambda s, d: engine(s, d).stream("triples").drop("_timestamp"),
    "join_customer_orders": lambda s, d: engine(s, d).stream("customer_orders").drop("_timestamp"),
    "join_lineage": lambda s, d: engine(s, d).log("pairs", lineage=True).select("user_id", "_offset", "_src_offset_clicks", "_src_offset_purchases"),
    **{n: _window(n) for n in WINDOWS},
    "window_timed_1d": _timed("window_timed_1d"),
    "window_timed_2h_1h": _timed("window_timed_2h_1h"),
    "window_timed_records": _timed_records,
    "window_timed_latest": lambda s, d: engine(s, d).latest("window_timed_1d").select("user_id", F.col("_offset").alias("window_no"), "event_id", "cents", "n", "last_offset"),
    "query_latest": lambda s, d: _sel(engine(s, d).latest("events")),
    "query_latest_one": lambda s, d: _sel(engine(s, d).latest("events", 7)),
    "query_at_3": lambda s, d: _sel(query.between(engine(s, d).stream("events"), 3, 3)),
    "query_at_one": lambda s, d: _sel(engine(s, d).at("events", 7, 3)),
    "query_range": lambda s, d: _sel(query.between(engine(s, d).stream("events"), 2, 6)),
    "query_by_timestamp": lambda s, d: _sel(engine(s, d).at_timestamp("events", MIDDLE)),
    "query_lookup_many": _lookup,
    "pipeline_double_total": _log("doubled_total"),
    "pipeline_recent": lambda s, d: engine(s, d).stream("recent").select("user_id", F.col("_offset").alias("window_no"), F.size("records").cast("bigint").alias("n"), "cents"),
    "pipeline_enriched": lambda s, d: engine(s, d).stream("enriched").drop("_timestamp"),
    "take_first_n": _take_first,
    "take_redelivered": _redelivered,
    "subscription_backlog": _committed,
}

_LOG = "log as (select user_id, event_id, event_type, ts, cast(round(value * 100) as bigint) as c, row_number() over (partition by user_id order by ts, event_id) - 1 as o from events)"
_COLS = "user_id, event_id, {c} as cents, o as _offset from log"


def _reduce_sql(f: str) -> str:
    return f"with {_LOG} select " + _COLS.format(c=f"cast({f} over (partition by user_id order by o rows between unbounded preceding and current row) as bigint)")


def _window_sql(size: int, slide: int, closed: bool) -> str:
    span = size + 1 if closed else size
    return f"""with {_LOG}, m as (select max(o) as top from log), w as (select w from (select unnest(range(0, (select top from m) // {slide} + 1)) as w))
select user_id, w as window_no, w * {slide} as window_start, w * {slide} + {span} as window_end, min(o) as first_offset, max(o) as last_offset, count(*) as n, string_agg(event_id::varchar, ',' order by o) as ids
from log join w on o >= w * {slide} and o < w * {slide} + {span} group by user_id, w"""


def _side(kind: str, place: int) -> str:
    return f"select user_id, ts, {place} as i, row_number() over (partition by user_id order by ts, event_id) - 1 as f, event_id, cast(round(value * 100) as bigint) as c from events where event_type = '{kind}'"


def _join_sql(kinds: tuple[str, ...], columns: str, order: str = "ts, i, f") -> str:
    union = " union all ".join(_side(k, i) for i, k in enumerate(kinds))
    seen = ", ".join(f"last_value(case when i = {i} then {c} end ignore nulls) over w as {k}_{n}" for i, k in enumerate(kinds) for n, c in (("id", "event_id"), ("cents", "c"), ("off", "f")))
    return f"with u as ({union}), j as (select user_id, row_number() over w - 1 as _offset, {seen} from u window w as (partition by user_id order by {order} rows between unbounded preceding and current row)) select user_id, _offset, {columns} from j"


ORACLE = {
    "offsets": f"with {_LOG} select " + _COLS.format(c="c"),
    "produce_append": _reduce_sql("sum(c)"),
    "produce_json_log": f"with {_LOG} select " + _COLS.format(c="c * 2") + " qualify o = max(o) over (partition by user_id)",
    "join_by_arrival": _join_sql(("purchase", "click"), "click_id, click_cents, purchase_id, purchase_cents", "i, f"),
    "stored_latest": f"with {_LOG}, t as (select *, sum(2 * c) over (partition by user_id order by o rows between unbounded preceding and current row) as s, max(o) over (partition by user_id) as top from log) select user_id, event_id, cast(s as bigint) as cents, o as _offset from t where o = top",
    "stored_at": f"with {_LOG} select " + _COLS.format(c="c") + " where o = 3 and user_id = 7",
    "source_json": "select stream_name, coalesce(data ->> '$.id', data ->> '$.meter_no', data ->> '$.device_id') as id, count(*) as n, count(data ->> '$.other_data') as n_other_data, count(data ->> '$.some_data') as n_some_data, "
    + ", ".join(f"cast(sum(cast(data ->> '$.{c}' as bigint)) as bigint) as total_{c}" for c in _JSON_NUMBERS)
    + " from produced_record where partition_id is not null group by 1, 2",
    "source_log_latest": "select stream_name, k as partition_id, record_offset, write_no from (select stream_name, rtrim(partition_id, chr(0)) as k, record_offset, max(write_no) as write_no, row_number() over (partition by stream_name, rtrim(partition_id, chr(0)) order by record_offset desc) as n from produced_record where partition_id is not null and record_offset is not null group by 1, 2, 3) where n = 1",
    "map_double": f"with {_LOG} select " + _COLS.format(c="c * 2"),
    "map_arrow_udf": f"with {_LOG} select " + _COLS.format(c="c * 2"),
    "reduce_sum": _reduce_sql("sum(c)"),
    "reduce_udf_fold": _reduce_sql("sum(c)"),
    "reduce_min": _reduce_sql("min(c)"),
    "reduce_max": _reduce_sql("max(c)"),
    "reduce_count": _reduce_sql("count(*)"),
    "reduce_last": _reduce_sql("last_value(c)"),
    "reduce_first": _reduce_sql("first_value(c)"),
    "join_two": _join_sql(("click", "purchase"), "click_id, click_cents, purchase_id, purchase_cents"),
    "join_three_way": _join_sql(("view", "click", "purchase"), "view_id, click_id, purchase_id"),
    "join_lineage": _join_sql(("click", "purchase"), "click_off as _src_offset_clicks, purchase_off as _src_offset_purchases"),
    "join_customer_orders": """
with u as (select c_custkey as k, 0 as i, null as ts, c_name, null as o, null as s from customer union all select o_custkey, 1, o_orderdate, null, o_orderkey, o_orderstatus from orders)
select k as custkey, row_number() over w - 1 as _offset, last_value(c_name ignore nulls) over w as name, last_value(o ignore nulls) over w as orderkey, last_value(s ignore nulls) over w as status
from u window w as (partition by k order by i, ts, o rows between unbounded preceding and current row)""",
    **{n: _window_sql(int(i), int(s or i), c) for n, (i, s, c) in WINDOWS.items()},
    "window_timed_1d": "select user_id, epoch_us(date_trunc('day', ts)::timestamp) // 86400000000 as window_no, date_trunc('day', ts)::timestamp as window_start, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from events group by 1, 2, 3",
    "window_timed_2h_1h": "select user_id, epoch_us(date_trunc('hour', ts)::timestamp) // 3600000000 - h as window_no, (date_trunc('hour', ts) - to_hours(h))::timestamp as window_start, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from events, (values (0), (1)) t(h) group by 1, 2, 3",
    "window_timed_records": f"with {_LOG} select user_id, event_id, o as _offset, epoch_us(date_trunc('hour', ts)::timestamp) // 3600000000 - h as _window from log, (values (0), (1)) t(h)",
    "window_timed_latest": f"with {_LOG}, w as (select *, epoch_us(date_trunc('day', ts)::timestamp) // 86400000000 as w from log), t as (select *, max(w) over (partition by user_id) as top from w) select user_id, w as window_no, arg_max(event_id, o) as event_id, arg_max(c, o) as cents, count(*) as n, max(o) as last_offset from t where w = top group by 1, 2",
    "query_latest": f"with {_LOG} select " + _COLS.format(c="c") + " qualify o = max(o) over (partition by user_id)",
    "query_latest_one": f"with {_LOG} select " + _COLS.format(c="c") + " where user_id = 7 qualify o = max(o) over (partition by user_id)",
    "query_at_3": f"with {_LOG} select " + _COLS.format(c="c") + " where o = 3",
    "query_at_one": f"with {_LOG} select " + _COLS.format(c="c") + " where o = 3 and user_id = 7",
    "query_range": f"with {_LOG} select " + _COLS.format(c="c") + " where o between 2 and 6",
    "query_by_timestamp": f"with {_LOG} select " + _COLS.format(c="c") + f" where ts >= timestamp '{MIDDLE}' qualify o = min(o) over (partition by user_id)",
    "query_lookup_many": f"with {_LOG} select " + _COLS.format(c="c") + " where (user_id, o) in (select c_custkey, c_custkey % 7 from customer)",
    "pipeline_double_total": _reduce_sql("sum(2 * c)"),
    "pipeline_recent": f"with {_LOG}, t as (select user_id, o, sum(2 * c) over (partition by user_id order by o rows between unbounded preceding and current row) as s from log) select user_id, o // 3 as window_no, count(*) as n, cast(arg_max(s, o) as bigint) as cents from t group by 1, 2",
    "pipeline_enriched": f"""with {_LOG}, u as (select user_id, o, i from log, (values (0), (1)) t(i)),
j as (select user_id, o, i, row_number() over (partition by user_id order by (select ts from log l where l.user_id = u.user_id and l.o = u.o), i, o) - 1 as _offset from u)
select j.user_id, j._offset, l.event_id, l.c as cents, case when j.i = 1 then l.c * 2 else p.c * 2 end as doubled from j join log l on l.user_id = j.user_id and l.o = j.o left join log p on p.user_id = j.user_id and p.o = j.o - 1""",
    "take_first_n": f"with {_LOG}, b as (select *, count(*) over (partition by user_id) as n from log) select user_id, event_id, c as cents, o as _offset from b order by n, user_id::varchar, o limit 500",
    "take_redelivered": f"""with {_LOG}, b as (select user_id, count(*) as n from log group by 1),
t as (select *, greatest(0, least(n, 300 - coalesce(sum(n) over (order by n, user_id::varchar rows between unbounded preceding and 1 preceding), 0))) as t from b),
a as (select *, t // 2 as a, sum(t - t // 2) over () as demand from t),
g as (select *, greatest(0, least(n - a, demand - coalesce(sum(n - a) over (order by n - a, user_id::varchar rows between unbounded preceding and 1 preceding), 0))) as give from a)
select user_id, event_id, c as cents, o as _offset from log join g using (user_id) where o >= a and o < a + give""",
    "subscription_backlog": """
with k as (select subscription_id, stream_name, rtrim(partition_id, chr(0)) as offset_key, max(range_end) as e from partition_offsets group by 1, 2, 3 having max(range_end) is not null),
r as (select distinct k.*, range_start as a, range_end as b from ack_range c join k on c.subscription_id = k.subscription_id and c.stream_name = k.stream_name and rtrim(c.offset_key, chr(0)) = k.offset_key where range_start between 0 and range_end and range_end <= e),
m as (select *, max(b) over (partition by subscription_id, stream_name, offset_key order by a, b rows between unbounded preceding and 1 preceding) as top from r),
n as (select *, sum(case when top is null or a > top + 1 then 1 else 0 end) over (partition by subscription_id, stream_name, offset_key order by a, b) as island from m),
p as (select subscription_id, stream_name, offset_key, max(b) + 1 as committed from n group by 1, 2, 3, island having min(a) = 0)
select k.subscription_id, k.stream_name, k.offset_key, coalesce(committed, 0) as committed, greatest(e + 1 - coalesce(committed, 0), 0) as backlog from k left join p using (subscription_id, stream_name, offset_key)""",
}
