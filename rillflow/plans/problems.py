"""The pN_ queries of the general problems, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.keys import person_id, plain_key
from rillflow.operators import dedup, incremental, intervals, references, skew
from rillflow.runtime import cut_lineage, ensure_checkpoint_dir
from rillflow.sources.tables import table


def _shared(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The batch that the next run of each subscription writes and commits."""
    manifest = incremental.RecordManifest(spark, _shared(spark, "runs"))
    batch = manifest.run(*incremental.offset_listing(*(table(spark, d, t) for t in ("produced_record", "partition_offsets", "key_offset"))))
    return manifest.read(batch).select(*incremental.RECORD)


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over one manifest: of the records that had arrived by a day, then of all; the second leaves out what the first has done."""
    records, *rest = (table(spark, d, t) for t in ("produced_record", "partition_offsets", "key_offset"))
    manifest = incremental.RecordManifest(spark, _shared(spark, "runs"))
    early = records.where(F.col("arrived_at") <= F.lit("2018-06-01").cast("timestamp_ntz"))
    batches = [manifest.run(*incremental.offset_listing(r, *rest)) for r in (early, records)]
    if manifest.run(*incremental.offset_listing(records, *rest)) is not None:
        raise RuntimeError("a run without a change found records to process")
    first, second = (manifest.read(b).select(*incremental.RECORD, F.lit(i + 1).alias("run")) for i, b in enumerate(batches))
    return first.unionByName(second)


def p1_file_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "produced_record")
    root = _shared(spark, "files")
    try:
        done = incremental.file_runs(rows, "arrived_at", root)
        found = rows.limit(0).withColumn("run", F.lit(0).cast("bigint")) if done is None else done
        return cut_lineage(found.groupBy("stream_name", "run").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("record_offset").cast("bigint").alias("sum_offset"), F.sum(F.length("data")).alias("n_chars")))
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_KEY = ["stream_name", "partition_id"]


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "produced_record").select("stream_name", plain_key("partition_id").alias("partition_id"), "record_offset", "arrived_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(_keyed(spark, d), _KEY, 0.02).select(*_KEY)


def p2_key_statistics(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_statistics(_keyed(spark, d), _KEY, "record_offset", "arrived_at")


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = table(spark, d, "customer_address").select(person_id("customer_id").alias("key"), F.col("arrived_at").alias("at"), "stream_name", "row_id")
    changes = table(spark, d, "update_customer_event").select(person_id("id").alias("key"), F.col("arrived_at").alias("at"), F.col("event_id").alias("ordinal"), F.when(F.col("is_deleted"), 0).otherwise(1).alias("alive"))
    return refs, changes


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = references.orphans(*_references(spark, d))
    return found.select("stream_name", F.date_format("at", "yyyy-MM").alias("period"), "row_id", "reason").distinct()


def p3_deltas(spark: SparkSession, d: str) -> DataFrame:
    """The same in two runs over what is kept per key: what arrived before a day, then the rest."""
    refs, changes = _references(spark, d)
    counts = references.ReferenceCounts(spark, _shared(spark, "references"))
    early = F.coalesce(F.col("at") < F.lit("2018-03-01").cast("timestamp_ntz"), F.lit(True))
    for token, part in (("first", early), ("second", ~early)):
        counts.run(refs.where(part), changes.where(part), token)
    return counts.orphans().select("stream_name", F.date_format("at", "yyyy-MM").alias("period"), "row_id", "reason").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    found = references.orphans(*_references(spark, d)).withColumn("period", F.date_format("at", "yyyy-MM"))
    return found.select("stream_name", "period", "row_id", "reason").distinct().groupBy("stream_name", "period", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def p3_current(spark: SparkSession, d: str) -> DataFrame:
    refs, changes = _references(spark, d)
    return references.current_orphans(refs.distinct(), changes, ["stream_name"]).withColumnRenamed("key", "customer_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ack_range").withColumn("offset_key", plain_key("offset_key"))
    return intervals.periods_and_gaps(rows, ["subscription_id", "stream_name", "offset_key"], "range_start", "range_end")


def _deliveries(spark: SparkSession, d: str) -> tuple:
    rows = table(spark, d, "taken_record")
    return rows, [F.col("subscription_id"), F.col("stream_name"), plain_key("partition_id"), F.col("record_offset")], "delivery_id", "delivered_at"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.surplus(*_deliveries(spark, d))


def p5_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same in three batches, by the time of delivery, against what earlier ones have stored."""
    rows, *rest = _deliveries(spark, d)
    store = dedup.DeliveryStore(spark, _shared(spark, "deliveries"))
    at = [F.lit(t).cast("timestamp_ntz") for t in ("2018-02-01 00:00:00", "2018-05-01 00:00:00")]
    t = F.col("delivered_at")
    found = [store.add(rows.where(part), *rest, f"part{i}") for i, part in enumerate((t >= at[1], t.isNull() | (t < at[0]), (t >= at[0]) & (t < at[1])))]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exactly_once(*_deliveries(spark, d)).groupBy("subscription_id", "stream_name").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("delivery_id").cast("bigint").alias("sum_id"))


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p1_file_runs, p2_found, p2_key_statistics, p3_found, p3_deltas, p3_report, p3_current, p4_found, p5_found, p5_batches, p5_kept)}

_ASOF = """
e as (select distinct lower(trim(id, ' ' || chr(9) || chr(10) || chr(13))) as k, event_id, coalesce(is_deleted, false) as gone, arrived_at from update_customer_event where trim(id) <> ''),
a as (select distinct stream_name, row_id, arrived_at, lower(trim(customer_id, ' ' || chr(9) || chr(10) || chr(13))) as k from customer_address where trim(customer_id) <> '' and arrived_at is not null),
j as (select a.stream_name, a.row_id, a.arrived_at, a.k, count(e.k) as ever, count(e.k) filter (where e.arrived_at <= a.arrived_at) as seen,
             arg_max(e.gone, (e.arrived_at, e.event_id)) filter (where e.arrived_at <= a.arrived_at) as gone
      from a left join e on e.k = a.k group by all),
o as (select stream_name, strftime(arrived_at, '%Y-%m') as period, row_id, case when ever = 0 then 'missing' when seen = 0 then 'late' else 'deleted' end as reason from j where ever = 0 or seen = 0 or gone)
"""


def _listed(n: str, where: str) -> str:
    """Listed and held content of each record in question (`l`), with `n` behind the names."""
    return f"""r{n} as (select distinct stream_name, rtrim(partition_id, chr(0)) as k, record_offset as o, coalesce(write_no, 0) as w, arrived_at,
             list_sort(list_transform(json_keys(data), lambda f: f || ':' || json_extract(data, '$."' || f || '"')::varchar))::varchar as content
      from produced_record where stream_name is not null and partition_id is not null and record_offset is not null {where}),
v{n} as (select stream_name, k, o, w, max(content) as content, min(arrived_at) as arrived_at from r{n} group by all),
s{n} as (select subscription_id, stream_name, rtrim(partition_id, chr(0)) as k, coalesce(min(first_offset), 0) as first, max(range_end) as end_a, max(committed) as committed, max(committed_at) as committed_at from partition_offsets group by 1, 2, 3),
u{n} as (select subscription_id, stream_name, rtrim(offset_key, chr(0)) as k, max(max_offset) as end_b,
             max(last_completed_offset) filter (where ok) as completed, max(finished_at) filter (where ok) as finished_at
      from (select *, coalesce(lower(replace(run_state, ' ', '')) = 'done' and last_completed_offset is not null, false) as ok from key_offset) group by 1, 2, 3),
b{n} as (select s{n}.subscription_id, s{n}.stream_name, s{n}.k, first, greatest(end_a, end_b) as last, greatest(committed - 1, completed) as mark, greatest(committed_at, finished_at) as success from s{n} left join u{n} using (subscription_id, stream_name, k)),
l{n} as (select b.subscription_id, b.stream_name, b.k, v.o, arg_max(v.content, v.w) as listed, arg_max(v.content, v.w) filter (where v.o <= b.mark and v.arrived_at <= b.success) as held
      from b{n} b join v{n} v on v.stream_name = b.stream_name and v.k = b.k and v.o between b.first and b.last group by 1, 2, 3, 4)"""


ORACLE = {
    "p1_found": f"with {_listed('', '')} select subscription_id, stream_name, k as partition_id, o as record_offset from l where listed is distinct from held",
    "p1_runs": f"""with {_listed("a", "and arrived_at <= timestamp '2018-06-01'")}, {_listed("", "")}, f as (select * from la where listed is distinct from held)
select subscription_id, stream_name, k as partition_id, o as record_offset, 1 as run from f
union all select l.subscription_id, l.stream_name, l.k, l.o, 2 from l left join f using (subscription_id, stream_name, k, o) where l.listed is distinct from (case when f.o is null then l.held else f.listed end)""",
    "p1_file_runs": """
with r as (select stream_name, record_offset, data, epoch_us(arrived_at) as us from produced_record),
c as (select min(us) + (max(us) - min(us)) // 2 as cut from r),
n as (select min(us) as us from r, c where r.us > c.cut)
select stream_name, case when r.us // 86400000000 >= n.us // 86400000000 then 2 else 1 end as run, count(*) as n_rows, cast(sum(record_offset) as bigint) as sum_offset, cast(sum(length(data)) as bigint) as n_chars
from r, n group by 1, 2""",
    "p2_found": """
select stream_name, rtrim(partition_id, chr(0)) as partition_id from produced_record where stream_name is not null and partition_id is not null
group by 1, 2 having count(*) >= 0.02 * (select count(*) from produced_record)""",
    "p2_key_statistics": """
select stream_name, rtrim(partition_id, chr(0)) as partition_id, count(*) as n_rows, count(distinct record_offset) as n_records, min(arrived_at) as first_arrival, max(arrived_at) as last_arrival
from produced_record where stream_name is not null and partition_id is not null group by 1, 2""",
    "p3_found": f"with {_ASOF} select distinct stream_name, period, row_id, reason from o",
    "p3_deltas": f"with {_ASOF} select distinct stream_name, period, row_id, reason from o",
    "p3_report": f"with {_ASOF} select stream_name, period, reason, count(*) as n_rows from (select distinct * from o) group by 1, 2, 3",
    "p3_current": f"""
with {_ASOF}, st as (select k, arg_max(gone, (arrived_at, event_id)) as gone from e where arrived_at is not null group by 1)
select stream_name, a.k as customer_id, count(*) as n_refs from (select distinct stream_name, row_id, arrived_at, lower(trim(customer_id, ' ' || chr(9) || chr(10) || chr(13))) as k from customer_address where trim(customer_id) <> '') a
left join st using (k) where coalesce(st.gone, true) group by 1, 2""",
    "p4_found": """
with r as (select distinct subscription_id, stream_name, rtrim(offset_key, chr(0)) as offset_key, range_start as a, range_end as b from ack_range where range_start <= range_end),
m as (select *, max(b) over (partition by subscription_id, stream_name, offset_key order by a, b rows between unbounded preceding and 1 preceding) as top from r),
n as (select *, sum(case when top is null or a > top + 1 then 1 else 0 end) over (partition by subscription_id, stream_name, offset_key order by a, b) as island from m),
p as (select subscription_id, stream_name, offset_key, island, min(a) as a, max(b) as b from n group by 1, 2, 3, 4),
g as (select subscription_id, stream_name, offset_key, b + 1 as a, lead(a) over (partition by subscription_id, stream_name, offset_key order by a) - 1 as b from p)
select subscription_id, stream_name, offset_key, 'period' as span_kind, a as span_start, b as span_end from p
union all select subscription_id, stream_name, offset_key, 'gap', a, b from g where b is not null""",
    "p5_found": """
select distinct delivery_id from (select delivery_id, row_number() over (partition by subscription_id, stream_name, rtrim(partition_id, chr(0)), record_offset order by delivered_at nulls last, delivery_id) as n
  from (select distinct * from taken_record) where stream_name is not null and partition_id is not null and record_offset is not null) where n > 1""",
    "p5_batches": """
select distinct delivery_id from (select delivery_id, row_number() over (partition by subscription_id, stream_name, rtrim(partition_id, chr(0)), record_offset order by delivered_at nulls last, delivery_id) as n
  from (select distinct * from taken_record) where stream_name is not null and partition_id is not null and record_offset is not null) where n > 1""",
    "p5_kept": """
select subscription_id, stream_name, count(*) as n_rows, cast(sum(delivery_id) as bigint) as sum_id from (select *, case when stream_name is null or partition_id is null or record_offset is null then 1 else
  row_number() over (partition by subscription_id, stream_name, rtrim(partition_id, chr(0)), record_offset order by delivered_at nulls last, delivery_id) end as n from (select distinct * from taken_record)) where n = 1 group by 1, 2""",
}
