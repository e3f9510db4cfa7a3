"""The operators on unbounded input: Structured Streaming with state per key.

map needs no state (`operators.map.apply_map` takes streaming DataFrames). Offsets, reduce, join and window keep a small
state per key: a counter, the last result, the newest record of each side, the records of the windows still open. Within
a micro-batch a key's rows are put into the declared order; across micro-batches, order is that of arrival. The size of a
micro-batch bounds what a task sorts (`maxFilesPerTrigger`, `maxOffsetsPerTrigger`).
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillflow.runtime import cut_lineage

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
Step = Callable[[Any, list[dict]], tuple[Any, list[dict]]]


def configure(spark: SparkSession) -> None:
    """State of this kind needs the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Keyed(StatefulProcessor):
    def __init__(self, step: Step, order: list[str], inputs: list[str], columns: list[str]):
        self.step, self.order, self.inputs, self.columns = step, order, inputs, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", T.StructType([T.StructField("v", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf.columns = self.inputs  # over a union they arrive without their names
        pdf = pdf.sort_values(self.order, kind="stable", na_position="first")
        records = [{k: (None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v) for k, v in r.items()} for r in pdf.to_dict("records")]
        held = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else None
        held, out = self.step(held, records)
        self.state.update((pickle.dumps(held),))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _run(df: DataFrame, key: str, step: Step, order: list[str], schema: T.StructType, mode: str) -> DataFrame:
    configure(df.sparkSession)
    return df.where(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(statefulProcessor=_Keyed(step, order, df.columns, schema.names), outputStructType=schema, outputMode=mode, timeMode="None")


def _with(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, T.LongType()) for n in names)])


def stream_offsets(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Every record with its `_offset`. Null keys are left out."""

    def step(n, rows):
        n = n or 0
        return n + len(rows), [r | {"_offset": n + i} for i, r in enumerate(rows)]

    return _run(df, key, step, order, _with(df.schema, "_offset"), "Append")


def stream_reduce(df: DataFrame, key: str, order: list[str], fn: Callable[[dict, dict], dict]) -> DataFrame:
    """The running fold with `_offset`; the first record of a key passes through."""

    def step(held, rows):
        n, prev = held or (0, None)
        out = []
        for r in rows:
            prev = r if prev is None else fn(dict(prev), r)
            out.append({c: prev.get(c) for c in r} | {"_offset": n})
            n += 1
        return (n, prev), out

    return _run(df, key, step, order, _with(df.schema, "_offset"), "Append")


def stream_join(inputs: dict[str, tuple[DataFrame, str]], key: str, mapping: dict[str, str], order: dict[str, str]) -> DataFrame:
    """inputs: {stream: (DataFrame, key column)}; mapping: {field: "stream.column"}; order: {stream: its time column}.

    A record for each arrival with the latest record of each input, carried as a whole.
    """
    pairs = {f: tuple(v.split(".")[:2]) for f, v in mapping.items() if "." in v}
    names, parts, records = list(inputs), [], []
    for i, (name, (df, k)) in enumerate(inputs.items()):
        record = df.select(*sorted({c for s, c in pairs.values() if s == name})).schema
        records.append(record)
        # As text, since a batch of rows reaches the processor without nested columns.
        text = F.to_json(F.struct(*record.names), _JSON) if record.names else F.lit("{}")
        parts.append(df.select(F.col(k).cast("string").alias("__key"), F.col(order[name]).cast("timestamp_ntz").alias("__at"), F.lit(i).alias("__input"), text.alias("__record")))
    union = functools.reduce(DataFrame.unionByName, parts)
    schema = T.StructType([T.StructField("__key", T.StringType()), T.StructField("_offset", T.LongType()), *(T.StructField(f"__r{i}", T.StringType()) for i in range(len(names)))])

    def step(held, rows):
        n, sides = held or (0, {})
        out = []
        for r in rows:
            sides[r["__input"]] = r["__record"]
            out.append({"__key": r["__key"], "_offset": n} | {f"__r{i}": sides.get(i) for i in range(len(names))})
            n += 1
        return (n, sides), out

    joined = _run(union, "__key", step, ["__at", "__input"], schema, "Append")
    read = {f: F.from_json(f"__r{names.index(s)}", records[names.index(s)], _JSON).getField(c) for f, (s, c) in pairs.items()}
    if key in read:
        s, c = pairs[key]
        read[key] = F.coalesce(read[key], F.col("__key").cast(records[names.index(s)][c].dataType))
    else:
        read[key] = F.col("__key")
    return joined.select(*[read[f].alias(f) for f in sorted(read)], "_offset")


def stream_window(df: DataFrame, key: str, order: list[str], size: int, slide: int | None = None, closed_end: bool = False) -> DataFrame:
    """Count windows in update mode: each micro-batch gives the windows it changed, as they then are (`records`, a list of
    the input's rows). State holds the records of open windows only."""
    slide = slide or size
    span = size + 1 if closed_end else size
    names = df.schema.names
    schema = T.StructType([df.schema[key], T.StructField("window_no", T.LongType()), T.StructField("first_offset", T.LongType()), T.StructField("last_offset", T.LongType()), T.StructField("records", T.ArrayType(df.schema))])

    def step(held, rows):
        n, open_ = held or (0, {})
        touched = {}
        for r in rows:
            low = max(-(-(n - span + 1) // slide), 0)
            for w in range(low, n // slide + 1):
                first, kept = open_.setdefault(w, (n, []))
                kept.append(tuple(r[c] for c in names))
                touched[w] = (first, n, list(kept))
            n += 1
            open_ = {w: v for w, v in open_.items() if w * slide + span > n}
        k = rows[0][key] if rows else None
        out = [{key: k, "window_no": w, "first_offset": a, "last_offset": b, "records": [dict(zip(names, x)) for x in kept]} for w, (a, b, kept) in sorted(touched.items())]
        return (n, open_), out

    return _run(df, key, step, order, schema, "Update")


def stream_timed_window(df: DataFrame, key: str, timestamp: str, size: str, slide: str | None, lateness: str, values: dict) -> DataFrame:
    """Built-in time windows with a watermark: rows later than `lateness` are dropped by Spark's rule."""
    w = F.window(timestamp, size, slide) if slide else F.window(timestamp, size)
    df = df.withColumn(timestamp, F.col(timestamp).cast("timestamp"))  # a watermark wants a time with a zone
    return df.withWatermark(timestamp, lateness).groupBy(key, w).agg(*[c.alias(n) for n, c in values.items()])


def push(df: DataFrame, sub, key: str, on_taken: Callable[[DataFrame], None], now_ms: Callable[[], int], checkpoint: str, stored: str | None = None):
    """Drive a `Subscriptions` by a stream that has `_offset`: each micro-batch raises the ends of its keys, then every client
    with open demand gets its records through `on_taken(DataFrame)` (with a column `client`).

    Offsets that are handed out again (after an expiry, or a restart) may be of earlier micro-batches, so each micro-batch is
    stored under `stored` (else a folder of the checkpoint) by its number, and overwritten if it is tried again. Its steps are
    committed under that number too: a micro-batch tried again hands out the same records, and moves no cursor a second time.
    Nothing is collected but sums. Raises if a record handed out isn't stored."""
    stored = stored or f"{checkpoint}/records"

    def records(batch: DataFrame, taken: DataFrame) -> DataFrame:
        # Records of all micro-batches up to this one; of an offset sent several times the newest.
        found = batch.sparkSession.read.schema(T.StructType([*batch.schema.fields, T.StructField("__batch", T.LongType())])).parquet(stored)
        wanted = taken.select(F.col("key").alias("__k"), F.col("offset").alias("__o"))
        found = found.join(wanted, (F.col(key).cast("string") == F.col("__k")) & (F.col("_offset") == F.col("__o")))
        found = cut_lineage(found.groupBy("__k", "__o").agg(F.max_by(F.struct(*batch.columns), "__batch").alias("r")).select("r.*"))
        if found.count() < taken.count():
            raise RuntimeError(f"{stored} lacks records that the subscription handed out")
        return found

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{stored}/__batch={number}")
            sub.produced(batch.groupBy(F.col(key).cast("string").alias("key")).agg(F.max("_offset").alias("end")), f"{checkpoint}#{number}")
            for client in sorted(sub.demand):
                token = f"{checkpoint}#{number}#{client}"
                if sub.demand[client] > 0 or sub._done(token):
                    taken = sub.deliver(client, now_ms(), token)
                    if taken.limit(1).count():
                        on_taken(records(batch, taken).withColumn("client", F.lit(client)))
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
