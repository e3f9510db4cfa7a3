"""The engine: configurations, sources and functions in; every stream out as a DataFrame."""

from __future__ import annotations

import datetime as dt
import json
import threading
import uuid
from collections.abc import Iterable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.catalog import Topography
from rillflow.errors import RecordNotFound, RillError, SourceError
from rillflow.files import Files
from rillflow.operators import query
from rillflow.operators.join import apply_join
from rillflow.operators.log import STRETCH_S, as_log, largest_key
from rillflow.operators.map import SYSTEM, apply_map
from rillflow.operators.reduce import apply_reduce
from rillflow.operators.window import apply_count_window, apply_timed_window, place_in_count_windows, place_in_time_windows
from rillflow.runtime import ensure_checkpoint_dir
from rillflow.store import BUCKETS, StoredLog
from rillflow.subscription import Subscriptions
from rillflow.types import conform
from rillflow.udf import ArrowMap, ColumnMap, Fold, PyFold, Registry

#: Rows of a key that one task may sort; a source with a larger key is processed in stretches.
HOT_ROWS = 2_000_000
#: A buffer of single records is written when it holds so many bytes, or when its oldest record is so old at the next one.
FLUSH_BYTES, FLUSH_MS = 50_000, 250


class Engine:
    """Composes each derived stream from its bases; Catalyst plans the whole DAG at once.

    A base stream is either bound to a DataFrame or produced into a stored log, whose offsets and times of arrival are given
    once. Where the records are kept is the storage's matter: a folder (`file`), a bucket (`s3`), or, for `memory` and
    without a storage, a folder of the session that nobody reads after it.

    Keys of usual size are one window each, and all operators stacked on a source share its exchange. Where a source has a
    key of more than `hot_rows` rows, it and what is derived from it run in stretches, which costs a pre-aggregation for each operator and
    spreads the key. A stored log knows its largest key; of a bound source it is counted when the whole stream is first read,
    unless `bind_source` was told. Reads of one key neither count nor stretch.

    With `path`, the topography and the registered functions are kept there, and an Engine started on it has them again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, stretch_s: int = STRETCH_S, hot_rows: int = HOT_ROWS, buckets: int = BUCKETS):
        self.spark, self.files, self.functions, self.path = spark, Files(spark), Registry(), path
        self.topography = Topography(f"{path}/topography.jsonl" if path else None, self.files)
        self.stretch_s, self.hot_rows, self.buckets = stretch_s, hot_rows, buckets
        self._hot: dict[str, bool] = {}
        self._sources: dict[str, tuple[DataFrame, list[str], str | None, str]] = {}
        self._logs: dict[str, StoredLog] = {}
        self._waiting: dict[str, list[tuple[str, str]]] = {}
        self._last, self._lock, self._scratch = "", threading.RLock(), None
        for name in self.files.names(f"{path}/functions") if path else []:
            self.functions.register(name, cloudpickle.loads(bytes.fromhex(self.files.read(f"{path}/functions/{name}"))))
        self._to_session()

    def ping(self) -> bool:
        return self.spark.range(1).count() == 1

    def apply_config(self, toml: str) -> list[str]:
        """Merge a configuration into the topography (idempotent); gives the streams it added. An s3 storage's settings go to the session."""
        added = self.topography.apply(toml)
        self._to_session()
        return added

    def _to_session(self) -> None:
        if (s := self.topography.storage()) and s.kind == "s3":
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            for k, v in s.spark_conf().items():
                conf.set(k, v)

    def topography_toml(self) -> str:
        return self.topography.to_toml()

    def register_udf(self, name: str, fn: ColumnMap | ArrowMap | Fold | PyFold) -> None:
        self.functions.register(name, fn)
        if self.path:
            self.files.replace(f"{self.path}/functions/{name}", cloudpickle.dumps(fn).hex())

    def drop_stream(self, name: str) -> None:
        """Forget a stream and delete what is stored of it."""
        self.topography.drop_stream(name)
        self._sources.pop(name, None)
        self._waiting.pop(name, None)
        self._logs.pop(name, None)
        self.files.delete(f"{self._root()}/{name}")

    def metadata(self, name: str) -> dict[str, Any]:
        """What is known of a stream without reading it."""
        spec, log = self.topography.stream(name), self.stored(name)
        return {"name": name, "kind": spec.kind, "inputs": list(spec.inputs), "children": self.topography.children(name), "partition_key": spec.partition_key, "fields": dict(self.topography.fields(name)), "bound": name in self._sources, "records": log.rows(), "commits": log.version}

    # Records in

    def _base(self, stream: str) -> None:
        if self.topography.stream(stream).kind is not None:
            raise SourceError(f"stream {stream!r} is derived; it takes no records")

    def bind_source(self, stream: str, df: DataFrame, order_by: list[str], timestamp: str | None = None, hot: bool | None = None) -> None:
        """Give a base stream its records. `order_by` is the order of arrival. hot: whether a key has more than `hot_rows` rows (None: count)."""
        self._base(stream)
        self._sources[stream] = (df, list(order_by), timestamp, uuid.uuid4().hex)
        self._hot.pop(stream, None)
        if hot is not None:
            self._hot[stream] = hot

    def _root(self) -> str:
        storage = self.topography.storage()
        if storage and (at := storage.path()):
            return at
        if self._scratch is None:
            self._scratch = f"{ensure_checkpoint_dir(self.spark)}/streams-{uuid.uuid4().hex}"
        return self._scratch

    def stored(self, name: str) -> StoredLog:
        """The stored log of a stream (without commits, if nothing was stored)."""
        with self._lock:
            if name not in self._logs:
                struct = T.StructType([T.StructField(f.name, f.dataType) for f in self.topography.struct(name)])
                log = StoredLog(self.spark, f"{self._root()}/{name}", self._key(name), struct, self.buckets)
                if done := log.live():
                    log.struct = T.StructType.fromJson(json.loads(done[-1]["schema"]))
                self._last = max(self._last, log.last_arrival() or "")
                self._logs[name] = log
            return self._logs[name]

    def _stamp(self) -> str:
        """The time, later than every stamp before it: arrival on any stream has one order."""
        with self._lock:
            now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
            if self._last and now <= (last := dt.datetime.fromisoformat(self._last)):
                now = last + dt.timedelta(microseconds=1)
            self._last = now.isoformat(sep=" ", timespec="microseconds")
            return self._last

    def produce(self, stream: str, rows: DataFrame, order_by: list[str] | None = None, timestamp: str | None = None, token: str | None = None) -> None:
        """Append records to the stream's stored log, after those it has: offset and arrival are given now, once.

        `order_by` is the order of arrival inside the batch (by the columns' own types, nulls first); ties, and batches without it, arrive in
        the order the rows are read in now. `timestamp` names a column for `_timestamp`; else it is the time of arrival. A batch with a
        `token` that was stored before changes nothing. If the stream was bound, the bound records are stored first.
        """
        self._base(stream)
        spec, struct = self.topography.stream(stream), self.topography.struct(stream)
        if missing := {spec.partition_key, *(order_by or []), *([timestamp] if timestamp else [])} - set(rows.columns):
            raise SourceError(f"the records lack {sorted(missing)}")
        log = self.stored(stream)
        if stream in self._sources:
            self.write(stream)
            del self._sources[stream]
        self.flush(stream)
        at = self._stamp()
        order = [f"__o{i}" for i in range(len(order_by or []))]
        fields = self.topography.fields(stream)
        named = rows.select(
            *[conform(f.name, fields[f.name], lambda n: F.col(n) if n in rows.columns else F.lit(None)) for f in struct],
            *[F.col(c).alias(o) for c, o in zip(order_by or [], order)],
            F.monotonically_increasing_id().alias("__read"),
            (F.col(timestamp).cast("timestamp_ntz") if timestamp else F.lit(at).cast("timestamp_ntz")).alias("_timestamp"),
            F.lit(at).cast("timestamp_ntz").alias("_arrival"),
        )
        log.append(named, [*order, "__read"], at, token, self.hot_rows)

    def produce_json(self, stream: str, rows: str | DataFrame | Iterable[str | dict[str, Any]], text: str | None = None, order_by: list[str] | None = None, timestamp: str | None = None) -> None:
        """Append records given as JSON objects.

        Of a DataFrame, column `text` holds one object a row; declared fields that the object lacks are taken from the column of their name,
        if there is one; a text that isn't an object gives a record of these alone. One text, texts or dicts are buffered and written together
        (`FLUSH_BYTES`, `FLUSH_MS`; every read writes them too), each with its own time of arrival; of these, what isn't an object is an error.
        """
        self._base(stream)
        struct = self.topography.struct(stream)
        if isinstance(rows, DataFrame):
            if text not in rows.columns:
                raise SourceError(f"the records lack {text!r}")
            parsed = rows.withColumn("__json", F.from_json(text, struct))
            fields = [F.coalesce(F.col("__json").getField(f.name), F.col(f.name).try_cast(f.dataType)) if f.name in rows.columns and f.name != text else F.col("__json").getField(f.name) for f in struct]
            extra = [c for c in {*(order_by or []), *([timestamp] if timestamp else [])} if c not in struct.names]
            self.produce(stream, parsed.select(*[c.alias(f.name) for c, f in zip(fields, struct)], *extra), order_by, timestamp)
            return
        items = [rows] if isinstance(rows, (str, bytes, dict)) else list(rows)
        try:
            dicts = [json.loads(r) if isinstance(r, (str, bytes)) else r for r in items]
            texts = [json.dumps(d) for d in dicts if isinstance(d, dict)]
        except ValueError as e:
            raise SourceError(f"not JSON: {e}") from e
        if len(texts) != len(dicts):
            raise SourceError("a record must be a JSON object")
        with self._lock:
            self.stored(stream)
            waiting = self._waiting.setdefault(stream, [])
            waiting += [(self._stamp(), t) for t in texts]
            full = sum(len(t) for _, t in waiting) > FLUSH_BYTES
            old = bool(waiting) and (dt.datetime.fromisoformat(self._last) - dt.datetime.fromisoformat(waiting[0][0])).total_seconds() * 1000 > FLUSH_MS
        if full or old:
            self.flush(stream)

    def flush(self, stream: str | None = None) -> None:
        """Write the buffered records of a stream, or of all. What isn't written is lost with the driver."""
        for name in [stream] if stream else list(self._waiting):
            with self._lock:
                waiting = self._waiting.pop(name, [])
                if not waiting:
                    continue
                if name in self._sources:
                    self.write(name)
                    del self._sources[name]
                struct = self.topography.struct(name)
                rows = self.spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(waiting)], "__i bigint, __a string, __t string").withColumn("__r", F.from_json("__t", struct))
                at, fields = F.col("__a").cast("timestamp_ntz"), self.topography.fields(name)
                named = rows.select(*[conform(f.name, fields[f.name], lambda n: F.col("__r").getField(n)) for f in struct], "__i", at.alias("_timestamp"), at.alias("_arrival"))
                self.stored(name).append(named, ["__i"], waiting[-1][0])

    def ingest(self, stream: str, rows: DataFrame, checkpoint: str, order_by: list[str] | None = None, timestamp: str | None = None):
        """Append a streaming DataFrame to the stream's stored log, a micro-batch a commit, each exactly once; a streaming query."""
        self._base(stream)

        def each(batch: DataFrame, number: int) -> None:
            self.produce(stream, batch, order_by, timestamp, token=f"{checkpoint}#{number}")

        return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    # Streams out

    def is_hot(self, name: str) -> bool:
        """Whether the stream, or one it is derived from, has a key too large for one task."""
        spec = self.topography.stream(name)
        if spec.kind is not None:
            return any([self.is_hot(i) for i in spec.inputs])
        if name not in self._sources:
            return self.stored(name).largest_key() > self.hot_rows
        if name not in self._hot:
            self._hot[name] = largest_key(self._sources[name][0], spec.partition_key) > self.hot_rows
        return self._hot[name]

    def version(self, name: str) -> dict[str, str]:
        """What the stream is derived from, as it is now: base stream -> version."""
        spec = self.topography.stream(name)
        if spec.kind is None:
            return {name: self._sources[name][3] if name in self._sources else f"{self.stored(name).root}@{self.stored(name).version}"}
        return {k: v for i in spec.inputs for k, v in self.version(i).items()}

    def _is_written(self, name: str) -> bool:
        """Whether the stored log holds the stream as it is now."""
        live = self.stored(name).live()
        return bool(live) and live[-1].get("versions") == self.version(name)

    def log(self, name: str, lineage: bool = False, value: Any = None, values: dict[str, Column] | None = None, hot: bool | None = None) -> DataFrame:
        """A stream with its system columns. value: the one key that is asked for, whose bucket is then the only one opened; nothing is
        counted for it. lineage: of a join, the offsets of its sources. values: of a time window, aggregates over its records."""
        spec, fields = self.topography.stream(name), self.topography.fields(name)
        hot = False if value is not None else self.is_hot(name) if hot is None else hot
        if spec.kind is None:
            self.flush(name)
            if name not in self._sources:
                log = self.stored(name)
                if not log.version:
                    raise SourceError(f"stream {name!r} has no records bound")
                return log.read(value)
            if self._is_written(name):
                return self.stored(name).read(value)
            df, order_by, timestamp, _ = self._sources[name]
            if spec.partition_key not in df.columns:
                raise SourceError(f"the source of {name!r} lacks {spec.partition_key!r}")
            return as_log(df, fields, spec.partition_key, order_by, timestamp, self.stretch_s, hot)
        if not lineage and not values:
            self.flush()
            if self._is_written(name):
                return self.stored(name).read(value)
        if spec.kind == "join":
            inputs = {i: (self.log(i, hot=hot), self.topography.stream(i).partition_key) for i in spec.inputs}
            return apply_join(inputs, spec.partition_key, fields, dict(spec.mapping), lineage, self.stretch_s, hot)
        base, of = self.log(spec.base, hot=hot), self.topography.stream(spec.base).partition_key
        if spec.kind == "map":
            return apply_map(base, self.functions.get(spec.function, ColumnMap, ArrowMap), fields)
        if spec.kind == "reduce":
            return apply_reduce(base, self.functions.get(spec.function, Fold, PyFold), of, fields, hot)
        size, slide = spec.window.sizes()
        names = sorted(self.topography.fields(spec.base))
        if spec.window.timed:
            return apply_timed_window(base, of, names, size, slide, values, self.stretch_s)
        return apply_count_window(base, of, names, size, slide, spec.window.closed_end, self.stretch_s)

    def stream(self, name: str, value: Any = None, values: dict[str, Column] | None = None) -> DataFrame:
        """A stream as a DataFrame: declared fields, `_offset` and `_timestamp` (windows: also their bounds, and count windows
        their records)."""
        return self.log(name, value=value, values=values).drop("_stretch", "_arrival")

    def window_records(self, name: str) -> DataFrame:
        """The records of the base of a window stream, each once for every window that holds it: `_window` is the window's number."""
        spec = self.topography.stream(name)
        if spec.kind != "window":
            raise RillError(f"stream {name!r} isn't a window")
        size, slide = spec.window.sizes()
        base = self.log(spec.base)
        placed = place_in_time_windows(base, size, slide) if spec.window.timed else place_in_count_windows(base, size, slide, spec.window.closed_end)
        return placed.select(*[c for c in base.columns if c not in ("_stretch", "_arrival")], F.col("__w").alias("_window"))

    def _key(self, name: str) -> str:
        spec = self.topography.stream(name)
        return self._key(spec.base) if spec.kind == "window" else spec.partition_key

    def at(self, stream: str, key, offset: int) -> DataFrame:
        return query.at(self.stream(stream, key), self._key(stream), key, offset)

    def latest(self, stream: str, key=None) -> DataFrame:
        return query.latest(self.stream(stream, key), self._key(stream), key)

    def at_timestamp(self, stream: str, time, key=None) -> DataFrame:
        return query.from_time(self.stream(stream, key), self._key(stream), time, key)

    def range(self, stream: str, key, first: int, last: int) -> DataFrame:
        return query.between(self.stream(stream, key), first, last, self._key(stream), key)

    def lookup(self, stream: str, wanted: DataFrame) -> DataFrame:
        return query.lookup(self.stream(stream), self._key(stream), wanted)

    def record(self, stream: str, key, offset: int | None = None) -> dict:
        """One record as a dict: at an offset, or the latest. RecordNotFound if there is none."""
        df = self.latest(stream, key) if offset is None else self.at(stream, key, offset)
        rows = df.take(1)
        if not rows:
            raise RecordNotFound(f"stream {stream!r}, key {key!r}, offset {offset if offset is not None else 'latest'}")
        return rows[0].asDict(recursive=True)

    def ends(self, stream: str) -> DataFrame:
        """(key, end): each key as text, and its greatest offset."""
        if self.topography.stream(stream).kind is None and stream not in self._sources:
            self.flush(stream)
            return self.stored(stream).ends().select(F.col("__key").cast("string").alias("key"), (F.col("__end") - 1).alias("end"))
        df = self.log(stream)
        return df.groupBy(F.col(self._key(stream)).cast("string").alias("key")).agg(F.max("_offset").alias("end"))

    def subscribe(self, stream: str, timeout_ms: int = 500, path: str | None = None) -> Subscriptions:
        """A subscription over the keys the stream has now; `produced(engine.ends(stream))` tells it of later ones."""
        sub = Subscriptions(self.spark, path or f"{self._root()}/{stream}/subscriptions/{uuid.uuid4().hex}", stream, timeout_ms)
        sub.produced(self.ends(stream))
        return sub

    def deliver(self, sub: Subscriptions, taken: DataFrame) -> DataFrame:
        """The records a take handed out."""
        key = self._key(sub.stream)
        df = self.stream(sub.stream)
        return query.lookup(df, key, taken.select(F.col("key").cast(df.schema[key].dataType).alias(key), F.col("offset").alias("_offset")))

    def write(self, stream: str) -> str:
        """Store a stream, bound or derived, in the storage in force: reads of it open the stored log, until something it is derived
        from changes. Raises if the records of a bound source tie in their order. Gives the folder of its parquet."""
        if stream in self._sources:
            self.validate_order(stream)
        versions, log = self.version(stream), self.stored(stream)
        if self.topography.stream(stream).kind is not None or stream in self._sources:
            df = self.log(stream)
            log.struct = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema if f.name not in SYSTEM])
            log.replace(df, versions)
        else:
            self.flush(stream)
        return f"{log.root}/data"

    def view(self, stream: str) -> str:
        """A temporary view of the stream; its name."""
        self.stream(stream).createOrReplaceTempView(f"stream_{stream}")
        return f"stream_{stream}"

    def validate_order(self, stream: str) -> None:
        """Raise if records of a key tie in the declared order (their offsets then follow a hash, not arrival)."""
        df, order_by, *_ = self._sources[stream]
        key = self.topography.stream(stream).partition_key
        ties = df.where(F.col(key).isNotNull()).groupBy(key, *order_by).count().where("count > 1").limit(1).count()
        if ties:
            raise RillError(f"stream {stream!r}: its order {order_by} isn't unique per key")
