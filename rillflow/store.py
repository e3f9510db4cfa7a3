"""Stored logs: what a stream's records were given once, offset and time of arrival, is kept and read back.

A log is a folder. ``data/commit=<c>/bucket=<b>/`` holds parquet files, sorted by key and offset, ``ends/commit=<c>/bucket=<b>/`` how
far each key of the commit goes, and ``commits/<number>.json`` says which commits count. Records of a key lie in one
bucket, so a read of one key opens one bucket and, in it, the row groups of that key; an append reads the ends of its own
keys, not the log. A commit is a file that only one writer can create: who loses takes the newer ends and stamps again,
so offsets stay dense whoever appends.
"""

from __future__ import annotations

import json
import threading
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.errors import SourceError
from rillflow.files import Files
from rillflow.operators.scan import Running, ranged, running
from rillflow.runtime import cut_lineage

#: Buckets of a log, commits of one level that are merged into one of the next, attempts at a commit.
BUCKETS, MERGE, ATTEMPTS = 16, 10, 40
#: Offsets of a stretch: what one task takes of a key when a stored log has a hot one.
STRETCH_ROWS = 1_000_000
#: Keys of a batch whose ends are looked up by value; the ends of larger batches are joined.
FEW_KEYS = 1_000
_SYSTEM = T.StructType([T.StructField("_offset", T.LongType()), T.StructField("_timestamp", T.TimestampNTZType()), T.StructField("_arrival", T.TimestampNTZType())])
_PLACE = [T.StructField("commit", T.StringType()), T.StructField("bucket", T.IntegerType())]


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class StoredLog:
    def __init__(self, spark: SparkSession, root: str, key: str, struct: T.StructType, buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.struct = spark, root.rstrip("/"), key, struct
        self.files, self.buckets = Files(spark), buckets
        self._held: list[tuple[int, dict]] = []
        self._lock = threading.Lock()

    def commits(self) -> list[dict]:
        """All commits, oldest first; those read before are remembered."""
        seen = {n for n, _ in self._held}
        for name in self.files.names(f"{self.root}/commits"):
            n = int(name.removesuffix(".json"))
            if n not in seen:
                self._held.append((n, json.loads(self.files.read(f"{self.root}/commits/{name}"))))
        self._held.sort(key=lambda c: c[0])
        return [c for _, c in self._held]

    @property
    def version(self) -> int:
        return len(self.commits())

    def live(self) -> list[dict]:
        """The commits whose data counts: not merged into another, and after the last that replaced everything."""
        out: dict[str, dict] = {}
        for c in self.commits():
            if c["kind"] == "replace":
                out = {}
            for d in c.get("merges", []):
                out.pop(d, None)
            if c["data"]:
                out[c["data"]] = c
        return list(out.values())

    def largest_key(self) -> int:
        """Records of the largest key, known from the commits."""
        return max((c["largest"] for c in self.live()), default=0)

    def rows(self) -> int:
        return sum(c["rows"] for c in self.live())

    def find(self, token: str) -> bool:
        """Whether a batch of that token has been committed."""
        return any(token in c["tokens"] for c in self.commits())

    def last_arrival(self) -> str | None:
        return max((c["arrival"] for c in self.commits() if c["arrival"]), default=None)

    def _open(self, what: str, fields: list[T.StructField]) -> DataFrame:
        """The parquet of the live commits, as one scan."""
        schema, live = T.StructType([*fields, *_PLACE]), self.live()
        if not live:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{what}").parquet(*[f"{self.root}/{what}/commit={c['data']}" for c in live])

    def read(self, value: Any = None) -> DataFrame:
        """Fields, `_offset`, `_timestamp`, `_arrival` and `_stretch`; of one key, if a value is given. No job is started."""
        df = self._open("data", [*self.struct.fields, *_SYSTEM.fields])
        if value is not None:
            df = df.where((F.col("bucket") == bucket_of(F.lit(value).cast(self.struct[self.key].dataType), self.buckets)) & (F.col(self.key) == F.lit(value)))
        return df.select(*self.struct.names, *_SYSTEM.names, F.floor(F.col("_offset") / STRETCH_ROWS).alias("_stretch"))

    def _open_ends(self) -> DataFrame:
        return self._open("ends", [T.StructField("__key", self.struct[self.key].dataType), T.StructField("__end", T.LongType()), T.StructField("__rows", T.LongType())])

    def ends(self) -> DataFrame:
        """(__key, __end): the number of records of each key, without reading them."""
        return self._open_ends().groupBy("__key").agg(F.max("__end").alias("__end"))

    def append(self, rows: DataFrame, order: list[str], arrival: str, token: str | None = None, hot_rows: int = 2_000_000) -> int:
        """Stamp and store rows (fields, `_timestamp`, `_arrival`, the columns of `order`); the number of the commit.

        Offsets go on where the key's log ends. A token already committed changes nothing, so that a batch tried again is
        stored once. Rows with a null key are left out. A key with more than `hot_rows` rows in the batch is numbered by
        several tasks. arrival: the latest `_arrival` of the rows.
        """
        with self._lock:
            if token is not None and self.find(token):
                return self.version
            held = cut_lineage(rows.where(F.col(self.key).isNotNull()))  # what is read twice must be the same twice
            largest = held.groupBy(self.key).count().orderBy(F.desc("count")).limit(FEW_KEYS + 1).collect()
            number = [Running("__place", "count", F.lit(1))]
            placed = running(ranged(held, self.key, order), [self.key], order, number) if largest and largest[0]["count"] > hot_rows else running(held, [self.key], order, number, None)
            for _ in range(ATTEMPTS):
                n, ends = self.version, self._open_ends()
                if len(largest) <= FEW_KEYS:
                    ends = ends.where(F.col("__key").isin(*{r[0] for r in largest})) if largest else ends.limit(0)
                ends = ends.groupBy("__key").agg(F.max("__end").alias("__end"))
                numbered = placed.join(ends, placed[self.key] == ends["__key"], "left")
                stamped = numbered.select(*self.struct.names, (F.coalesce("__end", F.lit(0)) + F.col("__place") - 1).cast("bigint").alias("_offset"), "_timestamp", "_arrival")
                if self._store(n, stamped, "append", arrival, [token] if token else []):
                    self._merge()
                    return n
            raise SourceError(f"{self.root}: {ATTEMPTS} attempts at a commit were overtaken")

    def replace(self, log: DataFrame, versions: dict[str, str]) -> int:
        """Store a log whose offsets are given, in the place of what was there."""
        with self._lock:
            wanted = log.select(*self.struct.names, *[F.col(c) if c in log.columns else F.col("_timestamp").alias(c) for c in _SYSTEM.names])
            for _ in range(ATTEMPTS):
                n = self.version
                if self._store(n, wanted, "replace", None, [], versions=versions):
                    return n
            raise SourceError(f"{self.root}: {ATTEMPTS} attempts at a commit were overtaken")

    def _store(self, n: int, df: DataFrame, kind: str, arrival: str | None, tokens: list[str], **more) -> bool:
        commit = f"{n:012d}-{uuid.uuid4().hex[:8]}"
        data, ends = (f"{self.root}/{what}/commit={commit}" for what in ("data", "ends"))
        # Offsets in stretches beside the bucket, so that a hot key is written by several tasks.
        out = df.withColumn("bucket", bucket_of(F.col(self.key), self.buckets)).withColumn("__s", F.floor(F.col("_offset") / STRETCH_ROWS))
        out.repartition("bucket", "__s").sortWithinPartitions("bucket", self.key, "_offset").drop("__s").write.partitionBy("bucket").parquet(data)
        rows, top = 0, 0
        if self.files.data_files(data):
            read = self.spark.read.schema(T.StructType([self.struct[self.key], _SYSTEM["_offset"], _PLACE[1]])).parquet(data)
            far = read.groupBy(F.col(self.key).alias("__key"), "bucket").agg((F.max("_offset") + 1).alias("__end"), F.count(F.lit(1)).alias("__rows"))
            seen = Observation()
            far.sortWithinPartitions("bucket", "__key").observe(seen, F.sum("__rows").alias("rows"), F.max("__end").alias("top")).write.partitionBy("bucket").parquet(ends)
            rows, top = seen.get["rows"], seen.get["top"]
        entry = {"kind": kind, "data": commit if rows else "", "rows": rows, "largest": top, "arrival": arrival, "tokens": tokens, "level": 0, "schema": self.struct.json()} | more
        if self.files.put_new(f"{self.root}/commits/{n:012d}.json", json.dumps(entry)):
            return True
        for at in (data, ends):
            self.files.delete(at)
        return False

    def _merge(self) -> None:
        """Many small commits of a level become one of the next, so that a read opens few folders. Gives way to any other commit."""
        by: dict[int, list[dict]] = {}
        for c in self.live():
            by.setdefault(c["level"], []).append(c)
        for level in sorted(by):
            if len(by[level]) >= MERGE:
                old = [c["data"] for c in by[level]]
                df = self.spark.read.schema(T.StructType([*self.struct.fields, *_SYSTEM.fields])).option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/commit={d}" for d in old])
                self._store(self.version, df, "merge", None, [], merges=old, level=level + 1)
