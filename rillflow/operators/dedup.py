"""Messages delivered more than once: exactly one copy of each is kept.

1. Identifiers are hashed where they are read and packed, per slice of the hash space and time bucket, into few binary rows; of an
   identifier repeated in a task only two copies leave it.
2. A slice holds a Bloom filter per time bucket (two bytes an identifier, grown in doubling steps). An identifier that no
   filter may hold is new and is never looked at again; for the others the buckets that may hold a copy come out.
3. What came out, (identifier, bucket), becomes a bit array of bounded size. It is tested where the rows are read, before
   anything is moved, so that only possible repeats in matching buckets are shuffled, and these are verified by their full identifier.

`surplus` does this for one table. `DeliveryStore` keeps filters and identifiers between batches: a new batch is screened
against the filters, and only matching buckets of what is stored are read again.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.files import Files
from rillflow.runtime import cut_lineage

#: Bits an identifier sets; bits a filter has for each identifier; identifiers of a filter's first part (each further part has twice as many).
PROBES, BITS_EACH, FIRST_PART = 6, 16, 1 << 12
#: Hashes that a task packs at once.
PACK = 1 << 20
#: Bytes of input for each slice of the hash space.
SLICE_BYTES = 32 << 20
#: Bits for each possible repeat in the array tested at the scan, and the most bits it may have: beyond, more rows pass it
#: and are verified, the result is the same.
SUSPECT_BITS, MOST_BITS, SUSPECT_PROBES = 16, 1 << 28, 4
_NO_TIME = -(1 << 40)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Bloom:
    """Bloom filter over 64-bit hashes that grows by parts, each twice as large: a query looks at few parts, however many hashes it holds."""

    def __init__(self, first: int = FIRST_PART):
        self.parts: list[np.ndarray] = []
        self.room, self.next = 0, first

    @staticmethod
    def _positions(h: np.ndarray, size: int) -> np.ndarray:
        m = h * _MIX
        m ^= m >> np.uint64(32)
        m *= _MIX
        a, b = m & np.uint64(0xFFFFFFFF), (m >> np.uint64(32)) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(size)

    def add(self, h: np.ndarray) -> None:
        while len(h):
            if not self.room:
                self.parts.append(np.zeros(self.next * BITS_EACH // 8, np.uint8))
                self.room, self.next = self.next, self.next * 2
            part, h = h[: self.room], h[self.room :]
            self.room -= len(part)
            pos = self._positions(part, self.parts[-1].size * 8).ravel()
            np.bitwise_or.at(self.parts[-1], (pos >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (pos & np.uint64(7)).astype(np.uint8)))

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for bits in self.parts if len(h) else ():
            pos = self._positions(h, bits.size * 8)
            out |= ((bits[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1).all(1)
        return out


_PACKED = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("payload", T.BinaryType())])
_FILTER, _HASHES, _SUSPECTS = 0, 1, 2


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_PACKED.names)


def _pack(slices: int):
    """(hash, bucket) -> a row per slice and bucket with the sorted hashes, those that repeat twice."""

    def flush(h: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
        place = (h % np.uint64(slices)).astype(np.int32)
        order = np.lexsort((h, bucket, place))
        h, bucket, place = h[order], bucket[order], place[order]
        same = (h[1:] == h[:-1]) & (bucket[1:] == bucket[:-1])
        third = np.zeros(len(h), bool)
        third[2:] = same[1:] & same[:-1]
        h, bucket, place = h[~third], bucket[~third], place[~third]
        cuts = np.flatnonzero((place[1:] != place[:-1]) | (bucket[1:] != bucket[:-1])) + 1
        starts = np.append(0, cuts)
        return _rows([(int(place[a]), _HASHES, int(bucket[a]), part.tobytes()) for a, part in zip(starts, np.split(h, cuts))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy().view(np.uint64).copy(), b.column(1).to_numpy().copy()))
                n += b.num_rows
            if n >= PACK:
                yield flush(*(np.concatenate(x) for x in zip(*held)))
                held, n = [], 0
        if n:
            yield flush(*(np.concatenate(x) for x in zip(*held)))

    return run


def _screen(keep: bool):
    """Packed rows of whole slices, stored filters before hashes -> possible repeats (and, with `keep`, the filters that changed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[tuple[int, int], Bloom] = {}
        whole: dict[int, Bloom] = {}  # new hashes of all buckets: most need no other probe
        stored: dict[int, list[int]] = {}
        changed: set[tuple[int, int]] = set()
        for b in batches:
            out = []
            for place, kind, bucket, payload in zip(*(c.to_pylist() for c in b.columns)):
                if kind == _FILTER:
                    filters[place, bucket] = pickle.loads(payload)
                    stored.setdefault(place, []).append(bucket)
                    continue
                h = np.frombuffer(payload, np.uint64)
                twice = np.zeros(len(h), bool)
                twice[1:] = h[1:] == h[:-1]
                found = {bucket: [h[twice]]}
                h = h[~twice]
                seen = whole.setdefault(place, Bloom())
                maybe = seen.may_hold(h)
                for other in stored.get(place, ()):
                    maybe |= filters[place, other].may_hold(h)
                if maybe.any():
                    known = h[maybe]
                    for (p, other), bloom in filters.items():
                        if p == place and (hit := bloom.may_hold(known)).any():
                            found.setdefault(other, []).append(known[hit])
                            found.setdefault(bucket, []).append(known[hit])
                filters.setdefault((place, bucket), Bloom()).add(h)
                seen.add(h)
                changed.add((place, bucket))
                for at, parts in found.items():
                    if len(hashes := np.unique(np.concatenate(parts))):
                        out.append((place, _SUSPECTS, at, hashes.tobytes()))
            if out:
                yield _rows(out)
        for place, bucket in sorted(changed) if keep else ():
            yield _rows([(place, _FILTER, bucket, pickle.dumps(filters[place, bucket]))])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for bucket, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            h = np.frombuffer(payload, np.int64)
            for i in range(0, len(h), 10_000):
                part = h[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), bucket, np.int64))], names=["h", "bucket"])


def _identified(df: DataFrame, identity: list[Column], delivery: str, delivered: str, bucket_s: int) -> tuple[DataFrame, list[str]]:
    """Rows that have an identifier: its parts, delivery (`__d`), time (`__t`), hash (`h`) and time bucket."""
    ids = [f"__id{i}" for i in range(len(identity))]
    base = df.select(*[c.alias(n) for n, c in zip(ids, identity)], F.col(delivery).alias("__d"), F.col(delivered).alias("__t"))
    for n in [*ids[1:], "__d"]:
        base = base.where(F.col(n).isNotNull())
    return base.withColumn("h", F.xxhash64(*ids)).withColumn("bucket", F.coalesce(F.floor(F.unix_micros(F.col("__t").cast("timestamp")) / F.lit(bucket_s * 1_000_000)), F.lit(_NO_TIME))), ids


def _slices(df: DataFrame) -> int:
    """Slices of the hash space for a table: by the optimizer's estimate of its size, or a plenty where it has none (rows of an RDD)."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores, size // SLICE_BYTES if size < 1 << 60 else 4 * cores)


def _screened(base: DataFrame, slices: int, stored: DataFrame | None = None) -> DataFrame:
    """Possible repeats as packed rows; beside stored filters also the filters that changed."""
    packed = base.select("h", "bucket").mapInArrow(_pack(slices), _PACKED)
    both = packed if stored is None else packed.unionByName(stored)
    return cut_lineage(both.repartition(slices, "slice").sortWithinPartitions("slice", "kind").mapInArrow(_screen(stored is not None), _PACKED))


def _position(i: int, bits: int) -> Column:
    return F.expr(f"((xxhash64(h, bucket) & 4294967295) + (shiftrightunsigned(xxhash64(h, bucket), 32) | 1L) * {i}L) & {bits - 1}L")


def _marked(screened: DataFrame) -> tuple[np.ndarray, int]:
    """The bit array of the possible repeats, and how many there are. Built on the executors; at most MOST_BITS come to the driver."""
    suspects = screened.where(F.col("kind") == _SUSPECTS)
    n = suspects.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    n //= 8
    bits = 1 << min(int(math.log2(MOST_BITS)), max(15, math.ceil(math.log2(max(1, n * SUSPECT_BITS)))))
    array = np.zeros(bits // 8, np.uint8)
    if n:
        at = suspects.select("bucket", "payload").mapInArrow(_unpack, "h bigint, bucket bigint").select(F.explode(F.array(*[_position(i, bits) + 1 for i in range(SUSPECT_PROBES)])).alias("p"))
        for r in at.groupBy(F.bitmap_bucket_number("p").alias("c")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b")).toLocalIterator():
            # The bitmap functions count from 1.
            array[(r.c - 1) * 4096 : r.c * 4096] = np.frombuffer(r.b, np.uint8)
    return array, n


def _passing(rows: DataFrame, array: np.ndarray) -> DataFrame:
    """Rows whose (hash, bucket) the array marks; tested where they are read, nothing is moved."""
    sent = rows.sparkSession.sparkContext.broadcast(array)
    bits = len(array) * 8
    schema = rows.schema
    at = len(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for b in batches:
            g = b.column(at).to_numpy().view(np.uint64)
            a, step = g & np.uint64(0xFFFFFFFF), (g >> np.uint64(32)) | np.uint64(1)
            on = np.ones(len(g), bool)
            for i in range(SUSPECT_PROBES):
                p = ((a + step * np.uint64(i)) & np.uint64(bits - 1)).astype(np.int64)
                on &= ((held[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)
            if on.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(on)) for c in b.columns[:at]], names=schema.names)

    return rows.withColumn("__g", F.xxhash64("h", "bucket")).mapInArrow(run, schema)


def _verified(possible: DataFrame, ids: list[str], delivery: str) -> DataFrame:
    """Deliveries of the possible repeats beyond the one kept of each full identifier. Keepers are a combining minimum and are taken off
    by their delivery number, so copies of a hot identifier never meet."""
    held = cut_lineage(possible.drop("h", "bucket"))
    keep = held.groupBy(*ids).agg(F.min(F.struct(F.col("__t").isNull(), "__t", "__d")).getField("__d").alias("__d"))
    return held.select("__d").distinct().join(keep.select("__d"), "__d", "left_anti").select(F.col("__d").alias(delivery))


def surplus(df: DataFrame, identity: list[Column], delivery: str, delivered: str, bucket_s: int = 7 * 86_400) -> DataFrame:
    """Deliveries (column `delivery`, distinct) beyond the one kept of each identifier.

    Kept is the earliest `delivered` (null last), then the smallest `delivery`. The first part of the identity may be null
    and is then a value; a null in any other part means the row has no identifier and is never surplus. Rows without a
    delivery number can be neither reported nor kept. Rows without a time have a bucket of their own. Rows stored twice
    with one delivery number are one delivery. An empty table gives an empty result.

    The table is read twice: for the packed hashes, and for the rows that the array of possible repeats lets through; only these
    are shuffled. Hashes or filters that collide let more rows through, nothing else.
    """
    base, ids = _identified(df, identity, delivery, delivered, bucket_s)
    array, _ = _marked(_screened(base, _slices(base)))
    return _verified(_passing(base, array), ids, delivery)


def exactly_once(df: DataFrame, identity: list[Column], delivery: str, delivered: str, bucket_s: int = 7 * 86_400) -> DataFrame:
    """The input without surplus deliveries. Rows without an identifier or a delivery number all stay; a row stored twice stays once."""
    drop = surplus(df, identity, delivery, delivered, bucket_s).select(F.col(delivery).alias("__drop"))
    return df.distinct().join(drop, F.col(delivery) == F.col("__drop"), "left_anti")


class DeliveryStore:
    """Exactly-once intake, batch by batch, in a shared folder.

    ``ids/batch=<token>/bucket=<b>/`` holds the identifiers of each batch by time bucket, ``filters/batch=<token>/`` the Bloom filters it
    changed (per slice of the hash space and bucket, the newest counts), ``commits/<number>.json`` the batches that count. A batch that
    dies before its commit is invisible, and is written over when it is tried again.
    """

    def __init__(self, spark: SparkSession, root: str, slices: int = 64, bucket_s: int = 7 * 86_400):
        self.spark, self.root, self.files, self.bucket_s = spark, root.rstrip("/"), Files(spark), bucket_s
        done = self.files.names(f"{self.root}/commits")
        self.commits = [json.loads(self.files.read(f"{self.root}/commits/{n}")) for n in done]
        self.slices = self.commits[0]["slices"] if self.commits else slices

    def _filters(self) -> DataFrame:
        schema = T.StructType([*_PACKED.fields, T.StructField("batch", T.StringType())])
        if not self.commits:
            return self.spark.createDataFrame([], _PACKED)
        order = F.create_map(*[F.lit(x) for n, c in enumerate(self.commits) for x in (c["token"], n)])
        read = self.spark.read.schema(schema).option("basePath", f"{self.root}/filters").parquet(*[f"{self.root}/filters/batch={c['token']}" for c in self.commits])
        return read.groupBy("slice", "kind", "bucket").agg(F.max_by("payload", order[F.col("batch")]).alias("payload"))

    def add(self, batch: DataFrame, identity: list[Column], delivery: str, delivered: str, token: str) -> DataFrame:
        """Take a batch in; the surplus deliveries among the identifiers it repeats, earlier batches' included (a copy that was
        delivered before the one kept so far makes that one surplus). A delivery once surplus stays so, so the results of all
        batches together are those of one table. A token already taken in changes nothing and gives nothing."""
        base, ids = _identified(batch, identity, delivery, delivered, self.bucket_s)
        if any(c["token"] == token for c in self.commits):
            return base.limit(0).select(F.col("__d").alias(delivery))
        screened = _screened(base, self.slices, self._filters())
        at = f"{self.root}/ids/batch={token}"
        base.write.mode("overwrite").partitionBy("bucket").parquet(at)
        screened.where(F.col("kind") == _FILTER).write.mode("overwrite").parquet(f"{self.root}/filters/batch={token}")
        array, n = _marked(screened)
        matching = [r.bucket for r in screened.where(F.col("kind") == _SUSPECTS).select("bucket").distinct().collect()]  # calendar weeks
        paths = [f"{self.root}/ids/batch={c['token']}" for c in self.commits if self.files.data_files(f"{self.root}/ids/batch={c['token']}")] + ([at] if self.files.data_files(at) else [])
        if n:
            stored = self.spark.read.schema(base.schema).option("basePath", f"{self.root}/ids").parquet(*paths)
            found = cut_lineage(_verified(_passing(stored.where(F.col("bucket").isin(matching)), array), ids, delivery))
        else:
            found = self.spark.createDataFrame([], T.StructType([T.StructField(delivery, base.schema["__d"].dataType)]))
        entry = {"token": token, "slices": self.slices}
        if not self.files.put_new(f"{self.root}/commits/{len(self.commits):012d}.json", json.dumps(entry)):
            raise RuntimeError("another batch was committed meanwhile; open the store again")
        self.commits.append(entry)
        return found
