"""References to records that do not exist, from signed change deltas.

Every reference is a +1 reference delta of its key. Every change of a key becomes a signed existence delta against the key's
state before it: +1 if it comes to exist, -1 if it is deleted, 0 if nothing changes. Summed up in the order of time they say how many
references and how many existing records a key has: references > 0 and existence = 0 is an orphan.

`orphans` does it for whole tables. `ReferenceCounts` keeps the sums per key between runs: a run reads its new references
and changes, the counts of their keys, and nothing else of the past.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rillflow.files import Files
from rillflow.runtime import cut_lineage

#: Kinds of rows, in the order in which they are summed at one instant.
_CARRY, _CHANGE, _REFERENCE = 0, 1, 2
#: Per key, state after a run: references, existence, changes so far, and changes known whether or not they have a time.
COUNTS = "key string, n_refs bigint, existing bigint, n_changes bigint, n_known bigint"
_SUMS = ("n_refs", "existing", "n_changes", "n_known")


def _sorted_rows(refs: DataFrame, changes: DataFrame, counts: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """References, changes and, first of each key that changes at all, what the key carries in, range-sorted by key and time.

    Time and place in the order are part of the range, so even one key on one day fills as many tasks as it needs.
    """
    kept = [c for c in refs.columns if c not in ("key", "at")]
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    null = lambda t: F.lit(None).cast(t)
    payload = F.struct(*kept)
    r = refs.where("key is not null and at is not null").select("key", us("at").alias("at"), F.lit(_REFERENCE).alias("kind"), F.xxhash64(payload).alias("ordinal"), null("int").alias("alive"), F.lit(0).cast("bigint").alias("n_changes"), F.lit(1).cast("bigint").alias("n_refs"), payload.alias("ref"))
    held = changes.where("key is not null and alive is not null")
    c = held.where("at is not null").select("key", us("at").alias("at"), F.lit(_CHANGE).alias("kind"), F.col("ordinal").cast("bigint").alias("ordinal"), F.col("alive").cast("int").alias("alive"), F.lit(1).cast("bigint").alias("n_changes"), F.lit(0).cast("bigint").alias("n_refs"))
    # Changes of a key known at any time, those without a time and those to come included, tell a missing key from a late one.
    some = _known(held)
    if counts is not None:
        wanted = r.select("key").unionByName(some.select("key")).distinct()
        some = some.unionByName(counts.join(wanted, "key", "left_semi")).groupBy("key").agg(*[F.sum(x).alias(x) for x in _SUMS])
    known = some.select("key", F.lit(-(1 << 62)).alias("at"), F.lit(_CARRY).alias("kind"), F.lit(0).cast("bigint").alias("ordinal"), F.col("existing").cast("int").alias("alive"), "n_changes", "n_refs", "n_known")
    rows = r.unionByName(c, allowMissingColumns=True).unionByName(known, allowMissingColumns=True).withColumn("n_known", F.coalesce("n_known", F.lit(0)))
    order = ["key", "at", "kind", "ordinal"]
    tasks = max(int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")), refs.sparkSession.sparkContext.defaultParallelism)
    return cut_lineage(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)), kept


def _known(changes: DataFrame) -> DataFrame:
    """Each key that changes at all, as counts of which only the changes known aren't 0."""
    none = F.lit(0).cast("bigint")
    return changes.groupBy("key").agg(none.alias("n_refs"), none.alias("existing"), none.alias("n_changes"), F.count(F.lit(1)).alias("n_known"))


@dataclass
class _State:
    """Sums of one key up to a row: existence, and changes known, changes and references so far."""

    key: str
    alive: int
    known: int
    changes: int
    refs: int


def _running(b: pa.RecordBatch, state: _State | None):
    """Running sums of a sorted batch: first row of each key, existence before and after each row, changes and references up to it, changes known."""
    names = b.schema.names
    col = lambda c: b.column(names.index(c))
    n = b.num_rows
    codes = col("key").dictionary_encode().indices.to_numpy()
    fresh = np.ones(n, bool)
    fresh[1:] = codes[1:] != codes[:-1]
    fresh[0] = state is None or state.key != col("key")[0].as_py()
    first = np.flatnonzero(fresh)
    begin = np.zeros(n, np.int64)
    begin[first] = first
    np.maximum.accumulate(begin, out=begin)
    carried = np.zeros(n, bool)
    if not fresh[0]:
        carried[: first[0] if len(first) else n] = True
    kind = col("kind").to_numpy()
    sets = kind != _REFERENCE
    alive = np.where(sets, np.nan_to_num(col("alive").to_numpy(zero_copy_only=False).astype(float)), 0).astype(np.int64)
    last = np.where(sets, np.arange(n), -1)
    np.maximum.accumulate(last, out=last)
    inside = (last >= begin) & (last >= 0)
    after = np.where(inside, alive[np.maximum(last, 0)], np.where(carried, state.alive if state else 0, 0))
    before = np.empty(n, np.int64)
    before[1:] = np.where(fresh[1:], 0, after[:-1])
    before[0] = state.alive if carried[0] else 0
    before[kind == _CARRY] = alive[kind == _CARRY]

    def upto(c: str, start: int) -> np.ndarray:
        total = np.cumsum(col(c).to_numpy())
        return total - np.where(begin > 0, total[begin - 1], 0) + np.where(carried, start, 0)

    changes, refs, known = (upto(c, start) for c, start in zip(("n_changes", "n_refs", "n_known"), (state.changes, state.refs, state.known) if state else (0, 0, 0)))
    return fresh, before, after, changes, refs, known


def _end(b: pa.RecordBatch, found, state: _State | None) -> _State:
    _, _, after, changes, refs, known = found
    return _State(b.column(0)[-1].as_py(), int(after[-1]), int(known[-1]), int(changes[-1]), int(refs[-1]))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first, state, sets, whole = None, None, False, True
    for b in batches:
        if not b.num_rows:
            continue
        if first is None:
            first = b.column(0)[0].as_py()
        found = _running(b, state)
        kind = b.column(2).to_numpy()
        start = int(np.flatnonzero(found[0])[-1]) if found[0].any() else 0
        if found[0].any():
            sets = False
            whole = whole and state is None and start == 0
        sets = sets or bool((kind[start:] != _REFERENCE).any())
        state = _end(b, found, state)
    if state is not None:
        yield pa.RecordBatch.from_pydict({"pid": [TaskContext.get().partitionId()], "facts": [pickle.dumps((first, whole, sets, state))]}, schema=pa.schema([("pid", pa.int32()), ("facts", pa.binary())]))


def carry(facts: list[tuple[int, tuple]]) -> dict[int, _State | None]:
    """State carried into each partition, from one summary a partition, in their order."""
    out: dict[int, _State | None] = {}
    state: _State | None = None
    for pid, (first, whole, sets, mine) in facts:
        before = out[pid] = state if state and state.key == first else None
        if whole and before is not None:  # one key, begun before
            mine = _State(first, mine.alive if sets else before.alive, mine.known + before.known, mine.changes + before.changes, mine.refs + before.refs)
        state = mine
    return out


def _scan(carried: dict[int, _State | None], ref: T.DataType):
    out = to_arrow_schema(_scanned(ref))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = carried.get(TaskContext.get().partitionId())
        for b in batches:
            if not b.num_rows:
                continue
            found = _running(b, state)
            _, before, after, changes, refs, known = found
            names = b.schema.names
            kind = b.column(names.index("kind")).to_numpy()
            orphan = np.flatnonzero((kind == _REFERENCE) & (refs > 0) & (after == 0))
            reason = np.where(known[orphan] == 0, 0, np.where(changes[orphan] == 0, 1, 2))
            # Signed deltas, added up per key of this batch.
            keys = b.column(0).dictionary_encode()
            code, size = keys.indices.to_numpy(), len(keys.dictionary)
            moved = np.where(kind == _CHANGE, after - before, 0)
            sums = [np.bincount(code, w, size).astype(np.int64) for w in (np.where(kind == _REFERENCE, 1, 0), moved, np.where(kind == _CHANGE, 1, 0))]
            some = np.flatnonzero((sums[0] != 0) | (sums[1] != 0) | (sums[2] != 0))
            at = pa.array(orphan)
            none = lambda n, f: pa.nulls(n, out.field(f).type)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(reason, pa.int32()), *(none(len(orphan), f) for f in ("n_refs", "existing", "n_changes")), b.column(names.index("ref")).take(at).cast(out.field("ref").type)], schema=out)
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(some)), none(len(some), "at"), none(len(some), "reason"), *(pa.array(s[some]) for s in sums), none(len(some), "ref")], schema=out)
            state = _end(b, found, state)

    return run


def _scanned(ref: T.DataType) -> T.StructType:
    longs = [T.StructField(c, T.LongType()) for c in ("n_refs", "existing", "n_changes")]
    return T.StructType([T.StructField("key", T.StringType()), T.StructField("at", T.LongType()), T.StructField("reason", T.IntegerType()), *longs, T.StructField("ref", ref)])


def _run(refs: DataFrame, changes: DataFrame, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Orphans among the references, with reason, and the signed deltas of each key, added up."""
    rows, kept = _sorted_rows(refs, changes, counts)
    found = rows.mapInArrow(_summaries, "pid int, facts binary").collect()  # a row a partition
    carried = carry([(r.pid, pickle.loads(bytes(r.facts))) for r in sorted(found, key=lambda r: r.pid)])
    scanned = cut_lineage(rows.mapInArrow(_scan(carried, rows.schema["ref"].dataType), _scanned(rows.schema["ref"].dataType)))
    reason = F.element_at(F.array(*map(F.lit, ("missing", "late", "deleted"))), F.col("reason") + 1)
    orphan = scanned.where("reason is not null").select("key", F.timestamp_micros("at").cast("timestamp_ntz").alias("at"), *[F.col("ref").getField(c).alias(c) for c in kept], reason.alias("reason"))
    deltas = scanned.where("reason is null").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_refs", "existing", "n_changes")])
    return orphan, deltas


def orphans(refs: DataFrame, changes: DataFrame) -> DataFrame:
    """References whose key isn't there at their time, with `reason`: missing, late or deleted.

    refs: (key, at, ...); changes: (key, at, ordinal, alive 0/1). A reference is an orphan where, summed up to its time, its key has
    references (itself at least) and no existence; a change at the same instant counts, and of changes of one instant the greatest ordinal is
    the last, and one whose `alive` is null says nothing. `missing`: the key never has a change, at any time or none; `late`: only later; `deleted`: it had. References with a
    null key or time have no row; repeated rows count each. Empty tables give an empty result.

    The rows are range-sorted by key and time over all tasks, and each task sums on from what the tasks before it left, of
    which one row a task comes to the driver. So a key may have any number of rows, on one day or at one instant.
    """
    return _run(refs, changes)[0]


def current_orphans(refs: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    """Keys that have references but don't exist after all changes: (by..., key, n_refs), from the signed counts per key.

    References are counted by key and `by` before they meet the key's counts, which are one row. Null keys are no references; changes without
    a time don't count.
    """
    timed = refs.where("key is not null").withColumn("at", F.lit("9999-01-01").cast("timestamp_ntz"))
    counts = _run(timed.select("key", "at", F.lit(0).alias("__none")).groupBy("key", "at").agg(F.first("__none").alias("__none")), changes.where("at is not null"))[1]
    gone = counts.where("n_refs > 0 and existing = 0").select("key")
    return refs.where("key is not null").groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n_refs")).join(gone, "key", "left_semi").select(*by, "key", "n_refs")


class ReferenceCounts:
    """Signed counts per key and the orphans found so far, kept in a shared folder from run to run.

    A run takes references and changes that arrived after those of the runs before it (within a run any order). It writes
    ``counts/<token>`` and ``orphans/<token>`` and commits last, so that a run that dies is invisible and may be tried again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.runs = [json.loads(self.files.read(f"{self.root}/runs/{n}")) for n in self.files.names(f"{self.root}/runs")]

    def counts(self) -> DataFrame:
        """key, n_refs, existing, n_changes: the sums of all deltas."""
        if not self.runs:
            return self.spark.createDataFrame([], COUNTS)
        return self.spark.read.schema(COUNTS).parquet(f"{self.root}/counts/{self.runs[-1]['token']}")

    def orphans(self) -> DataFrame | None:
        """All orphans so far; one that was missing is late once its key has had a change. None before the first run."""
        return self.spark.read.parquet(f"{self.root}/orphans/{self.runs[-1]['token']}") if self.runs else None

    def current(self) -> DataFrame:
        """Keys with references and no existence now."""
        return self.counts().where("n_refs > 0 and existing = 0")

    def run(self, refs: DataFrame, changes: DataFrame, token: str) -> None:
        """Apply new references and changes. A token applied before changes nothing."""
        if any(r["token"] == token for r in self.runs):
            return
        held = self.counts()
        found, deltas = _run(refs, changes, held)
        new = deltas.withColumn("n_known", F.lit(0).cast("bigint")).unionByName(_known(changes.where("key is not null and alive is not null")))
        held.unionByName(new).groupBy("key").agg(*[F.sum(c).alias(c) for c in _SUMS]).write.mode("overwrite").parquet(f"{self.root}/counts/{token}")
        if (old := self.orphans()) is not None:
            came = changes.where("key is not null and alive is not null").select(F.col("key").alias("__came")).distinct()
            settled, missing = old.where("reason <> 'missing'"), old.where("reason = 'missing'")
            turned = missing.join(came, F.col("key") == F.col("__came"), "left").withColumn("reason", F.when(F.col("__came").isNotNull(), "late").otherwise(F.col("reason"))).drop("__came")
            found = settled.unionByName(turned).unionByName(found)
        found.write.mode("overwrite").parquet(f"{self.root}/orphans/{token}")
        entry = {"token": token}
        if not self.files.put_new(f"{self.root}/runs/{len(self.runs):012d}.json", json.dumps(entry)):
            raise RuntimeError("another run was committed meanwhile; open the counts again")
        self.runs.append(entry)
