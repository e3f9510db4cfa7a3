"""Overlapping and gapped intervals: continuous periods and the gaps between them.

The intervals are range-sorted by entity and start over all partitions, each partition is summed up in one row (first
and last entity, the last entity's open island), these summaries are combined from the first partition to the last,
and a second scan of the same partitions, starting from the carried state, writes periods and gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.runtime import cut_lineage


def _changes(table: pa.Table, entity: list[str], last: tuple | None) -> np.ndarray:
    """True where a row's entity differs from that of the row before it (the first row's: from `last`)."""
    n, out = table.num_rows, np.zeros(table.num_rows, bool)
    for c in entity:
        codes = pd.factorize(table.column(c).to_pandas(), use_na_sentinel=True)[0]
        out[1:] |= codes[1:] != codes[:-1]
    out[0] = last is None or tuple(table.column(c)[0].as_py() for c in entity) != last
    assert n == len(out)
    return out


def _islands(batch: pa.RecordBatch, entity: list[str], state: tuple | None):
    """Arrays of one sorted batch: new entity?, new island?, greatest end before the row (within its entity), island start.

    state: (entity values, island start, greatest end) of the row before the batch, or None.
    """
    table = pa.Table.from_batches([batch])
    start, end = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("__start", "__end"))
    fresh = _changes(table, entity, state[0] if state else None)
    if not fresh[0]:
        lead_start, lead_end = state[1], state[2]
    group = np.cumsum(fresh)
    ends = pd.Series(end)
    if not fresh[0]:
        ends.iloc[0] = max(end[0], lead_end)
    top = ends.groupby(group).cummax().to_numpy()
    before = np.empty_like(top)
    before[1:] = top[:-1]
    before[0] = lead_end if not fresh[0] else 0
    apart = ~fresh & (start > before)
    apart[apart] &= start[apart] - 1 > before[apart]
    new = fresh | apart
    origin = np.where(new, np.arange(len(start)), 0)
    np.maximum.accumulate(origin, out=origin)
    begun = start[origin]
    if not new[0]:
        begun[: int(np.argmax(new)) if new.any() else len(new)] = lead_start
    return fresh, new, before, begun, top


def _summaries(entity: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state, first = None, None
        for b in batches:
            if b.num_rows == 0:
                continue
            _, _, _, begun, top = _islands(b, entity, state)
            values = tuple(b.column(b.schema.get_field_index(c))[-1].as_py() for c in entity)
            if first is None:
                first = tuple(b.column(b.schema.get_field_index(c))[0].as_py() for c in entity)
            state = (values, int(begun[-1]), int(top[-1]))
        if state is not None:
            import pickle

            yield pa.RecordBatch.from_pydict({"pid": [TaskContext.get().partitionId()], "facts": [pickle.dumps((first, *state))]}, schema=pa.schema([("pid", pa.int32()), ("facts", pa.binary())]))

    return scan


def _rescan(entity: list[str], schema: pa.Schema, carried: dict, closes: dict):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        state = carried.get(pid)
        seen = False
        for b in batches:
            if b.num_rows == 0:
                continue
            seen = True
            fresh, new, before, begun, top = _islands(b, entity, state)
            cols = {c: b.column(b.schema.get_field_index(c)) for c in entity}
            start = b.column(b.schema.get_field_index("__start")).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.flatnonzero(new)
            gap = at[~fresh[at]]
            shut = at[at > 0]  # a period ends on the row before a new island
            parts = [_emit({c: v.take(pa.array(gap)) for c, v in cols.items()}, "gap", before[gap] + 1, start[gap] - 1, schema), _emit({c: v.take(pa.array(shut - 1)) for c, v in cols.items()}, "period", begun[shut - 1], top[shut - 1], schema)]
            if new[0] and state is not None:
                parts.append(_one(entity, state, schema))
            yield from (p for p in parts if p.num_rows)
            state = (tuple(v[-1].as_py() for v in cols.values()), int(begun[-1]), int(top[-1]))
        if seen and closes.get(pid):
            yield _one(entity, state, schema)

    return scan


def _emit(cols: dict, kind: str, a: np.ndarray, b: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [*(v.cast(schema.field(c).type) for c, v in cols.items()), pa.array([kind] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _one(entity: list[str], state: tuple, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array([v], schema.field(c).type) for c, v in zip(entity, state[0])]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(["period"]), pa.array([state[1]], pa.int64()), pa.array([state[2]], pa.int64())], schema=schema)


def combine(facts: list[tuple[int, tuple]]) -> tuple[dict, dict]:
    """Prefix-combine the summaries, in partition order.

    Gives per partition the state carried into it, and whether its last island ends with it. A partition that
    continues the entity before it takes over that entity's island if the two touch.
    """
    carried: dict[int, tuple | None] = {}
    closes: dict[int, bool] = {}
    state = None
    for i, (pid, (first, last, begun, top)) in enumerate(facts):
        carried[pid] = state if state and state[0] == first else None
        if i:
            closes[facts[i - 1][0]] = carried[pid] is None
        if carried[pid] is not None and first == last:
            _, cs, ce = state
            state = (last, cs if ce >= begun - 1 else begun, max(ce, top))
        else:
            state = (last, begun, top)
        closes[pid] = True
    return carried, closes


def periods_and_gaps(df: DataFrame, entity: list[str], start: str, end: str, names: tuple[str, str, str] = ("span_kind", "span_start", "span_end")) -> DataFrame:
    """Maximal covered runs (`period`) and the uncovered runs between two of them (`gap`) per entity; bounds are whole numbers, inclusive.

    Ranges that touch (0-4 and 5-9) are one period. A range with a null bound or with start > end covers nothing. Null
    entity values are values. Repeats and nesting change nothing; other columns are ignored; an empty table gives an
    empty result. An entity with any number of ranges is spread over as many partitions as it fills.

    To the driver goes one summary row a partition, nothing else. The sorted ranges are checkpointed, since both scans
    must see the same partitions.
    """
    rows = df.where((F.col(start) <= F.col(end))).select(*entity, F.col(start).cast("bigint").alias("__start"), F.col(end).cast("bigint").alias("__end")).distinct()
    order = [*entity, "__start", "__end"]
    ranged = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    import pickle

    found = ranged.mapInArrow(_summaries(entity), "pid int, facts binary").collect()
    carried, closes = combine([(r.pid, pickle.loads(bytes(r.facts))) for r in sorted(found, key=lambda r: r.pid)])
    out = T.StructType([*(ranged.schema[c] for c in entity), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    return ranged.mapInArrow(_rescan(entity, to_arrow_schema(out), carried, closes), out)
