"""reduce: the running fold of each key; every step is a record."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rillflow.operators.map import SYSTEM
from rillflow.operators.scan import Running, running
from rillflow.types import conform, struct_type
from rillflow.udf import Fold, PyFold


def apply_reduce(df: DataFrame, fn: Fold | PyFold, key: str, fields: dict[str, str], stretched: bool = True) -> DataFrame:
    """out[0] = in[0]; out[n] = fn(out[n-1], in[n]), per key in offset order; same offsets.

    A Fold runs on window functions, with `stretched` inside stretches of a key, so hot keys are spread. A PyFold is sequential by nature:
    each key streams through one task, sorted, one record in memory; prefer a Fold where one key may be very large. Nulls
    don't move a Fold's sum, min, max, last or first. A log without rows gives none.
    """
    if isinstance(fn, Fold):
        values = [Running(f"__r_{c}", s, F.lit(1) if s == "count" else F.col(c)) for c, s in fn.steps.items()]
        out = running(df, [key], ["_offset"], values, "_stretch" if stretched else None)
        source = {c: F.col(f"__r_{c}") for c in fn.steps}
        return out.select(*[conform(f, fields[f], lambda n: source.get(n, F.col(n) if n in df.columns else F.lit(None))) for f in sorted(fields)], *SYSTEM)
    declared = struct_type(fields)
    out_type = T.StructType([*declared.fields, *(df.schema[c] for c in SYSTEM)])
    schema, call, names = to_arrow_schema(out_type), fn.fn, sorted(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                system = {c: r.pop(c) for c in SYSTEM}
                held = call(dict(held), r) if at is not None and at == (r[key],) else r
                at = (r[key],)
                rows.append({n: held.get(n) for n in names} | system)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return df.repartition(key).sortWithinPartitions(key, "_offset").mapInArrow(run, out_type)
