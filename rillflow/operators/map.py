"""map: one record in, one record out, same key and offset."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rillflow.errors import RillError
from rillflow.types import conform
from rillflow.udf import ArrowMap, ColumnMap

SYSTEM = ("_offset", "_timestamp", "_arrival", "_stretch")


def apply_map(df: DataFrame, fn: ColumnMap | ArrowMap, fields: dict[str, str]) -> DataFrame:
    """The mapped log, with the declared `fields`. Nulls reach the function as they are; fields that neither the function
    nor the base has are null. Works on batch and streaming DataFrames; nothing is shuffled."""
    if isinstance(fn, ColumnMap):
        base = [c for c in df.columns if c not in SYSTEM]
        out = fn.fn({c: F.col(c) for c in base})
        made = {**{c: F.col(c) for c in base}, **out}
        system = [c for c in SYSTEM if c in df.columns]
        return df.select(*[conform(f, fields[f], lambda n: made.get(n, F.lit(None))) for f in sorted(fields)], *system)
    system = [c for c in SYSTEM if c in df.columns]
    from rillflow.types import struct_type

    out_type = T.StructType([*struct_type(fields).fields, *(df.schema[c] for c in system)])
    schema = to_arrow_schema(out_type)
    call = fn.fn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            given = call(pa.RecordBatch.from_arrays([v for n, v in held.items() if n not in SYSTEM], names=[n for n in held if n not in SYSTEM]))
            if given.num_rows != b.num_rows:
                raise RillError(f"a map must give one row for each row: {b.num_rows} in, {given.num_rows} out")
            held |= {n: given.column(i) for i, n in enumerate(given.schema.names) if n not in SYSTEM}
            yield pa.RecordBatch.from_arrays([held[f.name].cast(f.type) if f.name in held else pa.nulls(b.num_rows, f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, out_type)
