"""A source as a keyed log: dense offsets per key, in a declared order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.errors import SourceError
from rillflow.operators.scan import Running, ranged, running
from rillflow.types import conform

STRETCH_S = 7 * 86_400


def stretch_of(timestamp: str = "_timestamp", seconds: int = STRETCH_S):
    return F.coalesce(F.floor(F.unix_micros(F.col(timestamp).cast("timestamp")) / F.lit(seconds * 1_000_000)), F.lit(-(1 << 40)))


def largest_key(df: DataFrame, key: str) -> int:
    """Rows of the key that has most. Counts combine on the map side; one row comes to the driver."""
    return df.where(F.col(key).isNotNull()).groupBy(key).count().agg(F.max("count")).first()[0] or 0


def as_log(df: DataFrame, fields: dict[str, str], key: str, order_by: list[str], timestamp: str | None = None, stretch_s: int = STRETCH_S, stretched: bool = True) -> DataFrame:
    """Declared fields in alphabetical order, cast to their types, with `_offset`, `_timestamp` and `_stretch`.

    Offsets count from 0 without holes, in the order of `order_by` (nulls first); rows that tie are ordered by a hash of their
    declared fields, and rows equal in all of these are records of their own. Rows with a null key belong to no partition
    and are left out. Columns that aren't declared are left out, whatever their names. `_timestamp` is `timestamp`, else the first
    ordering column if that is a date or time, else null; `_arrival` is the same. With `stretched`, a key is cut into stretches: of that
    time where it leads the order, else of the range-sorted rows; without, each key is one window.
    """
    if missing := {*fields, *order_by, *([timestamp] if timestamp else [])} - set(df.columns):
        raise SourceError(f"the source lacks {sorted(missing)}")
    first = df.schema[order_by[0]].dataType if order_by else None
    at = timestamp or (order_by[0] if isinstance(first, (T.TimestampType, T.TimestampNTZType, T.DateType)) else None)
    stamped = df.select(
        *[conform(f, fields[f]) for f in sorted(fields)],
        *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order_by)],
        (F.col(at).cast("timestamp_ntz") if at else F.lit(None).cast("timestamp_ntz")).alias("_timestamp"),
    ).where(F.col(key).isNotNull())
    # A stretch must rise with the order, so it may only come from a time that leads the order.
    leads = stretched and bool(order_by) and at == order_by[0]
    stamped = stamped.withColumn("_stretch", stretch_of(seconds=stretch_s) if leads else F.lit(0).cast("bigint")).withColumn("__tie", F.xxhash64(*sorted(fields)))
    order = [*[f"__o{i}" for i in range(len(order_by))], "__tie"]
    if stretched and not leads:
        stamped = ranged(stamped, key, order)
    out = running(stamped, [key], order, [Running("__n", "count", F.lit(1))], "_stretch" if stretched else None)
    return out.select(*sorted(fields), (F.col("__n") - 1).alias("_offset"), "_timestamp", F.col("_timestamp").alias("_arrival"), "_stretch")
