"""Reading a log by key, offset and time. A filter on the key reaches the scan, since it is what windows partition by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at(df: DataFrame, key: str, value, offset: int) -> DataFrame:
    """The record at an offset: one row, or none if the offset is beyond the log."""
    return df.where((F.col(key) == F.lit(value)) & (F.col("_offset") == offset))


def between(df: DataFrame, first: int, last: int, key: str | None = None, value=None) -> DataFrame:
    """Records with offsets first to last, both inclusive, of one key or of all."""
    out = df.where(F.col("_offset").between(first, last))
    return out if value is None else out.where(F.col(key) == F.lit(value))


def latest(df: DataFrame, key: str, value=None) -> DataFrame:
    """The record with the highest offset of one key, or of each. Combines on the map side, whatever a key's size."""
    return _pick(df if value is None else df.where(F.col(key) == F.lit(value)), key, F.max_by)


def from_time(df: DataFrame, key: str, time, value=None) -> DataFrame:
    """The first record (by offset) not older than a time, of one key or of each; keys without one have no row. A time before
    the first record gives the first; records without a time aren't found."""
    kept = df.where(F.col("_timestamp") >= F.lit(time).cast("timestamp_ntz"))
    return _pick(kept if value is None else kept.where(F.col(key) == F.lit(value)), key, F.min_by)


def lookup(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The records at many (key, offset) pairs at once: wanted has the key column and `_offset`; repeats and nulls in it change nothing."""
    return df.join(wanted.select(key, "_offset").distinct(), [key, "_offset"], "left_semi").select(*df.columns)


def _pick(df: DataFrame, key: str, choose) -> DataFrame:
    return df.groupBy(F.col(key).alias("__key")).agg(choose(F.struct(*df.columns), "_offset").alias("r")).select("r.*")

