"""window: consecutive records of a key grouped by count (or, as an extension, by time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.operators.log import STRETCH_S, stretch_of


def window_ids(offset: Column, size: int, slide: int, closed_end: bool = False) -> tuple[Column, Column]:
    """First and last window that hold an offset. Window w starts at w*slide and holds `size` offsets, or one more with
    `closed_end` (its upper bound inclusive). With slide > size some offsets are in no window: then first > last."""
    span = size if closed_end else size - 1
    low = F.greatest(F.ceil((offset - F.lit(span)) / F.lit(slide)), F.lit(0))
    return low.cast("bigint"), F.floor(offset / F.lit(slide)).cast("bigint")


def assign(start: int, size: int, slide: int, closed_end: bool = False) -> list[tuple[int, int]]:
    """The windows (start, end as written: start + size) that hold an offset, newest first. Plain arithmetic, for tests and tools."""
    span = size if closed_end else size - 1
    low = max(-(-(start - span) // slide), 0)
    return [(w * slide, w * slide + size) for w in range(start // slide, low - 1, -1)]


def place_in_count_windows(df: DataFrame, size: int, slide: int, closed_end: bool = False) -> DataFrame:
    """Each record once for every window that holds it, with the window's number in `__w`."""
    low, high = window_ids(F.col("_offset"), size, slide, closed_end)
    if slide == size and not closed_end:
        return df.withColumn("__w", high)
    return df.where(low <= high).withColumn("__w", F.explode(F.sequence(low, high)))


def apply_count_window(df: DataFrame, key: str, fields: list[str], size: int, slide: int | None = None, closed_end: bool = False, stretch_s: int = STRETCH_S) -> DataFrame:
    """One record a window that holds at least one record: `_offset` (window number), window_start, window_end (offset after
    the last it may hold), first_offset, last_offset, `records` (in offset order), and the fields of its newest record.

    Open windows are there with what they hold. A group is never larger than the window, so no key gathers in one task;
    tumbling windows copy nothing, sliding ones copy a record once for each window that holds it. Null fields stay null.
    The stretch is that of the newest record, so it rises with the window number whatever orders the log; a log without
    stretches gets them from its time.
    """
    slide = slide or size
    if "_stretch" not in df.columns:
        df = df.withColumn("_stretch", stretch_of(seconds=stretch_s))
    placed = place_in_count_windows(df, size, slide, closed_end)
    rest = [c for c in fields if c != key]
    record = F.struct("_offset", *[F.col(c) for c in fields])
    out = placed.groupBy(key, "__w").agg(F.sort_array(F.collect_list(record)).alias("records"), F.max("_timestamp").alias("_timestamp"), F.max("_arrival").alias("_arrival"), F.max("_stretch").alias("_stretch"))
    newest = F.element_at("records", -1)
    span = size + 1 if closed_end else size
    return out.select(
        key,
        *[newest.getField(c).alias(c) for c in rest],
        F.col("__w").alias("_offset"),
        "_timestamp",
        "_arrival",
        (F.col("__w") * slide).alias("window_start"),
        (F.col("__w") * slide + span).alias("window_end"),
        F.col("records")[0]["_offset"].alias("first_offset"),
        newest["_offset"].alias("last_offset"),
        "records",
        "_stretch",
    )


def place_in_time_windows(df: DataFrame, size_us: int, slide_us: int) -> DataFrame:
    """Each record that has a time once for every window that holds it: `__start` and `__end` of the window, and its number in `__w`."""
    w = F.window("_timestamp", f"{size_us} microseconds", f"{slide_us} microseconds")
    placed = df.where("_timestamp is not null").withColumn("__win", w)
    start = F.col("__win.start")
    return placed.select(*df.columns, start.alias("__start"), F.col("__win.end").alias("__end"), F.floor(F.unix_micros(start.cast("timestamp")) / F.lit(slide_us)).alias("__w"))


def apply_timed_window(df: DataFrame, key: str, fields: list[str], size_us: int, slide_us: int, values: dict[str, Column] | None = None, stretch_s: int = STRETCH_S) -> DataFrame:
    """One record per key and time window over `_timestamp` that holds a record: `_offset` (the window's number, its start in
    slides since 1970), window_start, window_end, first_offset, last_offset, `n` records, the fields of the newest record (by
    time, then offset), and `values`, aggregates over the records. Rows without a time are in none.

    All of it combines on the map side, so a hot key's window gathers nowhere; the records themselves are read with
    `place_in_time_windows`. Streaming: see `streaming.stateful.stream_timed_window`.
    """
    rest = [c for c in fields if c != key]
    newest = F.max_by(F.struct(*[F.col(c) for c in rest], F.lit(0).alias("__filled")), F.struct("_timestamp", "_offset"))
    found = place_in_time_windows(df, size_us, slide_us).groupBy(key, "__w", "__start", "__end").agg(
        newest.alias("__newest"), F.max("_timestamp").alias("_timestamp"), F.max("_arrival").alias("_arrival"),
        F.min("_offset").alias("first_offset"), F.max("_offset").alias("last_offset"), F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in (values or {}).items()],
    )
    return found.select(
        key,
        *[F.col("__newest").getField(c).alias(c) for c in rest if c not in (values or {})],
        F.col("__w").alias("_offset"),
        "_timestamp",
        "_arrival",
        F.col("__start").alias("window_start"),
        F.col("__end").alias("window_end"),
        "first_offset",
        "last_offset",
        "n",
        *(values or {}),
        stretch_of("__start", stretch_s).alias("_stretch"),
    )
