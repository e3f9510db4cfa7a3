"""Running results per key over a log of any length.

A log is cut into stretches by time (column `_stretch`, rising with the order of the log). Running values are computed
inside (key, stretch); what earlier stretches leave is one row per key and stretch, combined on the map side, carried
forward over stretches and joined back. So a key that holds a third of all rows fills many tasks, not one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.runtime import cut_lineage


@dataclass(frozen=True)
class Running:
    """A running value: op is count, sum, min, max, last or first (the last two over values that aren't null)."""

    name: str
    op: str
    value: Column


def _aggregate(r: Running, order: list[Column]) -> Column:
    at = F.struct(*order)
    kept = F.when(r.value.isNotNull(), at)
    return {
        "count": lambda: F.count(r.value),
        "sum": lambda: F.sum(r.value),
        "min": lambda: F.min(r.value),
        "max": lambda: F.max(r.value),
        "last": lambda: F.max_by(r.value, kept),
        "first": lambda: F.min_by(r.value, kept),
    }[r.op]()


def _over(op: str, value: Column, window) -> Column:
    f = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, True), "first": lambda c: F.first(c, True)}[op]
    return f(value).over(window)


def _combine(op: str, before: Column, here: Column) -> Column:
    if op in ("count", "sum"):
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
    return {"min": lambda: F.least(before, here), "max": lambda: F.greatest(before, here), "last": lambda: F.coalesce(here, before), "first": lambda: F.coalesce(before, here)}[op]()


def ranged(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`df` with a column `_stretch` that rises with the order of each key, whatever the order is: the number of the partition it falls
    into when the whole is range-sorted by key and order. Rows that tie in all of these share a stretch. The rows are checkpointed,
    since their partitions must stay as they are."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.drop("_stretch").repartitionByRange(tasks, key, *order).withColumn("_stretch", F.spark_partition_id().cast("bigint")))


def running(df: DataFrame, keys: list[str], order: list[str], values: list[Running], stretch: str | None = "_stretch") -> DataFrame:
    """`df` with a column per running value, the row itself included, in the order of `order` per key.

    `order` must be unique per key, else the rows tied get their values in any order. Null keys form a key. Without a
    stretch column the whole key is one window.
    """
    columns = [F.col(c) for c in order]
    if stretch is None:
        w = W.partitionBy(*keys).orderBy(*columns).rowsBetween(W.unboundedPreceding, 0)
        return df.select("*", *[_over(r.op, r.value, w).alias(r.name) for r in values])
    left = df.groupBy(*keys, stretch).agg(*[_aggregate(r, columns).alias(f"__{r.name}") for r in values])
    before = W.partitionBy(*keys).orderBy(stretch).rowsBetween(W.unboundedPreceding, -1)
    merge = {"count": "sum"}
    carried = left.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, stretch])], *[_over(merge.get(r.op, r.op), F.col(f"__{r.name}"), before).alias(f"__{r.name}") for r in values])
    on = None
    for i, k in enumerate([*keys, stretch]):
        same = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        on = same if on is None else on & same
    w = W.partitionBy(*keys, stretch).orderBy(*columns).rowsBetween(W.unboundedPreceding, 0)
    joined = df.join(carried, on, "left")
    return joined.select(*df.columns, *[_combine(r.op, F.col(f"__{r.name}"), _over(r.op, r.value, w)).alias(r.name) for r in values])
