"""Per-key results when a few keys hold most rows: two-stage salted aggregation, in one pass over the table.

Which keys get a salt is learnt from a few files of the table. That choice only decides how even the work is: results are
whole whatever it misses. Shares and totals come out of the aggregation itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.runtime import cut_lineage

#: Of the table's files, one in so many (at least one, at most FILES) is read to find keys worth a salt.
ONE_IN, FILES = 16, 32


def salted_keys(df: DataFrame, keys: list[str], share: float) -> list[tuple]:
    """Keys to be salted: those with at least half of `share` among the rows of a few of the table's files, spread evenly over the list of
    them (all rows, where the table isn't read from files). At most 2/share keys can reach that."""
    files = sorted(df.inputFiles())
    some = files[:: max(1, min(ONE_IN, len(files)), len(files) // FILES)] if files else []
    some += [f.replace(":///", ":/", 1) for f in some]  # both ways in which paths without a host are written
    part = df.where(F.col("_metadata.file_path").isin(some)) if len(files) > 1 else df
    counts = cut_lineage(part.groupBy(*keys).count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    return [tuple(r[k] for k in keys) for r in counts.where(F.col("count") >= F.lit(share / 2) * total).select(*keys).collect()]


def salted_aggregate(df: DataFrame, keys: list[str], partial: dict[str, Column], merge: dict[str, Column], heavy: list[tuple], salts: int = 64, spread_by: Column | None = None) -> DataFrame:
    """Aggregate by key in two stages.

    Rows of heavy keys get a salt below `salts`, drawn by hashing `spread_by` (evenly, and the same again when a task is
    repeated; without it, the number of the task that reads the row); partial results are computed per key and salt by `partial`, then merged
    per key by `merge`, whose columns read those of `partial` (whose names must differ from the keys'). With `spread_by` a column, all its equal
    values share a salt, so that distinct counts of it may be added. Null keys are kept as a key of their own. Columns named ``__salt`` in the input are replaced.
    """
    spread = F.spark_partition_id() if spread_by is None else spread_by
    is_heavy = reduce(Column.__or__, [reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, h)]) for h in heavy], F.lit(False))
    salted = df.withColumn("__salt", F.when(is_heavy, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)))
    first = salted.groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])


def heavy_keys(df: DataFrame, keys: list[str], share: float, salts: int = 64) -> DataFrame:
    """(keys..., n_rows): keys with at least `share` of all rows. A null in a key part makes it no key, but its rows count in the total.

    The counts are the merged ones of the salted aggregation, and the total is their sum, so the table is read once (beside the
    few files of `salted_keys`). An empty table has none.
    """
    only = df.select(*keys)
    counts = cut_lineage(salted_aggregate(only, keys, {"__n": F.count(F.lit(1))}, {"n_rows": F.sum("__n")}, salted_keys(only, keys, share), salts))
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    return counts.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])).where(F.col("n_rows") >= F.lit(share) * F.lit(total))


def key_statistics(df: DataFrame, keys: list[str], record: str, arrived: str, share: float = 0.02, salts: int = 64) -> DataFrame:
    """Per key: stored rows, distinct records (values of `record`), first and last arrival.

    Rows whose key has a null part have no result. Null records are no records; null arrivals are passed over. An
    empty table gives an empty result.
    """
    keyed = df.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])).select(*keys, record, arrived)
    return salted_aggregate(
        keyed,
        keys,
        {"__n": F.count(F.lit(1)), "__d": F.count_distinct(F.col(record)), "__a": F.min(arrived), "__b": F.max(arrived)},
        {"n_rows": F.sum("__n"), "n_records": F.sum("__d"), "first_arrival": F.min("__a"), "last_arrival": F.max("__b")},
        salted_keys(keyed.select(*keys), keys, share),
        salts,
        F.col(record),
    )
