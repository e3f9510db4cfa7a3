"""join: the latest record of every input for a key, at every arrival on any of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.operators.log import STRETCH_S, stretch_of
from rillflow.operators.map import SYSTEM
from rillflow.operators.scan import Running, running
from rillflow.types import conform


def apply_join(inputs: dict[str, tuple[DataFrame, str]], key: str, fields: dict[str, str], mapping: dict[str, str], lineage: bool = False, stretch_s: int = STRETCH_S, stretched: bool = True) -> DataFrame:
    """inputs: {stream: (log, its key column)}, in the order that breaks ties of time; mapping: {field: "stream.column"}.

    One record for each arrival on any input, with the latest record of each input for the key up to then; an input not
    yet seen gives nulls. A record is carried as a whole: a null in the newest record stays null. Arrivals are ordered by
    `_arrival` (nulls first), then by the inputs' order, then by offset. `lineage` adds `_src_offset_<stream>`. Mapping
    entries without a dot are ignored.

    One exchange over the union of the inputs, on the key or, with `stretched`, on (key, stretch of time): a hot key then
    spreads over its stretches.
    """
    pairs = {f: tuple(v.split(".")[:2]) for f, v in mapping.items() if "." in v}
    parts = []
    for i, (name, (df, k)) in enumerate(inputs.items()):
        wanted = sorted({c for s, c in pairs.values() if s == name})
        record = F.struct(F.col("_offset").alias("__offset"), *[F.col(c).alias(f"c_{c}") for c in wanted])
        parts.append(df.select(F.col(k).cast("string").alias("__key"), "_timestamp", "_arrival", F.lit(i).alias("__input"), F.col("_offset").alias("__from"), record.alias(f"__s{i}")))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("_stretch", stretch_of("_arrival", stretch_s))
    order = ["_arrival", "__input", "__from"]
    latest = [Running(f"__l{i}", "last", F.col(f"__s{i}")) for i in range(len(inputs))]
    out = running(union, ["__key"], order, [*latest, Running("__n", "count", F.lit(1))], "_stretch" if stretched else None)
    place = {name: i for i, name in enumerate(inputs)}

    def source(f: str):
        if f not in pairs:
            return F.col("__key") if f == key else F.lit(None)
        s, c = pairs[f]
        return F.col(f"__l{place[s]}").getField(f"c_{c}")

    offsets = [F.col(f"__l{i}").getField("__offset").alias(f"_src_offset_{name}") for name, i in place.items()] if lineage else []
    # A key column mapped from a side that hasn't been seen yet still holds the key the record belongs to.
    columns = [conform(f, fields[f], lambda n: F.coalesce(source(n), F.col("__key").try_cast(_type(fields[n]))) if n == key else source(n)) for f in sorted(fields)]
    return out.select(*columns, (F.col("__n") - 1).alias("_offset"), "_timestamp", "_arrival", "_stretch", *offsets)


def _type(tag: str):
    from rillflow.types import parse_tag

    return parse_tag(tag)


__all__ = ["apply_join", "SYSTEM"]
