"""Type tags of declared schemas and the Spark types they stand for.

A tag must match whole (trailing text is an error). What Spark lacks is widened: unsigned integers to the next larger
type, float16 to float, times of day to nanoseconds as a long, nanosecond timestamps to microseconds.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.errors import TypeTagError

_PLAIN: dict[str, T.DataType] = {
    "string": T.StringType(),
    "large_string": T.StringType(),
    "bytes": T.BinaryType(),
    "large_bytes": T.BinaryType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "bool": T.BooleanType(),
    "date32": T.DateType(),
    "date64": T.TimestampNTZType(),
}
_UNSIGNED = {"uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64}


def parse_tag(tag: str) -> T.DataType:
    """Spark type of a tag; raises TypeTagError for an unknown one and for decimals beyond Spark's range."""
    t = tag.strip()
    if t in _PLAIN:
        return _PLAIN[t]
    if re.fullmatch(r"fixed_bytes\[\s*\d+\s*\]", t):
        return T.BinaryType()
    if m := re.fullmatch(r"decimal\[\s*(\d+)\s*,\s*(-?\d+)\s*(?:,\s*(128|256)\s*)?\]", t):
        p, s = int(m[1]), int(m[2])
        if not (1 <= p <= 38 and 0 <= s <= p):
            raise TypeTagError(f"{tag!r}: Spark holds decimals of 1 to 38 digits with a scale from 0 to the precision")
        return T.DecimalType(p, s)
    if re.fullmatch(r"time\[\s*(s|ms|us|ns)\s*\]", t):
        return T.LongType()
    if m := re.fullmatch(r"timestamp\[\s*(s|ms|us|ns)\s*(?:,\s*([^\]]+?)\s*)?\]", t):
        return T.TimestampType() if m[2] else T.TimestampNTZType()
    raise TypeTagError(f"unknown type tag {tag!r}")


def field(name: str, tag: str) -> T.StructField:
    """Nullable field of a declared schema; the tag and, for timestamps, the zone stand in the metadata."""
    zone = re.fullmatch(r"timestamp\[\s*\w+\s*,\s*([^\]]+?)\s*\]", tag.strip())
    return T.StructField(name, parse_tag(tag), True, {"tag": tag} | ({"zone": zone[1]} if zone else {}))


def struct_type(fields: dict[str, str]) -> T.StructType:
    """Declared schema, in alphabetical order, all fields nullable."""
    return T.StructType([field(n, fields[n]) for n in sorted(fields)])


def conform(name: str, tag: str, column: Callable[[str], Column] = F.col) -> Column:
    """The column cast to the declared type. A value that the type can't hold becomes null (as do negative values of
    unsigned types and byte strings of another length)."""
    c = column(name)
    kind = parse_tag(tag)
    out = c.cast(kind) if isinstance(kind, (T.BinaryType, T.BooleanType)) else c.try_cast(kind)
    if tag in _UNSIGNED:
        out = F.when(out.between(F.lit(0).cast(kind), F.lit(str(2 ** _UNSIGNED[tag] - 1)).cast(kind)), out)
    if m := re.fullmatch(r"fixed_bytes\[\s*(\d+)\s*\]", tag.strip()):
        out = F.when(F.octet_length(out) == int(m[1]), out)
    return out.alias(name)
