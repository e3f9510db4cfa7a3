"""Column expressions for keys, identifiers and record content.

All are built-in functions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_key(col: Column | str) -> Column:
    """Key value without the NUL filling of its fixed-width wire form. Null stays null; letter case counts."""
    c = F.col(col) if isinstance(col, str) else col
    return F.rtrim(c, F.lit("\0"))


def person_id(col: Column | str) -> Column:
    """Identifier compared without surrounding white space and letter case; blank and null give null."""
    c = F.col(col) if isinstance(col, str) else col
    bare = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(bare != "", bare)


def json_content(col: Column | str) -> Column:
    """JSON text in a canonical form: field order and spacing are no content. Text that isn't JSON stays as it is."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.try_parse_json(c).cast("string"), c)


def state_name(col: Column | str) -> Column:
    """Run state compared without letter case and spaces."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.regexp_replace(c, r"\s+", ""))
