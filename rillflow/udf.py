"""Functions that map and reduce streams name.

A map is a function from columns to columns (stays in generated code) or from an Arrow batch to an Arrow batch. A
reduce is a fold of named built-in steps per field, or a function of two records.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column

from rillflow.errors import FunctionNotFound, RillError

STEPS = ("sum", "min", "max", "count", "last", "first")


@dataclass(frozen=True)
class ColumnMap:
    """fn({field: Column}) -> {field: Column}; fields it doesn't name keep their value."""

    fn: Callable[[dict[str, Column]], dict[str, Column]]


@dataclass(frozen=True)
class ArrowMap:
    """fn(RecordBatch) -> RecordBatch with as many rows, in the same order; fields it doesn't give keep their value."""

    fn: Callable[[pa.RecordBatch], pa.RecordBatch]


@dataclass(frozen=True)
class Fold:
    """{field: step}, the steps being sum, min, max, count, last and first; other fields keep the current record's value.

    Nulls don't change a sum, minimum, maximum, last or first; count counts records, from 1.
    """

    steps: dict[str, str]

    def __post_init__(self):
        if bad := {s for s in self.steps.values() if s not in STEPS}:
            raise RillError(f"unknown fold steps {sorted(bad)}")


@dataclass(frozen=True)
class PyFold:
    """fn(previous result: dict, current record: dict) -> dict. The first record of a key passes through uncalled."""

    fn: Callable[[dict, dict], dict]


class Registry:
    def __init__(self):
        self._held: dict[str, ColumnMap | ArrowMap | Fold | PyFold] = {}

    def register(self, name: str, fn: ColumnMap | ArrowMap | Fold | PyFold) -> None:
        """The latest registration of a name counts."""
        if not isinstance(fn, (ColumnMap, ArrowMap, Fold, PyFold)):
            raise RillError("wrap the function as ColumnMap, ArrowMap, Fold or PyFold")
        self._held[name] = fn

    def get(self, name: str, *kinds: type):
        if name not in self._held:
            raise FunctionNotFound(f"no function {name!r}")
        if not isinstance(self._held[name], kinds):
            raise FunctionNotFound(f"function {name!r} is a {type(self._held[name]).__name__}, not a {' or '.join(k.__name__ for k in kinds)}")
        return self._held[name]
