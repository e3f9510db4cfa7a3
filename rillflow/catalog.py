"""The topography: all declared schemas, streams and storages, merged from configurations and kept on disk if wished."""

from __future__ import annotations

import json

from pyspark.sql import types as T

from rillflow import config as C
from rillflow.errors import ConfigurationError, CycleError, JoinError, OccupiedError, SchemaNotFound, StreamNotFound
from rillflow.files import LocalFiles
from rillflow.types import parse_tag, struct_type


class Topography:
    """Applying the same configuration again changes nothing; another definition under a taken name is refused, as a whole.

    With `path` (read and written through `files`, so it may lie in any store; else a local file), every accepted configuration and every drop
    is one JSON line there, and the next Topography on it has them again.
    """

    def __init__(self, path: str | None = None, files=None):
        self.config = C.Configuration()
        self.path, self.files = path, files or LocalFiles()
        self._lines: list[str] = []
        if path and self.files.exists(path):
            self._lines = [x for x in self.files.read(path).splitlines() if x.strip()]
            for unit in map(json.loads, self._lines):
                if "drop" in unit:
                    self._drop(unit["drop"])
                else:
                    self._merge(C.parse(unit["toml"]))

    def _keep(self, unit: dict) -> None:
        if self.path:
            self._lines.append(json.dumps(unit))
            self.files.replace(self.path, "\n".join(self._lines) + "\n")

    def apply(self, toml: str) -> list[str]:
        """Merge a configuration; gives the names of the streams it added."""
        before = self.to_toml()
        added = self._merge(new := C.parse(toml))
        if self.to_toml() != before:
            self._keep({"toml": C.dump(new)})
        return added

    def _merge(self, new: C.Configuration) -> list[str]:
        now = self.config
        for kind, mine, theirs in (("schema", now.schemas, new.schemas), ("stream", now.streams, new.streams)):
            for name, what in theirs.items():
                if name in mine and mine[name] != what:
                    raise OccupiedError(f"{kind} {name!r} exists with another definition")
        merged = C.Configuration({**now.streams, **new.streams}, {**now.schemas, **new.schemas}, {**now.storage, **new.storage})
        self._validate(merged)
        added = [n for n in new.streams if n not in now.streams]
        self.config = merged
        return added

    @staticmethod
    def _validate(c: C.Configuration) -> None:
        for fields in c.schemas.values():
            for tag in fields.values():
                parse_tag(tag)
        for s in c.streams.values():
            if s.schema not in c.schemas:
                raise SchemaNotFound(f"stream {s.name!r}: no schema {s.schema!r}")
            if s.partition_key not in c.schemas[s.schema]:
                raise ConfigurationError(f"stream {s.name!r}: its schema has no field {s.partition_key!r}")
            for i in s.inputs:
                if i not in c.streams:
                    raise StreamNotFound(f"stream {s.name!r}: no stream {i!r} to derive from")
            if s.kind == "join":
                mapping = {k: v.split(".") for k, v in s.mapping}
                good = {k: v[:2] for k, v in mapping.items() if len(v) >= 2}
                if missing := set(c.schemas[s.schema]) - set(good):
                    raise JoinError(f"stream {s.name!r}: fields without a mapping: {sorted(missing)}")
                for k, (side, column) in good.items():
                    if k in c.schemas[s.schema] and (side not in s.inputs or column not in c.schemas[c.streams[side].schema]):
                        raise JoinError(f"stream {s.name!r}: {k!r} is mapped from {side}.{column}, which isn't there")
        Topography._order(c)

    @staticmethod
    def _order(c: C.Configuration) -> list[str]:
        done: list[str] = []
        open_: set[str] = set()

        def visit(n: str) -> None:
            if n in done:
                return
            if n in open_:
                raise CycleError(f"stream {n!r} is derived from itself")
            open_.add(n)
            for i in c.streams[n].inputs:
                visit(i)
            done.append(n)

        for n in sorted(c.streams):
            visit(n)
        return done

    def order(self) -> list[str]:
        """All streams, each after those it is derived from."""
        return self._order(self.config)

    def stream(self, name: str) -> C.StreamSpec:
        if name not in self.config.streams:
            raise StreamNotFound(f"no stream {name!r}")
        return self.config.streams[name]

    def fields(self, name: str) -> dict[str, str]:
        return self.config.schemas[self.stream(name).schema]

    def struct(self, name: str) -> T.StructType:
        return struct_type(self.fields(name))

    def storage(self) -> C.StorageSpec | None:
        """The storage in force: the alphabetically first."""
        return self.config.storage[min(self.config.storage)] if self.config.storage else None

    def children(self, name: str) -> list[str]:
        return [s.name for s in self.config.streams.values() if name in s.inputs]

    def drop_stream(self, name: str) -> None:
        """Forget a stream. Refused while others are derived from it."""
        self.stream(name)
        if used := self.children(name):
            raise ConfigurationError(f"stream {name!r} is the base of {used}")
        self._drop(name)
        self._keep({"drop": name})

    def _drop(self, name: str) -> None:
        self.config = C.Configuration({k: v for k, v in self.config.streams.items() if k != name}, self.config.schemas, self.config.storage)

    def to_toml(self) -> str:
        return C.dump(self.config)
