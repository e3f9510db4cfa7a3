"""Configurations: TOML to dataclasses, and back."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field

from rillflow.errors import ConfigurationError, JoinError, WindowError

KINDS = ("map", "reduce", "join", "window")
RESERVED = ("_offset", "_timestamp", "_arrival", "_stretch", "bucket", "commit")
_UNIT_US = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


@dataclass(frozen=True)
class WindowSpec:
    """interval and slide as written; a unit makes the window timed, a bare number counts records."""

    interval: str
    slide: str | None = None
    kind: str = "count"
    closed_end: bool = False

    @property
    def timed(self) -> bool:
        return not self.interval.strip().isdigit()

    def sizes(self) -> tuple[int, int]:
        """Size and slide: records, or microseconds for a timed window. The slide is the size where it isn't given."""
        size = parse_interval(self.interval)
        slide = size if self.slide is None else parse_interval(self.slide)
        if size[1] != slide[1]:
            raise WindowError(f"interval {self.interval!r} and slide {self.slide!r} don't measure the same")
        return size[0], slide[0]


def parse_interval(text: str) -> tuple[int, bool]:
    """'5' -> (5, False); '2h' -> (microseconds, True)."""
    m = re.fullmatch(r"\s*(\d+)\s*(us|ms|s|m|h|d)?\s*", str(text))
    if not m or int(m[1]) < 1:
        raise WindowError(f"can't read the interval {text!r}")
    return (int(m[1]) * _UNIT_US[m[2]], True) if m[2] else (int(m[1]), False)


@dataclass(frozen=True)
class StreamSpec:
    name: str
    schema: str
    partition_key: str
    base: str | None = None
    kind: str | None = None
    join: tuple[str, ...] = ()
    mapping: tuple[tuple[str, str], ...] = ()
    function: str | None = None
    window: WindowSpec | None = None

    @property
    def inputs(self) -> tuple[str, ...]:
        """Streams this one is derived from: for a join the base (if any) and the joined streams, each once, in that order."""
        if self.kind == "join":
            return tuple(dict.fromkeys([*([self.base] if self.base else []), *self.join]))
        return (self.base,) if self.base else ()

    def check(self) -> None:
        if self.kind is None:
            if self.base or self.join or self.function or self.window:
                raise ConfigurationError(f"stream {self.name!r} is derived but has no type")
            return
        if self.kind == "aggregate":
            raise ConfigurationError(f"stream {self.name!r}: aggregate streams aren't offered; take the latest record of a reduce")
        if self.kind not in KINDS:
            raise ConfigurationError(f"stream {self.name!r}: unknown type {self.kind!r}")
        if self.kind == "join":
            if not self.join:
                raise JoinError(f"stream {self.name!r} joins nothing")
            if not self.mapping:
                raise JoinError(f"stream {self.name!r} has no mapping")
        elif not self.base:
            raise ConfigurationError(f"stream {self.name!r} has no base")
        if self.kind in ("map", "reduce") and not self.function:
            raise ConfigurationError(f"stream {self.name!r} names no function")
        if self.kind == "window":
            if self.window is None:
                raise WindowError(f"stream {self.name!r} has no window")
            self.window.sizes()


@dataclass(frozen=True)
class StorageSpec:
    name: str
    kind: str
    options: tuple[tuple[str, str], ...] = ()

    def spark_conf(self) -> dict[str, str]:
        """Hadoop settings of an s3 storage (for the s3a connector, if the session has it)."""
        o, conf = dict(self.options), {}
        names = {"aws_access_key_id": "access.key", "aws_secret_access_key": "secret.key", "aws_endpoint": "endpoint", "aws_region": "endpoint.region", "aws_token": "session.token"}
        for k, v in names.items():
            if o.get(k):
                conf[f"fs.s3a.{v}"] = o[k]
        if str(o.get("aws_allow_http", "")).lower() == "true":
            conf["fs.s3a.connection.ssl.enabled"] = "false"
        return conf

    def path(self) -> str | None:
        """Where records are kept: None for memory."""
        o = dict(self.options)
        return {"memory": None, "file": o.get("path", "data"), "s3": f"s3a://{o.get('bucket_name', '')}"}[self.kind]


@dataclass
class Configuration:
    streams: dict[str, StreamSpec] = field(default_factory=dict)
    schemas: dict[str, dict[str, str]] = field(default_factory=dict)
    storage: dict[str, StorageSpec] = field(default_factory=dict)


def _one_line_tables(text: str) -> str:
    """Inline tables that run over several lines, put on one: TOML 1.0 parsers refuse them."""
    out, depth, quote = [], 0, ""
    i = 0
    while i < len(text):
        ch = text[i]
        if quote:
            out.append(ch)
            if ch == "\\" and quote == '"':
                out.append(text[i + 1 : i + 2])
                i += 1
            elif ch == quote:
                quote = ""
        elif ch in "\"'":
            quote = ch
            out.append(ch)
        elif ch == "#":
            while i < len(text) and text[i] != "\n":
                i += 1
            continue
        else:
            depth += (ch == "{") - (ch == "}")
            out.append(" " if ch == "\n" and depth > 0 else ch)
        i += 1
    return re.sub(r",(\s*)\}", r"\1}", "".join(out))


def parse(text: str) -> Configuration:
    """Configuration from TOML. Blocks: storage.<name>, schema.<name>, streams.<name>; other blocks are errors."""
    try:
        raw = tomllib.loads(_one_line_tables(text))
    except tomllib.TOMLDecodeError as e:
        raise ConfigurationError(f"not a TOML configuration: {e}") from e
    if unknown := set(raw) - {"streams", "schema", "storage"}:
        raise ConfigurationError(f"unknown blocks: {', '.join(sorted(unknown))}")
    out = Configuration()
    for name, fields in raw.get("schema", {}).items():
        if not isinstance(fields, dict) or not all(isinstance(v, str) for v in fields.values()):
            raise ConfigurationError(f"schema {name!r} must map field names to type tags")
        if clash := set(fields) & set(RESERVED):
            raise ConfigurationError(f"schema {name!r}: reserved field names {sorted(clash)}")
        out.schemas[name] = dict(fields)
    for name, s in raw.get("storage", {}).items():
        if s.get("type") not in ("memory", "file", "s3"):
            raise ConfigurationError(f"storage {name!r}: unknown type {s.get('type')!r}")
        out.storage[name] = StorageSpec(name, s["type"], tuple((k, str(v)) for k, v in s.items() if k != "type"))
    for name, s in raw.get("streams", {}).items():
        if not isinstance(s, dict) or "schema" not in s or "partition_key" not in s:
            raise ConfigurationError(f"stream {name!r} needs a schema and a partition_key")
        join = s.get("join", [])
        if not isinstance(join, list):
            raise ConfigurationError(f"stream {name!r}: join must be a list of stream names")
        w = s.get("window")
        window = WindowSpec(str(w["interval"]), None if w.get("slide") is None else str(w["slide"]), w.get("type", "count"), bool(w.get("closed_end", False))) if w and "interval" in w else None
        spec = StreamSpec(name, s["schema"], s["partition_key"], s.get("base"), s.get("type"), tuple(join), tuple(sorted(s.get("map", {}).items())), s.get("fn"), window)
        spec.check()
        out.streams[name] = spec
    return out


def dump(config: Configuration) -> str:
    """TOML that parses to the same configuration."""
    q = json.dumps
    lines: list[str] = []
    for name in sorted(config.storage):
        s = config.storage[name]
        lines += [f"[storage.{q(name)}]", f"type = {q(s.kind)}", *(f"{k} = {q(v)}" for k, v in s.options), ""]
    for name in sorted(config.schemas):
        lines += [f"[schema.{q(name)}]", *(f"{q(k)} = {q(v)}" for k, v in sorted(config.schemas[name].items())), ""]
    for name in sorted(config.streams):
        s = config.streams[name]
        lines += [f"[streams.{q(name)}]", f"schema = {q(s.schema)}", f"partition_key = {q(s.partition_key)}"]
        lines += [f"{k} = {q(v)}" for k, v in (("base", s.base), ("type", s.kind), ("fn", s.function)) if v]
        if s.join:
            lines.append(f"join = [{', '.join(map(q, s.join))}]")
        if s.mapping:
            lines.append("map = { " + ", ".join(f"{q(k)} = {q(v)}" for k, v in s.mapping) + " }")
        if w := s.window:
            parts = [f"type = {q(w.kind)}", f"interval = {q(w.interval)}", *([f"slide = {q(w.slide)}"] if w.slide else []), *(["closed_end = true"] if w.closed_end else [])]
            lines.append("window = { " + ", ".join(parts) + " }")
        lines.append("")
    return "\n".join(lines)
