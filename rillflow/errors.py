"""Errors of the engine; all are plan-time or call-time, none is swallowed."""


class RillError(Exception):
    """Base of all errors raised here."""


class TypeTagError(RillError):
    """A schema names a type that doesn't exist or that Spark can't hold."""


class ConfigurationError(RillError):
    """A configuration can't be parsed or contradicts itself."""


class OccupiedError(ConfigurationError):
    """A stream or schema of that name exists with another definition."""


class SchemaNotFound(ConfigurationError):
    """A stream names a schema that isn't declared."""


class StreamNotFound(RillError):
    """No stream of that name."""


class CycleError(ConfigurationError):
    """Derived streams depend on each other."""


class FunctionNotFound(RillError):
    """A map or reduce names a function that isn't registered."""


class JoinError(ConfigurationError):
    """A join lacks inputs or a mapping, or maps a field that isn't there."""


class WindowError(ConfigurationError):
    """A window's interval or slide can't be read."""


class SourceError(RillError):
    """A base stream has no source, or its source lacks a declared column."""


class RecordNotFound(RillError):
    """No record at that offset, key or time."""


class SubscriptionError(RillError):
    """A subscription, or a key of it, doesn't exist, or an acknowledgement is refused."""
