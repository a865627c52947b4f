"""Errors by kind, so that callers can tell a bad request from a bad container."""


class EngineError(Exception):
    """Base of all errors of this engine."""


class ArgumentError(EngineError, ValueError):
    """A request that can't be met as it is stated."""


class FormatError(EngineError):
    """A container whose contents contradict each other or their checksums."""


class LimitError(EngineError):
    """A value or a container beyond a documented limit."""


class VersionError(EngineError):
    """A container of a version this engine does not read."""


class CodecError(EngineError):
    """A payload of a codec this engine does not have."""


class StorageError(EngineError, OSError):
    """Reading or writing failed."""


class MemoryLimitError(EngineError, MemoryError):
    """A value does not fit where it is asked for."""


class UnsupportedError(EngineError, NotImplementedError):
    """A value that this engine does not store in this way."""
