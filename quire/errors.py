"""Errors of the engine's parts."""

from __future__ import annotations


class EngineError(Exception):
    """Anything that the engine refuses or cannot do."""


class IndexLogError(EngineError, ValueError):
    """A batch or kind of index that cannot be."""


class CacheError(EngineError, ValueError):
    """A cache that cannot be folded as asked."""


class OutputError(EngineError, ValueError):
    """A form of output that is not known."""


class ProviderError(EngineError, RuntimeError):
    """A failed call of an outside program; one that may succeed when repeated says so with ``again``."""

    def __init__(self, message: str, again: bool = False):
        super().__init__(message)
        self.again = again
