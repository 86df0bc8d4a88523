"""Queries of the engine: ``QUERIES`` and the SQL that says the same, ``SQL``."""

from . import catalogue2, catalogue3  # noqa: F401
from .catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
