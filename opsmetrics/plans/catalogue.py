"""All registered queries."""

from . import analytics, jobs, roundtrips, scalars, streams  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
