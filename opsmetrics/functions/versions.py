"""Dotted version functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col


def is_version(v: Column | str) -> Column:
    """Three or four dotted numbers."""
    return _col(v).rlike(r"^[0-9]+\.[0-9]+\.[0-9]+(\.[0-9]+)?$")


def version_loose_eq(a: Column | str, b: Column | str) -> Column:
    """Equal text, or one part longer than the other (both three parts or more) with an equal common prefix."""
    x, y = F.split(_col(a), r"\."), F.split(_col(b), r"\.")
    nx, ny = F.size(x), F.size(y)
    short = F.least(nx, ny)
    prefix_eq = F.slice(x, F.lit(1), short) == F.slice(y, F.lit(1), short)
    return F.when(nx == ny, _col(a) == _col(b)).otherwise((F.abs(nx - ny) == 1) & (short >= 3) & prefix_eq)


def version_from_padded(v: Column | str) -> Column:
    """``004-005-018-000`` to ``4.5.18.0``."""
    parts = F.transform(F.split(_col(v), "-"), lambda x: x.try_cast("bigint").cast("string"))
    return F.array_join(parts, ".")


def version_parts(v: Column | str) -> Column:
    return F.transform(F.split(_col(v), r"\."), lambda x: x.try_cast("int"))


def version_newer(a: Column | str, b: Column | str) -> Column:
    """Numeric, part by part: is ``a`` newer than ``b``; a missing part sorts first."""
    return version_parts(a) > version_parts(b)
