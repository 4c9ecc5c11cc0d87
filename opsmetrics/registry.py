"""Monitor names, how their captures are read, and the parser of each."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import iostat, monitors
from .sources.files import ParseResult


@dataclass(frozen=True)
class Monitor:
    """``parse`` is None for captures that are kept but never turned into metrics; ``places`` if it needs the order of lines."""

    parse: Callable[[DataFrame], dict[str, ParseResult]] | None
    places: bool = False
    record_sep: str | None = None


def _one(fn, **options):
    return lambda df: {"": fn(df, **options)}


def _keyed(fn):
    """Columns as the captures name them."""
    return lambda df: fn(df, keyed=True)


MONITORS: dict[str, Monitor] = {
    "iostat": Monitor(_one(iostat.parse_iostat), places=True),
    "vmstat": Monitor(_one(monitors.parse_vmstat)),
    "dbtest": Monitor(None),
    "dbvars": Monitor(_keyed(monitors.parse_dbvars), places=True),
    "fdcount": Monitor(_one(monitors.parse_fdcount)),
    "memsize": Monitor(_keyed(monitors.parse_memsize)),
    "conxcount": Monitor(_one(monitors.parse_conxcount)),
    "numabuddyrefs": Monitor(monitors.parse_numabuddyrefs, record_sep="datetime: "),
    "numastat": Monitor(None),
    "slowlog": Monitor(_one(monitors.parse_slowlog)),
    "gfpools": Monitor(_keyed(monitors.parse_gfpools), record_sep="#section "),
    "procio": Monitor(_one(monitors.parse_procio, keyed=True)),
    "statics": Monitor(None),
}


def select_monitors(
    include: list[str] | None = None, exclude: list[str] | None = None,
) -> tuple[list[str], list[str]]:
    """Chosen monitor names and the unknown names that were ignored; an empty choice means all."""
    asked = [*(include or []), *(exclude or [])]
    unknown = [m for m in asked if m not in MONITORS]
    chosen = [m for m in MONITORS if not include or m in include]
    if not chosen:
        chosen = list(MONITORS)
    return [m for m in chosen if m not in (exclude or [])], unknown


def available_monitors(names: list[str] | None = None) -> list[str]:
    """Monitors that can be loaded; unknown names are warned about and left out."""
    for m in names or ():
        if m not in MONITORS:
            warnings.warn(f"unknown monitor {m}", stacklevel=2)
    return [m for m in (names or MONITORS) if m in MONITORS and MONITORS[m].parse is not None]


def registry_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(m, MONITORS[m].parse is not None) for m in MONITORS], "monitor string, supported boolean"
    )


def select_monitor_rows(registry: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The same choice over a registry held as rows."""
    out = registry
    if include:
        known = registry.filter(F.col("monitor").isin(*include))
        out = registry.filter(F.col("monitor").isin(*include) | ~known.exists())
    if exclude:
        out = out.filter(~F.col("monitor").isin(*exclude))
    return out
