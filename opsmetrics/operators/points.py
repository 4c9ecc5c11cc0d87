"""Wide monitor rows to long, tagged metric points."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import epoch_in_zone
from ..functions.text import number

# Columns that describe the other columns -> tag name; order is the order of tags in a line.
TAG_RULES = [
    ("device", r"^device"),
    ("buffer", r"^buffer"),
    ("port", r"^port"),
    ("listener", r"^listener$"),
    ("pool", r"^pool$"),
    ("node", r"^node"),
    ("zone", r"^zone"),
    ("event", r"^EVENT_NAME"),
    ("connuser", r"^user$"),
    ("connhost", r"^host$"),
]


def metric_name(column: str) -> str:
    """Column name as a metric column: first ``%`` to ``pct``, ``(`` to ``_``, ``)`` dropped."""
    return column.strip().replace("%", "pct", 1).replace("(", "_").replace(")", "")


def tag_of(column: str) -> str | None:
    for tag, pattern in TAG_RULES:
        if re.match(pattern, column, re.IGNORECASE):
            return tag
    return None


def to_points(
    df: DataFrame, metric: str, zone: str = "America/Los_Angeles", host: Column | str | None = None,
    load_id: str | None = None, timestamp: str = "timestamp", ignore: tuple[str, ...] = ("file_path", "pos", "ignored_states"),
) -> DataFrame:
    """One point per measure and row: (metric, epoch, col, raw, value, tags, host, load_id).

    Which columns are tags is decided from their names when the plan is built.
    ``host`` is the capturing host: a column to use, or a fixed name. Empty
    values are dropped, zeros kept. The unpivot is a narrow expand.
    """
    host_col = F.lit(host) if isinstance(host, str) and host not in df.columns else host
    host_col = F.col(host) if isinstance(host_col, str) else host_col
    skip = {timestamp, *ignore} | ({host} if isinstance(host, str) and host in df.columns else set())
    tags = {c: tag_of(metric_name(c)) for c in df.columns if c not in skip}
    measures = [c for c, t in tags.items() if t is None]
    order = {t: i for i, (t, _) in enumerate(TAG_RULES)}
    tagged = sorted((c for c, t in tags.items() if t is not None), key=lambda c: order[tags[c]])
    tag_map = (
        F.map_filter(F.create_map(*[x for c in tagged for x in (F.lit(tags[c]), F.col(c).cast("string"))]),
                     lambda k, v: v.isNotNull())
        if tagged else F.expr("cast(map() as map<string,string>)")
    )
    flat = df.select(
        epoch_in_zone(timestamp, zone).alias("epoch"), tag_map.alias("tags"),
        (host_col if host_col is not None else F.lit(None)).cast("string").alias("host"),
        *[F.col(f"`{c}`").cast("string").alias(metric_name(c)) for c in measures],
    )
    long = flat.unpivot(["epoch", "tags", "host"], [metric_name(c) for c in measures], "col", "raw")
    return long.filter(F.length("raw") > 0).select(
        F.lit(metric).alias("metric"), "epoch", "col", "raw", number("raw").alias("value"), "tags", "host",
        F.lit(load_id).cast("string").alias("load_id"),
    )


def map_to_points(
    df: DataFrame, metric: str, cells: str = "cells", zone: str = "America/Los_Angeles",
    host: str | None = None, load_id: str | None = None, timestamp: Column | None = None,
) -> DataFrame:
    """As ``to_points`` for rows whose cells form a map, where each row may have other columns."""
    def tag_name(k: Column) -> Column:
        out = None
        for name, pattern in TAG_RULES:
            hit = F.lower(k).rlike(pattern.lower())
            out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
        return out
    m = F.col(cells)
    entries = F.map_entries(F.map_filter(m, lambda k, v: tag_name(k).isNotNull() & v.isNotNull()))
    tags = F.map_from_entries(F.transform(entries, lambda e: F.struct(tag_name(e["key"]), e["value"])))
    stamp = timestamp if timestamp is not None else F.try_element_at(m, F.lit("timestamp")).try_cast("timestamp_ntz")
    return (
        df.select(stamp.alias("__ts"), tags.alias("tags"), (F.col(host) if host else F.lit(None)).cast("string").alias("host"),
                  F.explode(F.map_entries(m)).alias("e"))
        .filter(tag_name(F.col("e.key")).isNull() & (F.lower(F.col("e.key")) != "timestamp") & (F.length(F.col("e.value")) > 0))
        .select(
            F.lit(metric).alias("metric"), epoch_in_zone("__ts", zone).alias("epoch"), F.col("e.key").alias("col"),
            F.col("e.value").alias("raw"), number(F.col("e.value")).alias("value"), "tags", "host",
            F.lit(load_id).cast("string").alias("load_id"),
        )
    )


def _tag_text() -> Column:
    return F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")


def _line(prefix: list[Column]) -> Column:
    return F.concat_ws(
        " ", *prefix, "metric", F.col("epoch").cast("string"), "raw", F.concat(F.lit("col="), F.col("col")),
        F.nullif(_tag_text(), F.lit("")), F.concat(F.lit("host="), F.col("host")), F.concat(F.lit("Z="), F.col("load_id")),
    )


def without_place(points: DataFrame) -> DataFrame:
    """Points that no line can hold: without metric, time, column or value. They are rejects of the line formats."""
    return points.filter(~_has_place())


def _has_place() -> Column:
    return F.col("metric").isNotNull() & F.col("epoch").isNotNull() & F.col("col").isNotNull() & F.col("raw").isNotNull()


def to_put_lines(points: DataFrame) -> DataFrame:
    """``put metric epoch value col=.. tags host=.. Z=..``; a missing host or load is left out, see also ``without_place``."""
    return points.filter(_has_place()).select(_line([F.lit("put")]).alias("value"))


def to_import_lines(points: DataFrame) -> DataFrame:
    """As put lines without the leading word, for bulk import."""
    return points.filter(_has_place()).select(_line([]).alias("value"))


def to_wide(points: DataFrame, columns: list[str], keys: list[str] = ("metric", "epoch", "host")) -> DataFrame:
    """Points back to one row per key with the named columns."""
    return points.groupBy(*keys).agg(*[F.max(F.when(F.col("col") == c, F.col("value"))).alias(c) for c in columns])
