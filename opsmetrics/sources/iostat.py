"""Disk-statistics reports.

A report is a banner, then samples of a time line, a CPU paragraph and a device paragraph. Every line is told by itself;
what a device line needs from the lines above it (date style, time, CPU figures, column names) is carried forward, also
over the places where a file is split. Lines that belong to none of these are rejects and take the time away from the
lines below them, so that figures never get the time of an earlier sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import number, words
from ..functions.time import at_clock, clock_seconds, let, parse_iso, parse_long, parse_us, parse_us_date
from .files import ParseResult, along_file, carried, carried_forward, placed_lines, split_rows

# Device-name prefixes that are reported.
DEVICE_PREFIXES = ("sd", "fi", "nv", "xv", "em")
UNKNOWN = "unknown"


def banner_style(banner: Column) -> Column:
    """Date style of a report, from the number of words of its banner and the marks in its date."""
    def of(w: Column) -> Column:
        parts = lambda mark: F.size(F.split(F.get(w, 3), mark))
        return (
            F.when((F.size(w) == 7) & (parts("/") == 3), "us")
            .when((F.size(w) == 7) & (parts("-") == 3), "iso")
            .when(F.size(w) == 10, "long")
            .when(F.size(w) == 4, "clock")
        )
    return let(words(banner), of)


def _numeric(word: Column) -> Column:
    """A word that converts to a number; words that begin with a letter are only tried if they spell a special value, as failing is slow."""
    w = F.coalesce(word, F.lit(""))
    return w.rlike(r"^(?:[^A-Za-z]|(?i:nan|inf|infinity)[\x00-\x20]*$)") & w.try_cast("double").isNotNull()


def _kind(line: Column, w: Column) -> Column:
    """What a line is, from itself and its words."""
    return (
        F.when(F.get(w, 0) == "", "blank")
        .when(line.startswith("Linux "), "banner")
        .when(F.get(w, 0) == "avg-cpu:", "names")
        .when(F.get(w, 0).startswith("Device"), "head")
        .when(line.rlike(r":\S*:"), "time")
        .when(_numeric(F.get(w, 0)), F.when(F.forall(w, _numeric), "cpu").otherwise("other"))
        .when(_numeric(F.get(w, 1)), "device")
        .otherwise("other")
    )


def _told(prefixes: tuple[str, ...]) -> Callable[[Column], Column]:
    """A line to its kind and, where they are read later, its words; null for blank lines and other devices."""
    def wanted(line: Column, kind: Column) -> Column:
        own = F.lit(False)
        for p in prefixes:
            own = own | line.startswith(p)
        return (kind != "blank") & ((kind != "device") | own)

    def of(line: Column) -> Column:
        return let(words(line), lambda w: let(_kind(line, w), lambda kind: F.when(wanted(line, kind), F.struct(
            line.alias("value"), kind.alias("__kind"), F.when(kind.isin("cpu", "head", "device"), w).alias("__w")))))
    return of


def _is(kind: str) -> Column:
    return F.col("__kind") == kind


def _carried(df: DataFrame, prefixes: tuple[str, ...], clock: bool = False) -> DataFrame:
    """Lines with their kind, and from the lines above: style, time (or banner and clock), CPU names and figures, column names.

    Blank lines and other devices are left out before anything is sorted. A line is cut into words once.
    """
    lines = placed_lines(df, _told(prefixes))
    line = F.col("value")
    # times are read where they stand, once, and carried as what they mean
    us, long = parse_us(line), parse_long(line)
    read = F.coalesce(
        F.when(us.isNotNull(), F.struct(F.lit("us").alias("style"), us.alias("at"))),
        F.when(long.isNotNull(), F.struct(F.lit("long").alias("style"), long.alias("at"))),
        F.struct(F.lit("iso").alias("style"), parse_iso(line).alias("at")))
    lost = F.struct(F.lit(None).cast("string").alias("style"), F.lit(None).cast("timestamp_ntz").alias("at"))
    no_time = F.col("__kind").isin("banner", "other")
    marks = {
        "__style": F.when(_is("banner"), F.coalesce(banner_style(line), F.lit(UNKNOWN))),
        "__names": F.when(_is("names"), words(F.substring_index(line, ":", -1))), "__cpu": F.when(_is("cpu"), F.col("__w")),
        "__columns": F.when(_is("head"), F.col("__w"))}
    if clock:
        marks |= {
            "__banner": F.when(_is("banner"), line),
            "__clock": F.when(_is("time"), F.coalesce(clock_seconds(line), F.lit(-1))).when(no_time, F.lit(-1))}
    else:
        marks["__time"] = F.when(_is("time"), read).when(no_time, lost)
    return carried_forward(lines, marks)


def _device_rows(lines: DataFrame, keep: list[str], on_bad: str) -> ParseResult:
    """Lines with a ``timestamp`` to one row per device with a map of all measures, and all lines that are not understood."""
    lines = lines.filter(F.col("__kind").isin("other", "device", "banner")).select(
        *keep, "value", "timestamp", "__kind", "__style", "__names", "__cpu", "__columns", "__w")
    strange = split_rows(lines, ~_is("other"), "not a line of a report", on_bad)
    banners = split_rows(strange.rows, ~_is("banner") | (F.col("__style") != UNKNOWN), "unknown banner", on_bad)
    devices = banners.rows.filter(_is("device")).select(
        *keep, "value", "timestamp", F.col("__w").alias("__f"), F.col("__columns").alias("__head"),
        F.col("__names").alias("__cn"), F.col("__cpu").alias("__cv"))
    ok = F.col("timestamp").isNotNull() & (F.size("__f") == F.size("__head")) & (F.size("__cn") == F.size("__cv"))
    res = split_rows(devices, ok, "not a device row", on_bad)
    names = F.concat(F.slice("__head", F.lit(2), F.size("__head") - 1), F.col("__cn"))
    values = F.concat(F.slice("__f", F.lit(2), F.size("__f") - 1), F.col("__cv"))
    rows = res.rows.select(
        *keep, "timestamp", F.col("__f")[0].alias("device"),
        F.map_from_arrays(names, F.transform(values, number)).alias("measures"))
    return ParseResult(rows, strange.rejects.unionByName(banners.rejects).unionByName(res.rejects))


def parse_iostat(
    df: DataFrame, prefixes: tuple[str, ...] = DEVICE_PREFIXES, on_bad: str = "quarantine",
) -> ParseResult:
    """Reports whose samples carry a full date; ``df`` holds lines with their places, or whole files.

    The banner tells the date style: US with optional AM/PM, ISO with offset, or
    the long form. Measures form a map, since columns differ between versions.
    """
    lines = _carried(df, prefixes)
    stamp = F.when(F.col("__time.style") == F.col("__style"), F.col("__time.at"))
    dated = lines.filter(F.col("__style").isNull() | (F.col("__style") != "clock"))
    return _device_rows(dated.withColumn("timestamp", stamp), carried(df), on_bad)


def parse_iostat_clock(
    df: DataFrame, prefixes: tuple[str, ...] = DEVICE_PREFIXES, on_bad: str = "quarantine",
) -> ParseResult:
    """Reports dated once in the banner, with ``Time: hh:mm:ss AM`` samples.

    A sample whose clock went from PM to AM begins a new day. Days are counted
    along one report; times come out on the minute.
    """
    lines = _carried(df, prefixes, clock=True)
    after_noon = F.lower(F.element_at(words("value"), -1)) == "pm"
    # which half of the day it was before a time line, and how often midnight passed since the banner
    earlier = carried_forward(lines, {"__was_pm": F.when(_is("time"), after_noon).when(_is("banner"), F.lit(False))}, before_current=True)
    midnight = _is("time") & ~after_noon & F.coalesce("__was_pm", F.lit(False))
    days = along_file(earlier, {"__days": ("sum", midnight.cast("bigint"))})
    based = carried_forward(days, {"__base": F.when(_is("banner"), F.col("__days"))}).filter(F.col("__style") == "clock")
    stamp = F.date_trunc("minute", at_clock(
        parse_us_date("__banner"), F.col("__days") - F.col("__base"), F.when(F.col("__clock") >= 0, F.col("__clock")))).cast("timestamp_ntz")
    return _device_rows(based.withColumn("timestamp", stamp), carried(df), on_bad)


def disk_with_slow_inserts(disk: DataFrame, slow: DataFrame, by: list[str] = ("host",)) -> DataFrame:
    """Disk and slow-insert figures of the same host and minute.

    Both sides have a ``timestamp``; each is averaged per minute before the join,
    so the join keys are unique on both sides.
    """
    def per_minute(df: DataFrame, dims: list[str], measures: list[str]) -> DataFrame:
        minute = F.substring(F.col("timestamp").cast("string"), 1, 16).alias("minute")
        return df.groupBy(*by, *dims, minute).agg(*[F.avg(m).alias(m) for m in measures])
    used = {*by, "timestamp", "file_path", "pos"}
    disk_dims = [c for c in ("device",) if c in disk.columns]
    d = per_minute(disk, disk_dims, [c for c in disk.columns if c not in used and c not in disk_dims])
    s = per_minute(slow, [], [c for c in slow.columns if c not in used])
    return d.join(s, [*by, "minute"])
