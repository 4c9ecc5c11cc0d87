"""Finding capture files, and the row-level quality checks every parser shares."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import host_from_path, metric_header, unix_lines
from ..functions.time import let
from ..operators.ordered import running
from ..session import materialize

CARRIED = ("host", "file_path", "pos")


class ParseResult(NamedTuple):
    """Typed rows and the input lines that did not fit, with a reason."""

    rows: DataFrame
    rejects: DataFrame


def carried(df: DataFrame) -> list[str]:
    """Provenance columns a parser passes through when its input has them."""
    return [c for c in CARRIED if c in df.columns]


def read_monitor(
    spark: SparkSession, monitor: str, dirs: list[str], whole: bool = False, record_sep: str | None = None, places: bool = False,
) -> DataFrame:
    """Captures of one monitor below ``dirs``: (value, file_path, host).

    ``value`` is a line, or a record when ``record_sep`` is given, or the file
    when ``whole``. All hosts are read in one plan. Line and record reads split
    large files; ``whole`` is for formats that only make sense as a unit. With
    ``places``, ``split`` is where the split of the file begins and ``at`` orders
    the lines of a split, for parsers that carry something from line to line.
    """
    reader = spark.read.option("pathGlobFilter", f"*_{monitor}_*[0-9].txt").option("recursiveFileLookup", "true")
    if whole:
        reader = reader.option("wholetext", "true")
    elif record_sep:
        reader = reader.option("lineSep", record_sep)
    path = F.col("_metadata.file_path")
    more = [F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")] if places else []
    return reader.text(list(dirs)).select("value", path.alias("file_path"), host_from_path(path).alias("host"), *more)


def placed_lines(df: DataFrame, told: Callable[[Column], Column] | None = None) -> DataFrame:
    """Lines with their place: as read with ``places``, or cut from texts of whole files. Line ends are cleaned.

    Texts without a path are told apart by their content. Lines of a text have no ``split``: it came as one row; texts are
    brought together by path before they are cut, so that their lines need no shuffle. ``told`` makes a line the struct of
    its columns, each computed once, or null where it is left out.
    """
    if "split" in df.columns and "at" in df.columns:
        if told is None:
            return df.withColumn("value", unix_lines("value"))
        seen = F.filter(F.array(told(unix_lines("value"))), lambda x: x.isNotNull())
        return df.select(*[c for c in df.columns if c != "value"], F.inline(seen))
    keep = [c for c in carried(df) if c != "file_path"]
    path = F.col("file_path") if "file_path" in df.columns else F.lit(None).cast("string")
    named = df.select(*keep, F.coalesce(path, F.md5("value")).alias("file_path"), "value")
    # as many pieces as other shuffles begin with: the texts are small beside the lines cut from them
    named = named.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_path")
    lines = F.split(unix_lines("value"), "\n")
    if told is None:
        return named.select(*keep, "file_path", F.posexplode(lines).alias("at", "value")).withColumn("at", F.col("at").cast("bigint"))
    placed = F.transform(lines, lambda line, i: let(told(line), lambda x: F.when(
        x.isNotNull(), F.struct(i.cast("bigint").alias("at"), x.alias("x")))))
    seen = named.select(*keep, "file_path", F.inline(F.filter(placed, lambda x: x.isNotNull())))
    return seen.select(*keep, "file_path", "at", "x.*")


def along_file(lines: DataFrame, specs: dict[str, tuple[str, Column]], before_current: bool = False) -> DataFrame:
    """Running ``sum`` or ``last`` (nulls skipped) over the lines of each file.

    Where files are read in splits, lines are sorted within their split only and a split hands on one small row.
    """
    if "split" in lines.columns:
        return running(lines, ["file_path"], F.col("split"), ["at"], specs, before_current)
    upto = Window.partitionBy("file_path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1 if before_current else 0)
    found = {n: F.sum(c) if kind == "sum" else F.last(c, ignorenulls=True) for n, (kind, c) in specs.items()}
    return lines.select("*", *(c.over(upto).alias(n) for n, c in found.items()))


def carried_forward(lines: DataFrame, marks: dict[str, Column], before_current: bool = False) -> DataFrame:
    """``lines`` with the last value of each mark up to the line, also from earlier splits of its file."""
    return along_file(lines, {n: ("last", c) for n, c in marks.items()}, before_current)


def list_captures(spark: SparkSession, monitor: str, dirs: list[str], with_content_key: bool = True) -> DataFrame:
    """Capture files of a monitor with size, time, host and, if asked for, a key of their content."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*_{monitor}_*[0-9].txt").option("recursiveFileLookup", "true").load(list(dirs))
    )
    listed = files.select(
        F.lit(monitor).alias("monitor"), host_from_path("path").alias("host"), plain_path("path").alias("file_path"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    if not with_content_key:
        return listed
    keys = content_keys(read_monitor(spark, monitor, dirs, record_sep="\n", places=True))
    return listed.join(keys, "file_path", "left").withColumnRenamed("content_key", "md5")


def plain_path(path: Column | str) -> Column:
    """One spelling of a local file's address."""
    return F.regexp_replace(path, "^file:/+", "/")


def _split_sums(lines: DataFrame) -> DataFrame:
    """Per split of a file, numbers that depend on its lines and their places in it, whatever the order they are added in.

    With h a line's hash and i its number in the split, the sum of h and the sum of h * i; i is counted from the smallest
    number only after summing: the sum of h * (i - base) is the sum of h * i less base times the sum of h.
    """
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its task
    hashes = [F.xxhash64(F.lit(k), "value").bitwiseAND(F.lit((1 << 31) - 1)) for k in range(2)]
    wide = lambda c: c.cast("decimal(38,0)")
    return lines.groupBy(plain_path("file_path").alias("file_path"), "split").agg(
        F.count("*").alias("n"), F.min(place).alias("base"), *(F.sum(wide(h)).alias(f"h{k}") for k, h in enumerate(hashes)),
        *(F.sum(wide(h) * place).alias(f"p{k}") for k, h in enumerate(hashes)))


def content_keys(lines: DataFrame) -> DataFrame:
    """(file_path, content_key) of files read as lines with their places; equal files of equal size have equal keys.

    No file is held as a whole: tasks sum up the splits they read, one row per split is shuffled, and the keys of the
    splits are combined in any order. Files of equal size are cut into the same splits.
    """
    placed = [F.col(f"p{k}") - F.col("base") * F.col(f"h{k}") for k in range(2)]
    of_split = [F.xxhash64(F.lit(k), "split", "n", "h0", "h1", *placed) for k in range(2)]
    return _split_sums(lines).groupBy("file_path").agg(
        F.concat_ws("-", F.sum("n").cast("string"), *(F.hex(F.bit_xor(c)) for c in of_split)).alias("content_key"))


def unequal_content(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (file_path, first) of ``pairs`` whose files differ in any line: candidates with equal keys are compared line by line."""
    base = _split_sums(lines).select("file_path", "split", "base", "n")
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = lines.select(plain_path("file_path").alias("file_path"), "split", place.alias("__at"), "value").join(
        base, ["file_path", "split"]).select("file_path", "split", (F.col("__at") - F.col("base")).alias("i"), "value")
    asked = pairs.select(plain_path("file_path").alias("file_path"), plain_path("first").alias("first")).where("file_path <> first")
    a = numbered.join(asked, "file_path")
    b = numbered.withColumnRenamed("file_path", "first")
    key = ["first", "split", "i", "value"]
    missing = a.join(b, key, "left_anti").select("file_path", "first")
    lengths = base.groupBy("file_path").agg(F.sum("n").alias("n"))
    longer = asked.join(lengths, "file_path").join(lengths.toDF("first", "m"), "first").where("n <> m").select("file_path", "first")
    return missing.union(longer).distinct()


def monitor_hosts(df: DataFrame) -> DataFrame:
    return df.select("host").distinct()


def monitor_availability(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Per registered monitor: how many files it has, and whether it has any."""
    counts = files.groupBy("monitor").agg(F.count("*").alias("files"))
    return registry.join(counts, "monitor", "left").fillna(0, ["files"]).withColumn("has_data", F.col("files") > 0)


def dedupe_files(files: DataFrame) -> DataFrame:
    """One file per (monitor, host, content); equal content means equal md5 and size.

    A minimum per group combines on the map side, so a file copied a million
    times costs one shuffled row per task.
    """
    key = ["monitor", "host", "md5", "size"]
    rest = [c for c in files.columns if c not in key and c != "file_path"]
    first = F.min(F.struct("file_path", *rest)).alias("f")
    return files.groupBy(*key).agg(first).select(*key, "f.*")


def split_rows(df: DataFrame, good: Column, reason: str, on_bad: str = "quarantine") -> ParseResult:
    """Rows that satisfy ``good`` and those that do not.

    With ``on_bad="fail"`` reading the rows raises on the first bad one; nothing
    is dropped silently in either mode.
    """
    ok = F.coalesce(good, F.lit(False))
    rejects = df.filter(~ok).select(*carried(df), "value", F.lit(reason).alias("reason"))
    if on_bad == "fail":
        checked = F.when(ok, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit(reason + ": "), F.coalesce("value", F.lit("")))).cast("boolean")
        )
        return ParseResult(df.filter(checked), rejects)
    return ParseResult(df.filter(ok), rejects)


def column_counts(df: DataFrame, by: list[str], n: Column) -> DataFrame:
    """Smallest and largest field count per group; unequal means a damaged capture.

    Put the data version into ``by`` where a format change may alter the count.
    """
    return df.groupBy(*by).agg(
        F.min(n).alias("min_cols"), F.max(n).alias("max_cols"), F.count("*").alias("lines")
    ).withColumn("consistent", F.col("min_cols") == F.col("max_cols"))


def check_columns(df: DataFrame, by: list[str], n: Column, on_bad: str = "quarantine") -> ParseResult:
    """Hold every line of a group to the group's most frequent field count (the larger one on a tie)."""
    counted = df.withColumn("__n", n)
    # One row per group; stored, so that its size is known and the lines need not be shuffled by a hot group.
    usual = materialize(
        counted.groupBy(*by, "__n").agg(F.count("*").alias("c"))
        .groupBy(*by).agg(F.max_by("__n", F.struct("c", "__n")).alias("__usual")), "usual")
    joined = counted.join(usual, by)
    out = split_rows(joined, F.col("__n") == F.col("__usual"), "inconsistent column count", on_bad)
    return ParseResult(out.rows.drop("__n", "__usual"), out.rejects)


def read_multi_header_csv(df: DataFrame, on_bad: str = "quarantine") -> ParseResult:
    """Concatenated CSVs whose header changes on the way, one row per data line.

    ``df`` holds lines with their places, or whole files. A line naming the ``timestamp`` column is the header of the
    lines up to the next one, also beyond the split it stands in. Rows: (provenance, block, at, cells map<string,string>),
    missing cells null. Lines before the first header and lines with more cells than their header are rejects.
    """
    keep = carried(df)
    lines = placed_lines(df)
    is_header = F.col("value").rlike("(?i)(?:timestamp,|,timestamp)")
    seen = along_file(lines, {"block": ("sum", is_header.cast("bigint")), "__header": ("last", F.when(is_header, F.col("value")))})
    body = seen.filter(~is_header & F.col("value").rlike(r"\S"))
    headed = split_rows(body, F.col("__header").isNotNull(), "no header before the line", on_bad)
    cells = F.transform(F.split("value", ","), lambda x: F.trim(x))
    cut = headed.rows.withColumn("__names", F.transform(F.split("__header", ","), metric_header)).withColumn("__cells", cells)
    fit = split_rows(cut, F.size("__cells") <= F.size("__names"), "more cells than the header has", on_bad)
    padded = F.slice(F.concat("__cells", F.transform("__names", lambda _: F.lit(None).cast("string"))), F.lit(1), F.size("__names"))
    rows = fit.rows.select(*keep, "block", "at", F.map_from_arrays("__names", padded).alias("cells"))
    return ParseResult(rows, headed.rejects.unionByName(fit.rejects))


def without_overlap(df: DataFrame) -> DataFrame:
    """Rows of overlapping captures once; a row as often as the capture that holds it most often.

    Equal rows of one file are genuine repeats, equal rows of several files are the same ones. Without ``file_path``
    the rows cannot be told apart and equal ones count once.
    """
    facts = [c for c in df.columns if c != "file_path"]
    if len(facts) == len(df.columns):
        return df.distinct()
    per_file = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    most = per_file.groupBy(*facts).agg(F.max("__n").alias("__n"))
    return most.select(*facts, F.explode(F.sequence(F.lit(1).cast("bigint"), "__n")).alias("__n")).drop("__n")
