"""Captures to stored points: find, de-duplicate, parse, unpivot, tag, load, report."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.points import map_to_points, to_points
from .registry import MONITORS, available_monitors
from .session import materialize
from .sinks.store import load_points, load_report, read_log, reserve, store_rejects, undo_load
from .sources.files import ParseResult, dedupe_files, list_captures, plain_path, read_monitor


def monitor_results(spark: SparkSession, monitor: str, dirs: list[str]) -> list[ParseResult]:
    """Parsed rows and rejects of one monitor over all its hosts, copies of a file read once.

    The lines are read from the captures once and stored, as rows and rejects both come from them.
    """
    spec = MONITORS[monitor]
    lines = read_monitor(spark, monitor, dirs, record_sep=spec.record_sep, places=spec.places)
    # A stored list of files has a known size, so the lines are not shuffled to meet it.
    unique = materialize(dedupe_files(list_captures(spark, monitor, dirs)).select(F.col("file_path").alias("__f")), "files")
    lines = lines.withColumn("__f", plain_path("file_path")).join(unique, "__f", "left_semi").drop("__f")
    return list(spec.parse(materialize(lines, "lines")).values())


def rejected_lines(results: list[ParseResult]) -> DataFrame:
    """The lines of all tables of a monitor that did not parse, with file and reason."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r.rejects for r in results])


def monitor_points(
    spark: SparkSession, monitor: str, dirs: list[str], zone: str = "America/Los_Angeles", results: list[ParseResult] | None = None,
) -> DataFrame:
    """Points of one monitor over all its hosts; ``results`` saves parsing the captures again."""
    parts = []
    for result in results or monitor_results(spark, monitor, dirs):
        rows = result.rows
        maps = [f.name for f in rows.schema.fields if f.dataType.typeName() == "map"]
        if maps:
            named = rows.withColumn("cells", F.transform_values(maps[0], lambda k, v: v.cast("string")))
            for tag in ("device", "node"):
                if tag in rows.columns:
                    named = named.withColumn("cells", F.map_concat("cells", F.create_map(F.lit(tag), F.col(tag))))
            renamed = F.map_from_entries(F.transform(
                F.map_entries("cells"),
                lambda e: F.struct(F.translate(F.regexp_replace(e["key"], r"^([^%]*)%", "$1pct"), "()", "_"), e["value"])))
            parts.append(map_to_points(
                named.withColumn("cells", renamed), monitor, zone=zone, host="host", timestamp=F.col("timestamp")))
        else:
            parts.append(to_points(rows, monitor, zone, host="host"))
    return reduce(DataFrame.unionByName, parts)


def load_all(
    spark: SparkSession, dirs: list[str], store_path: str, log_path: str, names: list[str] | None = None,
    zone: str = "America/Los_Angeles", rejects_path: str | None = None,
) -> DataFrame:
    """Load every chosen monitor that has captures; one monitor's failure does not stop the others.

    Every (monitor, host) gets a load number of its own, which no other loader can have; what fails is withdrawn by these
    numbers alone. Lines that do not parse are kept below ``rejects_path`` (beside the store unless named) and counted in
    the log; ``rejects`` of the report is their number per outcome.
    """
    rejects_path = rejects_path or f"{store_path.rstrip('/')}-rejects"
    outcomes: list[tuple[str, str, int | None]] = []
    monitors = available_monitors(names)
    for m in monitors:
        hosts = sorted((r["host"] for r in list_captures(spark, m, dirs, with_content_key=False).select("host").distinct().collect()), key=lambda h: h or "")
        if not hosts:
            outcomes.append((m, "empty", None))
            continue
        numbers = dict(zip(hosts, reserve(spark, log_path, len(hosts))))
        try:
            results = monitor_results(spark, m, dirs)
            load_points(monitor_points(spark, m, dirs, zone, results), store_path, log_path, numbers)
            store_rejects(rejected_lines(results), m, rejects_path, log_path, numbers)
            outcomes += [(m, "loaded", n) for n in numbers.values()]
        except Exception as reason:
            warnings.warn(f"load of {m} failed: {reason}", stacklevel=2)
            for n in numbers.values():
                undo_load(spark, log_path, n, m)
            outcomes += [(m, "failed", n) for n in numbers.values()]
    status = spark.createDataFrame(outcomes, "monitor string, status string, load_seq bigint")
    counted = read_log(spark, log_path).filter("status = 'rejected'").groupBy("load_seq").agg(F.sum("points").alias("rejects"))
    per = status.join(counted, "load_seq", "left").groupBy("status").agg(F.coalesce(F.sum("rejects"), F.lit(0)).alias("rejects"))
    return load_report(status, spark.createDataFrame([(m,) for m in monitors], "monitor string")).join(per, "status")
