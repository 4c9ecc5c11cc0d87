"""A point store partitioned by metric and run, with a log that decides what readers see.

Every (metric, host) that is loaded has a load number of its own. A number belongs to who creates its file: the file is
created exclusively, before anything is written, so two loaders never share a number, and none withdraws another's.

Log statuses: ``started`` notes a number, ``loaded`` makes a host's points visible, ``rejected`` counts a host's lines that
did not parse, ``undone`` withdraws. Numbers are never used twice.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "load_seq bigint, metric string, host string, status string, points bigint"
POINT_SCHEMA = (
    "metric string, epoch bigint, col string, raw string, value double, tags map<string,string>, host string, load_id string, load_seq bigint, run string")


def _rebalanced(df: DataFrame, *cols: str) -> DataFrame:
    """Bring rows of a target folder together; AQE splits the large ones and merges the small."""
    return df.hint("rebalance", *cols)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, ``timestamp`` first."""
    first = [c for c in ("timestamp",) if c in df.columns]
    df.select(*first, *[c for c in df.columns if c not in first]).write.mode(mode).csv(path, header=True)


def write_lines(df: DataFrame, path: str, gzip: bool = False, mode: str = "errorifexists") -> None:
    """A single text column, one line each."""
    writer = df.select("value").write.mode(mode)
    (writer.option("compression", "gzip") if gzip else writer).text(path)


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    """The load log; empty before the first load."""
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(log_path)
    except Exception as missing:  # the path appears with the first load
        if "PATH_NOT_FOUND" in str(missing):
            return spark.createDataFrame([], LOG_SCHEMA)
        raise


def next_load_id(log: DataFrame) -> DataFrame:
    """The next load number and its label ``L<n>``, counting from 0."""
    seq = F.coalesce(F.max("load_seq") + 1, F.lit(0)).cast("bigint")
    return log.agg(seq.alias("load_seq")).withColumn("load_id", F.concat(F.lit("L"), F.col("load_seq").cast("string")))


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _create(spark: SparkSession, path: str) -> bool:
    """Create an empty file; false if it is there already. Only one of several callers succeeds."""
    files, place = _files(spark, path)
    if files.getUri().getScheme() == "file":  # Hadoop's local files are tested first and created afterwards
        local = place.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            os.close(os.open(local, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        files.create(place, False).close()
    except Exception as problem:
        if "FileAlreadyExists" in str(problem):
            return False
        raise
    return True


def _numbers(log_path: str) -> str:
    return f"{log_path.rstrip('/')}-numbers"


def reserve(spark: SparkSession, log_path: str, count: int = 1) -> list[int]:
    """Load numbers that no other loader has or will get, ascending."""
    files, place = _files(spark, _numbers(log_path))
    taken = [int(f.getPath().getName()) for f in files.listStatus(place) if f.getPath().getName().isdigit()] if files.exists(place) else []
    number = max([next_load_id(read_log(spark, log_path)).first()["load_seq"] - 1, *taken]) + 1
    own: list[int] = []
    while len(own) < count:
        if _create(spark, f"{_numbers(log_path)}/{number}"):
            own.append(number)
        number += 1
    return own


def load_points(points: DataFrame, store_path: str, log_path: str, load_seq: int | dict[str | None, int]) -> DataFrame:
    """Append one load and log it per (metric, host); the number is one for all hosts, or a reserved one for each.

    Rows become visible only through the log, which is written after the data
    job has committed, so a load that dies half way leaves no visible row, also
    not through a later load. A single number is reserved here; a used one is refused.
    """
    spark = points.sparkSession
    if isinstance(load_seq, int):
        if not read_log(spark, log_path).filter(F.col("load_seq") == load_seq).isEmpty() or not _create(spark, f"{_numbers(log_path)}/{load_seq}"):
            raise ValueError(f"load number {load_seq} is used already")
        numbers, tagged = [load_seq], points.withColumn("load_seq", F.lit(load_seq).cast("bigint"))
    else:
        numbers = sorted(load_seq.values())
        of_host = spark.createDataFrame(list(load_seq.items()), "__host string, load_seq bigint")  # one row for each host
        tagged = points.join(of_host, F.col("host").eqNullSafe(F.col("__host"))).drop("__host")
    run = f"R{numbers[0]}"
    spark.createDataFrame([(n, None, None, "started", 0) for n in numbers], LOG_SCHEMA).write.mode("append").parquet(log_path)
    tagged = tagged.withColumn("load_id", F.concat(F.lit("L"), F.col("load_seq").cast("string"))).withColumn("run", F.lit(run))
    _rebalanced(tagged, "metric").write.partitionBy("metric", "run").mode("append").parquet(store_path)
    written = _stored_points(spark, store_path).filter(F.col("run") == run)
    entry = written.groupBy("load_seq", "metric", "host").agg(
        F.lit("loaded").alias("status"), F.count("*").alias("points"))
    entry.write.mode("append").parquet(log_path)
    return entry


def _stored_points(spark: SparkSession, store_path: str) -> DataFrame:
    """All points written; the schema is given, so names that look like numbers stay names."""
    return spark.read.schema(POINT_SCHEMA).parquet(store_path)


def store_rejects(rejects: DataFrame, metric: str, path: str, log_path: str, load_seq: int | dict[str | None, int]) -> None:
    """Append a load's lines that did not parse, and count them per host in the log."""
    spark = rejects.sparkSession
    for c in ("host", "file_path"):
        rejects = rejects if c in rejects.columns else rejects.withColumn(c, F.lit(None).cast("string"))
    if isinstance(load_seq, int):
        run, numbered = load_seq, rejects.withColumn("load_seq", F.lit(load_seq).cast("bigint"))
    else:
        run = min(load_seq.values())
        of_host = spark.createDataFrame(list(load_seq.items()), "__host string, load_seq bigint")
        numbered = rejects.join(of_host, F.col("host").eqNullSafe(F.col("__host")), "left").withColumn("load_seq", F.coalesce("load_seq", F.lit(run).cast("bigint")))
    kept = numbered.select("load_seq", F.lit(metric).alias("metric"), "host", "file_path", "value", "reason", F.lit(f"R{run}").alias("run"))
    kept.write.mode("append").partitionBy("run").parquet(path)
    spark.read.schema(kept.schema).parquet(path).filter((F.col("run") == f"R{run}") & (F.col("metric") == metric)).groupBy(
        "load_seq", "metric", "host").agg(F.lit("rejected").alias("status"), F.count("*").alias("points")).write.mode("append").parquet(log_path)


def undo_load(spark: SparkSession, log_path: str, load_seq: int, metric: str | None = None) -> None:
    """Withdraw a load, or one metric of it; its rows are no longer read. Safe to repeat."""
    log = read_log(spark, log_path)
    gone = log.filter((F.col("load_seq") == load_seq) & (F.col("status") == "loaded"))
    if metric is not None:
        gone = gone.filter(F.col("metric") == metric)
    gone.select(
        "load_seq", "metric", "host", F.lit("undone").alias("status"), F.lit(0).cast("bigint").alias("points")
    ).distinct().write.mode("append").parquet(log_path)


LOAD = ("load_seq", "metric", "host")


def _same_load(a: DataFrame, b: DataFrame) -> Column:
    """The same load in two frames; a host may be null."""
    return (a["load_seq"] == b["load_seq"]) & (a["metric"] == b["metric"]) & a["host"].eqNullSafe(b["host"])


def visible_loads(log: DataFrame) -> DataFrame:
    done = log.filter(F.col("status") == "loaded").select(*LOAD).distinct()
    undone = log.filter(F.col("status") == "undone").select(*LOAD).distinct()
    return done.join(undone, _same_load(done, undone), "left_anti")


def read_points(spark: SparkSession, store_path: str, log_path: str) -> DataFrame:
    """Points of all loads that were completed and not undone."""
    points, loads = _stored_points(spark, store_path), visible_loads(read_log(spark, log_path))
    return points.join(loads, _same_load(points, loads), "left_semi")


def empty_store(spark: SparkSession, store_path: str, log_path: str) -> None:
    """Remove all points and restart load numbers at 0. No load may run meanwhile."""
    files, place = _files(spark, _numbers(log_path))
    files.delete(place, True)
    spark.createDataFrame([], LOG_SCHEMA).write.mode("overwrite").parquet(log_path)
    spark.createDataFrame([], POINT_SCHEMA).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(store_path)


def load_report(outcomes: DataFrame, available: DataFrame) -> DataFrame:
    """Monitors per outcome with names and count; ``all_loaded`` and ``exit_status`` for the whole load.

    ``outcomes`` has (monitor, status) with empty, failed or loaded; ``available``
    lists the monitors that can be loaded.
    """
    named = outcomes.select("monitor", "status").distinct()
    per = named.groupBy("status").agg(
        F.count("*").alias("monitors"), F.array_join(F.sort_array(F.collect_list("monitor")), " ").alias("names")
    )
    facts = named.agg(F.struct(
        F.count_if(F.col("status") == "loaded").alias("loaded"), F.count_if(F.col("status") == "failed").alias("failed"),
    )).scalar()
    total = available.agg(F.count("*")).scalar()
    return per.withColumn("all_loaded", facts["loaded"] == total).withColumn(
        "exit_status", F.when((facts["failed"] > 0) | (facts["loaded"] == 0), 1).otherwise(0)
    )
