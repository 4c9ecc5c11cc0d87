"""Partition-file inventories: space used, projected growth, and what a listing says about its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _col
from .rules import first_match

# Table-name fragment of each retention group, first match wins.
GROUP_RULES = [
    ("minute", "metricdata_min"),
    ("ten_min", "metricdata_ten_min"),
    ("hourly", "metricdata_hour"),
    ("machine snapshot", "machine_snapshot"),
    ("event", "eventdata"),
    ("snapshot", "requestdata"),
    ("process snapshot", "process_snapshot"),
    ("tss", "top_summary"),
]
# Retention setting, the groups it governs, and (multiplier, divisor) into partitions kept.
RETENTION = [
    ("metrics.min.retention.period", "minute", 6, 1),
    ("metrics.ten.min.retention.period", "ten_min", 1, 2),
    ("metrics.retention.period", "hourly", 1, 1),
    ("snapshots.retention.period", "snapshot", 1, 1),
    ("snapshots.retention.period", "process snapshot", 1, 1),
    ("tss.retention.period", "tss", 1, 1),
    ("machine.snapshots.retention.period", "machine snapshot", 1, 1),
    ("events.retention.period", "event", 1, 1),
]
# Tables kept in four sub-partitions per partition.
SUBPARTITIONED = {"metricdata_min": 4, "metricdata_ten_min": 4}
COPY_GROWTH = 1.2  # fixed value: space a rebuilt copy may need, relative to its source


def retention_group(table: Column | str) -> Column:
    t = _col(table)
    return first_match([(g, t.contains(piece)) for g, piece in GROUP_RULES], "other")


def partition_files(listing: DataFrame) -> DataFrame:
    """Files of numbered partitions: (table, part, size, plus the listing's other columns).

    Names look like ``metricdata_min#P#PART123#SP#PART123sp0.ibd``; files of the
    catch-all PARTMAX partition have no digit there and fall out.
    """
    third = F.substring_index(F.substring_index("name", "#", 3), "#", -1)
    return (
        listing.filter(F.col("name").endswith(".ibd") & F.col("name").contains("PART") & F.col("name").rlike("PART[0-9]"))
        .withColumn("table", F.substring_index("name", "#", 1))
        .withColumn("part", F.substring_index(third, ".", 1))
    )


def space_by_table(files: DataFrame) -> DataFrame:
    return (
        files.groupBy("table")
        .agg(F.sum("size").alias("size"), F.max("size").alias("max_size"), F.count("*").alias("files"))
        .withColumn("group", retention_group("table"))
    )


def retention_settings(config: DataFrame) -> DataFrame:
    """Partitions kept per group, from name/value configuration rows; units differ per setting."""
    rules = config.sparkSession.createDataFrame(RETENTION, "name string, group string, times bigint, per bigint")
    value = F.col("value").try_cast("bigint")
    return (
        config.filter(F.col("name").like("%retention%"))
        .join(rules, "name")
        .groupBy("group")
        .agg(F.max(F.floor(value * F.col("times") / F.col("per"))).cast("bigint").alias("retained"))
    )


def project_space(files: DataFrame, config: DataFrame) -> DataFrame:
    """Current and projected bytes per table, per group and in total.

    A table's projection is its largest file times the partitions its group
    keeps times its sub-partitions. Files are reduced to one row per table
    before the configuration joins and the rollup expands.
    """
    sub = F.lit(1)
    for name, n in SUBPARTITIONED.items():
        sub = F.when(F.col("table") == name, F.lit(n)).otherwise(sub)
    kept = retention_settings(config)
    tables = (
        space_by_table(files).join(kept, "group", "left")
        .withColumn("retained", F.coalesce("retained", F.lit(0)).cast("bigint"))
        .withColumn("parts", F.floor(F.col("files") / sub).cast("bigint"))
        .withColumn("projection", F.col("max_size") * F.col("retained") * sub)
    )
    rolled = tables.rollup("group", "table").agg(
        F.sum("parts").alias("parts"), F.max("retained").alias("retained"), F.max("max_size").alias("max_size"),
        F.sum("size").alias("size"), F.sum("projection").alias("projection"), F.grouping_id().alias("gid"),
    )
    level = F.when(F.col("gid") == 0, "table").when(F.col("gid") == 1, "group").otherwise("total")
    detail = F.col("gid") == 0
    return rolled.select(
        "group", "table",
        F.when(detail, F.col("parts")).alias("parts"),
        F.when(F.col("gid") < 2, F.col("retained")).alias("retained"),
        F.when(detail, F.col("max_size")).alias("max_size"),
        "size", "projection", level.alias("level"),
    )


def space_report(projected: DataFrame) -> DataFrame:
    """The projection in the order of a report: each group's tables by name, then the group, and the total at the end."""
    last = lambda c: F.col(c).asc_nulls_last()
    return projected.orderBy(last("group"), last("table"))


def space_check(files: DataFrame, free_mb: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Is there room to rebuild each table?

    ``files`` has (table, kb), ``free_mb`` (table, free_mb); ``done`` lists
    already rebuilt tables as (table, old_exists). Used and needed megabytes are
    truncated; equal needed and free counts as short.
    """
    used = files.groupBy("table").agg(F.floor(F.sum("kb") / F.lit(1024)).cast("bigint").alias("used_mb"))
    out = used.join(free_mb, "table").withColumn(
        "needed_mb", F.floor(F.col("used_mb") * F.lit(COPY_GROWTH)).cast("bigint")
    )
    verdict = F.when(F.col("needed_mb") < F.col("free_mb"), "space ok").otherwise("space short")
    if done is not None:
        out = out.join(done, "table", "left")
        verdict = (
            F.when(F.col("old_exists"), "done old exists").when(~F.col("old_exists"), "done").otherwise(verdict)
        )
        out = out.withColumn("verdict", verdict).drop("old_exists")
        return out
    return out.withColumn("verdict", verdict)


def listing_platform(listing: DataFrame, by: list[str] = ()) -> DataFrame:
    """Platform that wrote a data folder, from the case of its catch-all partition files; both or none is invalid."""
    counted = listing.groupBy(*by).agg(
        F.count_if(F.col("name").rlike(r"PARTMAX.*\.ibd$")).alias("upper_files"),
        F.count_if(F.col("name").rlike(r"partmax.*\.ibd$")).alias("lower_files"),
    )
    up, low = F.col("upper_files") > 0, F.col("lower_files") > 0
    return counted.withColumn(
        "platform", F.when(up & ~low, "linux").when(low & ~up, "windows").otherwise("invalid")
    )


def table_kinds(listing: DataFrame, by: list[str] = ()) -> DataFrame:
    """Partitioned, damaged or plain metadata table, from which kinds of files it has.

    Only tables with a definition file (``.frm``) count. One grouping replaces
    three look-ups in the listing.
    """
    name = F.col("name")
    table = F.regexp_replace(F.split(name, r"#[pP]#")[0], r"\.(frm|par|ibd)$", "")
    flags = (
        listing.withColumn("table", table).groupBy(*by, "table").agg(
            F.bool_or(name.endswith(".frm")).alias("frm"),
            F.bool_or(name.endswith(".par")).alias("par"),
            F.bool_or(name.rlike("#[pP]#")).alias("pieces"),
        )
    )
    kind = F.when(F.col("par"), "partition").when(F.col("pieces"), "damaged").otherwise("metadata")
    return flags.filter("frm").select(*by, "table", kind.alias("kind"))


def latest_modified(files: DataFrame) -> DataFrame:
    return files.groupBy("table", "part").agg(F.max("mtime").alias("mtime"))


def export_status(listing: DataFrame) -> DataFrame:
    """State of each export unit from its marker files, most urgent first."""
    ext = F.substring_index("name", ".", -1)
    unit = F.regexp_replace("name", r"\.[^.]*$", "")
    found = listing.withColumn("unit", unit).withColumn("ext", ext).groupBy("unit").agg(
        *[F.bool_or(F.col("ext") == e).alias(e) for e in ("tmp", "sql", "done")]
    )
    status = (
        F.when(F.col("tmp"), "in progress").when(F.col("sql"), "exported")
        .when(F.col("done"), "imported").otherwise("to do")
    )
    return found.select("unit", status.alias("status"))


def datadir_checks(
    listing: DataFrame, by: list[str], versions: DataFrame, platform: str, min_files: int = 1100,
) -> DataFrame:
    """Is a folder a plausible data folder: enough files, right platform, valid version."""
    from ..functions.versions import is_version

    facts = listing_platform(listing, by).join(
        listing.groupBy(*by).agg(F.count("*").alias("files")), list(by)
    ).join(versions, list(by), "left")
    problem = (
        F.when(F.col("files") <= min_files, "not enough files")
        .when(F.col("platform") != platform, "wrong platform")
        .when(~F.coalesce(is_version("version"), F.lit(False)), "invalid version")
        .otherwise("ok")
    )
    return facts.withColumn("verdict", problem)
