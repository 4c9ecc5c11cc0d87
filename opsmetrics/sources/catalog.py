"""Catalogs, configuration stores and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_metric_sum, unix_lines, whole

RESOLUTIONS = ("min", "ten_min", "hour")
ROLLUPS = ("", "_agg", "_agg_app")
CATALOG_VIEWS = ("tables", "partitions", "statistics", "key_column_usage", "processlist")


def metric_table(
    spark: SparkSession, base: str, resolution: str = "min", rollup: str = "",
    jdbc: dict[str, str] | None = None, bounds: tuple[int, int, int] | None = None,
) -> DataFrame:
    """One of the nine metric tables, from Parquet below ``base`` or over JDBC.

    A JDBC read is cut on ``ts_min`` into (low, high, slices) so that no single
    connection reads the whole table.
    """
    if resolution not in RESOLUTIONS or rollup not in ROLLUPS:
        raise ValueError(f"no metric table {resolution}{rollup}")
    name = f"metricdata_{resolution}{rollup}"
    if jdbc is None:
        return spark.read.parquet(f"{base}/{name}")
    reader = spark.read.format("jdbc").options(**jdbc).option("dbtable", name)
    if bounds:
        low, high, slices = bounds
        reader = (
            reader.option("partitionColumn", "ts_min").option("lowerBound", low)
            .option("upperBound", high).option("numPartitions", slices)
        )
    return reader.load()


def catalog_tables(spark: SparkSession, base: str | None = None, jdbc: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The catalog views, from snapshots below ``base`` or over JDBC."""
    if jdbc is not None:
        return {
            v: spark.read.format("jdbc").options(**jdbc).option("dbtable", f"information_schema.{v}").load()
            for v in CATALOG_VIEWS
        }
    return {v: spark.read.parquet(f"{base}/{v}") for v in CATALOG_VIEWS}


def config_values(config: DataFrame, names: list[str], by: list[str] = ()) -> DataFrame:
    """Chosen name/value settings as columns."""
    return config.filter(F.col("name").isin(*names)).groupBy(*by).agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n.replace(".", "_")) for n in names]
    )


def parse_properties(df: DataFrame) -> DataFrame:
    """``key=value`` lines; the value may hold further ``=``."""
    keep = [c for c in df.columns if c != "value"]
    lines = df.select(*keep, F.explode(F.split(unix_lines("value"), "\n")).alias("__l"))
    cut = F.split("__l", "=", 2)
    return lines.filter(F.col("__l").contains("=")).select(
        *keep, F.trim(cut[0]).alias("name"), F.trim(cut[1]).alias("value")
    )


def ddl_partitions(df: DataFrame) -> DataFrame:
    """Table definitions (``value``) to (table, key, part, lo, hi); an open partition has a null ``hi``."""
    keep = [c for c in df.columns if c != "value"]
    less = r"PARTITION\s+`?(\w+)`?\s+VALUES\s+LESS\s+THAN\s+\(?(\w+)\)?"
    names = F.regexp_extract_all("value", F.lit(less), 1)
    limits = F.transform(F.regexp_extract_all("value", F.lit(less), 2), whole)
    ranges = F.transform(names, lambda n, i: F.struct(
        n.alias("part"),
        F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get("__limits", i - 1)).alias("lo"),
        F.get("__limits", i).alias("hi"),
    ))
    return (
        df.withColumn("value", unix_lines("value"))
        .select(*keep, "value", limits.alias("__limits"))
        .select(
            *keep, F.regexp_extract("value", r"CREATE TABLE `?(\w+)`?", 1).alias("table"),
            F.regexp_extract("value", r"PARTITION BY RANGE\s*\(`?(\w+)`?\)", 1).alias("key"),
            F.explode(ranges).alias("r"),
        )
        .select(*keep, "table", "key", "r.part", "r.lo", "r.hi")
    )


def json_lookup(df: DataFrame, name: str, json: str = "value") -> DataFrame:
    """Ids of the entries with exactly this name in JSON lists of ``{id, name}``."""
    items = F.from_json(json, "array<struct<id: bigint, name: string>>")
    keep = [c for c in df.columns if c != json]
    return df.select(*keep, F.explode(items).alias("i")).filter(F.col("i.name") == name).select(*keep, "i.id")


def metric_sum(json: Column | str) -> Column:
    return json_metric_sum(json)
