"""Query registry and the shared views of the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import epoch_of, iso, ntz_of, ts_min_of

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

START = 1704067200  # 2024-01-01T00:00:00, the first day of the event table
PACE = 2000  # event time runs this much faster where a query needs dense bursts


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL counterpart if it has one."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the helper columns the SQL side calls the same (see ``E``)."""
    return with_helpers(table(spark, sf_dir, "events"))


def spread(df: DataFrame) -> DataFrame:
    """Share out a table that arrives in fewer pieces than there are cores; a larger one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events for queries that render and parse text, where the work per row is large."""
    return with_helpers(spread(table(spark, sf_dir, "events")))


def with_helpers(df: DataFrame) -> DataFrame:
    epoch = epoch_of("ts")
    return (
        df.withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
        .withColumn("host", F.concat(F.lit("h"), F.col("user_id").cast("string")))
        .withColumn("iso", iso("ts"))
        .withColumn("epoch", epoch)
        .withColumn("ts_min", ts_min_of(epoch))
        .withColumn("fast", F.floor((epoch - START) / F.lit(PACE)).cast("bigint") + START)
    )


# The same helper columns in SQL.
E = f"""WITH e AS (
  SELECT *, epoch // 60 AS ts_min, (epoch - {START}) // {PACE} + {START} AS fast FROM (
    SELECT *, CAST(round(value * 100) AS BIGINT) AS cents, 'h' || user_id AS host,
           strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, epoch_us(ts) // 1000000 AS epoch
    FROM events))
"""


def fast_iso():
    return iso(ntz_of("fast"))


FAST_ISO = "strftime(make_timestamp(fast * 1000000), '%Y-%m-%dT%H:%M:%S')"

# Rows of a CTE ``r(k, t, ..)`` numbered in bursts; ``rn`` orders each ``k``.
BURSTS = """, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {order}) AS rn FROM r)
, b AS (
  SELECT o.*, t AS anchor, CAST(1 AS BIGINT) AS buffer FROM o WHERE rn = 1
  UNION ALL
  SELECT o.*, CASE WHEN o.t - b.anchor <= 15 AND b.buffer < 4 THEN b.anchor ELSE o.t END,
         CASE WHEN o.t - b.anchor <= 15 AND b.buffer < 4 THEN b.buffer + 1 ELSE 1 END
  FROM b JOIN o ON o.k = b.k AND o.rn = b.rn + 1)
"""


def recursive(sql: str) -> str:
    return sql.replace("WITH e AS", "WITH RECURSIVE e AS", 1)
