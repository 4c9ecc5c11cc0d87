"""Queries that write and read again: captures, stores, catalogs, exports and published tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ingest
from ..functions.time import epoch_of, ts_min_of
from ..operators import capacity, relayout
from ..operators.points import to_import_lines
from ..session import materialize, scratch_path
from ..sinks import store
from ..sources import catalog
from .analytics import metadata_tables, space_projection_rollup
from .base import ORACLE, QUERIES, E, captures, query, table
from .roundtrips import VMSTAT, _vmstat_lines


def capture_folder(rows: DataFrame, monitor: str) -> str:
    """Write ``rows (host, value)`` as capture files, one or more for each host, and return their folder."""
    spark = rows.sparkSession
    path = scratch_path(spark, "captures")
    rows.select("host", "value").repartition("host").write.partitionBy("host").text(f"{path}/parts")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/parts/host=*/part-*")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for k, found in enumerate(files.globStatus(place)):
        host = found.getPath().getParent().getName().split("=", 1)[1]
        files.rename(found.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/1_{monitor}_{host}.x_{100 + k}.txt"))
    return path


@query("ingest_captures", E + " UNION ALL ".join(
    f"SELECT 'h' || (user_id % 10) AS host, '{c}' AS col, count(*) AS points, CAST(sum({x}) AS BIGINT) AS total FROM e GROUP BY 1" for c, x in VMSTAT.items()))
def ingest_captures(spark: SparkSession, sf: str) -> DataFrame:
    """Events become capture files of ten hosts; these are found, read, parsed, unpivoted, loaded by host and read from the store."""
    ev = captures(spark, sf).withColumn("host", F.concat(F.lit("h"), (F.col("user_id") % 10).cast("string")))
    folder = capture_folder(_vmstat_lines(ev), "vmstat")
    points, log = scratch_path(spark, "points"), scratch_path(spark, "load-log")
    ingest.load_all(spark, [folder], points, log, ["vmstat"], zone="UTC")
    return store.read_points(spark, points, log).groupBy("host", "col").agg(
        F.count("*").alias("points"), F.sum("value").cast("bigint").alias("total"))


@query("bulk_import_file", ORACLE["import_lines"])
def bulk_import_file(spark, sf) -> DataFrame:
    """The import lines, written compressed and read again."""
    path = scratch_path(spark, "import")
    store.write_lines(QUERIES["import_lines"](spark, sf), path, gzip=True)
    return spark.read.text(path)


@query("space_report", ORACLE["space_projection_rollup"])
def space_report(spark, sf) -> DataFrame:
    """The space projection in the order of a report."""
    return capacity.space_report(space_projection_rollup(spark, sf))


@query("metric_tables", """SELECT 'min' AS resolution, '' AS rollup, epoch_us(o_orderdate) // 60000000 AS ts_min, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY ALL
UNION ALL SELECT 'hour', '_agg_app', epoch_us(date_trunc('month', o_orderdate)) // 60000000, count(*), CAST(sum(o_custkey) AS BIGINT) FROM orders GROUP BY ALL""")
def metric_tables(spark, sf) -> DataFrame:
    """Two of the metric tables, written as snapshots and read by resolution and rollup."""
    base, orders = scratch_path(spark, "metric-tables"), table(spark, sf, "orders")
    for resolution, rollup, at in (("min", "", F.col("o_orderdate")), ("hour", "_agg_app", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz"))):
        orders.select(ts_min_of(epoch_of(at)).alias("ts_min"), F.col("o_custkey").alias("value")).write.parquet(f"{base}/metricdata_{resolution}{rollup}")
    out = None
    for resolution, rollup in (("min", ""), ("hour", "_agg_app")):
        rows = catalog.metric_table(spark, base, resolution, rollup).groupBy("ts_min").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        rows = rows.select(F.lit(resolution).alias("resolution"), F.lit(rollup).alias("rollup"), "ts_min", "n", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("catalog_snapshot", """SELECT o_orderpriority AS table_name, CAST(year(o_orderdate) AS BIGINT) AS part, count(*) AS table_rows, max(o_orderkey) % 2 = 0 AS compact
FROM orders GROUP BY 1, 2""")
def catalog_snapshot(spark, sf) -> DataFrame:
    """The catalog's views as snapshots derived from the orders, read together and joined by table and partition."""
    base, orders = scratch_path(spark, "catalog"), table(spark, sf, "orders")
    parts = orders.groupBy(F.col("o_orderpriority").alias("table_name"), F.year("o_orderdate").cast("bigint").alias("part")).agg(
        F.count("*").alias("table_rows"), (F.max("o_orderkey") % 2 == 0).alias("compact"))
    parts = materialize(parts, "parts")
    views = {
        "tables": parts.select("table_name", "part", "compact"), "partitions": parts.select("table_name", "part", "table_rows"),
        "statistics": parts.select("table_name").distinct(), "key_column_usage": parts.select("table_name").distinct(), "processlist": parts.select("part").distinct()}
    for name, rows in views.items():
        rows.write.parquet(f"{base}/{name}")
    read = catalog.catalog_tables(spark, base)
    return (
        read["tables"].join(read["partitions"], ["table_name", "part"]).join(read["statistics"], "table_name", "left_semi")
        .join(read["key_column_usage"], "table_name", "left_semi").join(read["processlist"], "part", "left_semi").select("table_name", "part", "table_rows", "compact"))


@query("metadata_copies", """WITH t AS (SELECT DISTINCT n_name AS "table" FROM nation
WHERE n_name NOT IN (SELECT 'NATION_' || (s_suppkey % 50) FROM supplier WHERE s_acctbal < 500)
  AND n_name NOT IN (SELECT 'NATION_' || r_regionkey FROM region))
SELECT n_name AS "table", count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_name IN (SELECT "table" FROM t) GROUP BY 1""")
def metadata_copies(spark, sf) -> DataFrame:
    """Each nation's suppliers are a table; those that are neither partitioned nor ignored are copied, twice, and counted in the copy."""
    source, dest = scratch_path(spark, "tables"), scratch_path(spark, "copies")
    wanted = materialize(metadata_tables(spark, sf), "wanted")
    owned = table(spark, sf, "nation").select("n_name", "n_nationkey").join(
        table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    owned = materialize(owned.join(wanted, F.col("n_name") == F.col("table"), "left_semi"), "owned")
    names = sorted(r["table"] for r in wanted.collect())  # a catalog's table names
    for name in names:
        owned.filter(F.col("n_name") == name).select("n_name", "s_suppkey").write.parquet(f"{source}/{name}")
    for _ in range(2):
        relayout.export_metadata_tables(spark, wanted, source, dest)
    if not names:
        return spark.createDataFrame([], "table string, suppliers bigint")
    copied = spark.read.schema("n_name string, s_suppkey bigint").parquet(*[f"{dest}/{n}" for n in names])
    return copied.groupBy(F.col("n_name").alias("table")).agg(F.count("s_suppkey").alias("suppliers"))


@query("last_big_order", """SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max_by(CAST(round(o_totalprice * 100) AS BIGINT), (o_orderdate, o_orderkey)) AS price
FROM orders WHERE o_totalprice > 100000 GROUP BY 1""")
def last_big_order(spark, sf) -> DataFrame:
    """The last matching row of each customer wins."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("price"), "o_totalprice")
    last = relayout.last_match(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_totalprice") > 100000)
    return last.select("o_custkey", "o_orderkey", "price")


@query("published_table", """SELECT 'new' AS version, o_orderpriority, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'old', o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 2""")
def published_table(spark, sf) -> DataFrame:
    """A rebuilt table takes the place of the old one, which is kept until it is reclaimed."""
    orders, name = table(spark, sf, "orders"), f"metrics_{uuid.uuid4().hex}"
    orders.filter("o_orderstatus = 'F'").select("o_orderpriority").write.saveAsTable(name)
    orders.select("o_orderpriority").write.saveAsTable(f"fast_{name}")
    relayout.swap_table(spark, name)
    count = lambda t, v: spark.table(t).groupBy("o_orderpriority").agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), "o_orderpriority", "n")
    result = materialize(count(name, "new").unionByName(count(f"old_{name}", "old")), "published")
    relayout.reclaim(spark, name)
    spark.sql(f"DROP TABLE {name}")
    return result
