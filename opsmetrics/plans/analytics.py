"""Fleet, saturation, capacity, re-layout and health queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import SCHEDULES, defer_for_boundary, epoch_of, next_boundary, ts_min_of
from ..operators import capacity, fleet, health, relayout, rules, saturation
from ..operators.bursts import burst_numbers, spaced_picks
from ..operators.ordered import collapse_repeats, row_numbers, time_slice
from ..session import materialize
from .base import BURSTS, E, events, query, recursive, table

# --------------------------------------------------------------------------- fleet


def _ship_fact(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("node_id"), ts_min_of(epoch_of("l_shipdate")).alias("ts_min"))


def _order_fact(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("node_id"), ts_min_of(epoch_of("o_orderdate")).alias("ts_min"))


ACTIVE = """active AS (SELECT DISTINCT l_suppkey AS node_id FROM lineitem
  WHERE epoch_us(l_shipdate) // 60000000 > (SELECT max(epoch_us(l_shipdate) // 60000000) FROM lineitem) - 1440 * 30)"""


@query("active_nodes", f"WITH {ACTIVE} SELECT node_id FROM active")
def active_nodes(spark, sf) -> DataFrame:
    return fleet.active_nodes(_ship_fact(spark, sf))


@query("agent_versions", f"""WITH {ACTIVE}
SELECT '4.' || n_regionkey || '.' || (n_nationkey % 3) || '.0' AS compat,
       left('Agent v4.' || n_regionkey || ' compatible with release of ' || n_name || ' and later builds of it', 60) AS version,
       count(*) AS agents
FROM supplier JOIN active ON s_suppkey = node_id JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def agent_versions(spark, sf) -> DataFrame:
    mapping = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").alias("agent_id"))
    agents = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("id"), F.lit(4).alias("major_release"), F.col("n_regionkey").alias("minor_release"),
        (F.col("n_nationkey") % 3).alias("point_release"), F.lit(0).alias("agent_point_release"),
        F.concat(F.lit("Agent v4."), F.col("n_regionkey").cast("string"), F.lit(" compatible with release of "),
                 F.col("n_name"), F.lit(" and later builds of it")).alias("agent_version"))
    return fleet.agent_versions(active_nodes(spark, sf), mapping, agents)


@query("locate_agents", """WITH active AS (SELECT DISTINCT o_custkey AS node_id FROM orders
  WHERE epoch_us(o_orderdate) // 60000000 > (SELECT max(epoch_us(o_orderdate) // 60000000) FROM orders) - 1440 * 365)
SELECT r_name AS app_name, n_name AS tier_name, c_name AS node_name, s_name AS machine_name,
       '10.0.0.' || s_suppkey AS ip_address, 'host-' || s_suppkey AS internal_name
FROM customer JOIN active ON c_custkey = node_id
JOIN part ON p_partkey = c_custkey AND p_size % 5 = 4 AND p_size % 2 = 1
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
JOIN supplier ON s_suppkey = c_custkey % 100""")
def locate_agents(spark, sf) -> DataFrame:
    customer = table(spark, sf, "customer")
    agents = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.lit(4).alias("major_release"), (F.col("p_size") % 5).alias("minor_release"),
        (F.col("p_size") % 2).alias("point_release"), F.lit(0).alias("agent_point_release"))
    nodes = customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        (F.col("c_custkey") % 100).alias("machine_instance_id"), F.col("c_nationkey").alias("application_component_id"))
    tiers = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("application_id"))
    apps = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    machines = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lit("10.0.0."), F.col("s_suppkey").cast("string")).alias("ip_address"),
        F.concat(F.lit("host-"), F.col("s_suppkey").cast("string")).alias("internal_name"))
    mapping = customer.select(F.col("c_custkey").alias("node_id"), F.col("c_custkey").alias("agent_id"))
    active = fleet.active_nodes(_order_fact(spark, sf), days=365)
    return fleet.locate_agents(active, mapping, agents, nodes, tiers, apps, machines, (4, 4, 1, 0))


@query("unpartitioned_tables", """SELECT o_orderstatus || '.' || o_orderkey AS full_name,
  CAST(floor(o_totalprice) AS BIGINT) AS table_rows
FROM orders JOIN lineitem ON l_linestatus = o_orderstatus AND l_orderkey = o_orderkey
WHERE l_returnflag = 'N' AND o_orderpriority < '3'""")
def unpartitioned_tables(spark, sf) -> DataFrame:
    tables = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("table_schema"), F.col("o_orderkey").cast("string").alias("table_name"),
        F.when(F.col("o_orderpriority") < "3", "Compact").otherwise("Dynamic").alias("row_format"),
        F.floor("o_totalprice").cast("bigint").alias("table_rows"))
    partitions = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("table_schema"), F.col("l_orderkey").cast("string").alias("table_name"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("PART"), F.col("l_linenumber").cast("string")))
        .alias("partition_name"))
    return fleet.compact_unpartitioned(tables, partitions)


# --------------------------------------------------------------------------- saturation

RATES = ", rates AS (SELECT event_type, ts_min, count(*) AS rate FROM e GROUP BY 1, 2) "


def _rates(spark, sf):
    return saturation.metrics_per_minute(events(spark, sf), ["event_type"])


@query("metrics_per_minute", E + "SELECT ts_min, count(*) AS rate FROM e GROUP BY 1")
def metrics_per_minute(spark, sf) -> DataFrame:
    return saturation.metrics_per_minute(events(spark, sf))


@query("rate_minutes_ago", """WITH n AS (SELECT max(epoch_us(l_shipdate) // 60000000) AS now_min FROM lineitem)
SELECT l_returnflag, now_min - 43200 AS ts_min, count(*) AS rate FROM lineitem, n WHERE epoch_us(l_shipdate) // 60000000 = now_min - 43200 GROUP BY 1, 2""")
def rate_minutes_ago(spark, sf) -> DataFrame:
    fact = table(spark, sf, "lineitem").withColumn("ts_min", ts_min_of(epoch_of("l_shipdate")))
    newest = fact.agg(F.max("ts_min")).scalar()
    return saturation.rate_at(saturation.metrics_per_minute(fact, ["l_returnflag"]), newest, 43200)


@query("saturated_nongrowing", E + RATES + """, p AS (
  SELECT *, coalesce(lag(rate, 1) OVER w, 0) AS prev1, coalesce(lag(rate, 2) OVER w, 0) AS prev2 FROM rates
  WINDOW w AS (PARTITION BY event_type ORDER BY ts_min))
SELECT event_type, ts_min, rate, prev1, prev2, prev2 >= prev1 AND prev2 >= rate AS saturated FROM p""")
def saturated_nongrowing(spark, sf) -> DataFrame:
    return saturation.saturated_by_samples(_rates(spark, sf), ["event_type"])


@query("saturated_contiguous", E + RATES + """
SELECT a.event_type, a.ts_min, a.rate, coalesce(b.rate, 0) AS prev1, coalesce(c.rate, 0) AS prev2,
       coalesce(c.rate, 0) > coalesce(b.rate, 0) AND coalesce(c.rate, 0) > a.rate AS saturated
FROM rates a LEFT JOIN rates b ON b.event_type = a.event_type AND b.ts_min = a.ts_min - 1
LEFT JOIN rates c ON c.event_type = a.event_type AND c.ts_min = a.ts_min - 2""")
def saturated_contiguous(spark, sf) -> DataFrame:
    return saturation.saturated_by_minutes(_rates(spark, sf), ["event_type"])


@query("dropped_total", E + """SELECT event_type,
  CAST(coalesce(sum(cents) FILTER (WHERE ts_min > (SELECT max(ts_min) FROM e) - 720), 0) AS BIGINT) AS dropped,
  coalesce(sum(cents) FILTER (WHERE ts_min > (SELECT max(ts_min) FROM e) - 720), 0) > 0 AS saturated
FROM e GROUP BY 1""")
def dropped_total(spark, sf) -> DataFrame:
    return saturation.saturated_by_drops(events(spark, sf), ["event_type"], "cents", minutes=720)


# --------------------------------------------------------------------------- capacity

# Metric-table names given to the line items, one per (return flag, line status).
TABLE_OF = """CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'metricdata_min' WHEN 'AO' THEN 'metricdata_ten_min'
  WHEN 'NF' THEN 'metricdata_hour' WHEN 'NO' THEN 'requestdata_summary' WHEN 'RF' THEN 'machine_snapshot_detail'
  ELSE 'audit_trail' END"""
LISTING = f"""f AS (SELECT {TABLE_OF} AS "table", strftime(l_shipdate, '%Y%m') AS ym,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS size, epoch_us(l_shipdate) // 1000000 AS mtime FROM lineitem)"""


def _listing(spark, sf):
    """Line items as a listing of partition files."""
    part = F.concat(F.lit("PART"), (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("string"))
    return table(spark, sf, "lineitem").select(
        F.concat(F.expr(TABLE_OF), F.lit("#P#"), part, F.lit("#SP#"), part, F.lit("sp"),
                 (F.col("l_linenumber") % 4).cast("string"), F.lit(".ibd")).alias("name"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("size"),
        epoch_of("l_shipdate").alias("mtime"))


# Settings read off the nation table: seven retention names, the rest unrelated.
SETTING = """CASE n_nationkey WHEN 0 THEN 'metrics.min.retention.period' WHEN 1 THEN 'metrics.ten.min.retention.period'
  WHEN 2 THEN 'metrics.retention.period' WHEN 3 THEN 'snapshots.retention.period' WHEN 4 THEN 'tss.retention.period'
  WHEN 5 THEN 'machine.snapshots.retention.period' WHEN 6 THEN 'events.retention.period' ELSE lower(n_name) || '.period' END"""
KEPT = f"""c AS (SELECT {SETTING} AS name, n_nationkey * 7 + 5 AS v FROM nation)
, kept AS (
  SELECT 'minute' AS "group", v * 6 AS retained FROM c WHERE name = 'metrics.min.retention.period'
  UNION ALL SELECT 'ten_min', v // 2 FROM c WHERE name = 'metrics.ten.min.retention.period'
  UNION ALL SELECT 'hourly', v FROM c WHERE name = 'metrics.retention.period'
  UNION ALL SELECT 'snapshot', v FROM c WHERE name = 'snapshots.retention.period'
  UNION ALL SELECT 'process snapshot', v FROM c WHERE name = 'snapshots.retention.period'
  UNION ALL SELECT 'tss', v FROM c WHERE name = 'tss.retention.period'
  UNION ALL SELECT 'machine snapshot', v FROM c WHERE name = 'machine.snapshots.retention.period'
  UNION ALL SELECT 'event', v FROM c WHERE name = 'events.retention.period')"""
GROUP_OF = """CASE WHEN "table" LIKE '%metricdata_min%' THEN 'minute' WHEN "table" LIKE '%metricdata_ten_min%' THEN 'ten_min'
  WHEN "table" LIKE '%metricdata_hour%' THEN 'hourly' WHEN "table" LIKE '%machine_snapshot%' THEN 'machine snapshot'
  WHEN "table" LIKE '%eventdata%' THEN 'event' WHEN "table" LIKE '%requestdata%' THEN 'snapshot'
  WHEN "table" LIKE '%process_snapshot%' THEN 'process snapshot' WHEN "table" LIKE '%top_summary%' THEN 'tss' ELSE 'other' END"""


def _config(spark, sf):
    return table(spark, sf, "nation").select(
        F.expr(SETTING).alias("name"), (F.col("n_nationkey") * 7 + 5).cast("string").alias("value"))


@query("partition_files", f"""WITH {LISTING} SELECT "table", 'PART' || ym AS part, count(*) AS files,
  CAST(sum(size) AS BIGINT) AS size FROM f GROUP BY 1, 2""")
def partition_files(spark, sf) -> DataFrame:
    return capacity.partition_files(_listing(spark, sf)).groupBy("table", "part").agg(
        F.count("*").alias("files"), F.sum("size").alias("size"))


@query("space_by_table", f"""WITH {LISTING} SELECT "table", CAST(sum(size) AS BIGINT) AS size, max(size) AS max_size,
  count(*) AS files, {GROUP_OF} AS "group" FROM f GROUP BY 1""")
def space_by_table(spark, sf) -> DataFrame:
    return capacity.space_by_table(capacity.partition_files(_listing(spark, sf)))


@query("retention_settings", f'WITH {KEPT} SELECT "group", CAST(retained AS BIGINT) AS retained FROM kept')
def retention_settings(spark, sf) -> DataFrame:
    return capacity.retention_settings(_config(spark, sf))


@query("config_values", """SELECT CAST(2 * 7 + 5 AS VARCHAR) AS metrics_retention_period,
  CAST((SELECT n_nationkey * 7 + 5 FROM nation WHERE n_nationkey = 4) AS VARCHAR) AS tss_retention_period""")
def config_values(spark, sf) -> DataFrame:
    from ..sources.catalog import config_values as values

    return values(_config(spark, sf), ["metrics.retention.period", "tss.retention.period"])


@query("space_projection_rollup", f"""WITH {LISTING}, {KEPT}
, t AS (SELECT "table", {GROUP_OF} AS "group", sum(size) AS size, max(size) AS max_size, count(*) AS files,
    CASE WHEN "table" IN ('metricdata_min', 'metricdata_ten_min') THEN 4 ELSE 1 END AS sub FROM f GROUP BY 1)
, p AS (SELECT t.*, coalesce(retained, 0) AS retained, files // sub AS parts,
    max_size * coalesce(retained, 0) * sub AS projection FROM t LEFT JOIN kept ON kept."group" = t."group")
, r AS (SELECT "group", "table", sum(parts) AS parts, max(retained) AS retained, max(max_size) AS max_size,
    sum(size) AS size, sum(projection) AS projection, grouping("group", "table") AS gid FROM p GROUP BY ROLLUP ("group", "table"))
SELECT "group", "table", CASE WHEN gid = 0 THEN CAST(parts AS BIGINT) END AS parts,
  CASE WHEN gid < 2 THEN CAST(retained AS BIGINT) END AS retained,
  CASE WHEN gid = 0 THEN CAST(max_size AS BIGINT) END AS max_size, CAST(size AS BIGINT) AS size,
  CAST(projection AS BIGINT) AS projection, CASE gid WHEN 0 THEN 'table' WHEN 1 THEN 'group' ELSE 'total' END AS level FROM r""")
def space_projection_rollup(spark, sf) -> DataFrame:
    return capacity.project_space(capacity.partition_files(_listing(spark, sf)), _config(spark, sf))


@query("space_check", f"""WITH {LISTING}, u AS (SELECT "table", CAST(sum(size // 1000) // 1024 AS BIGINT) AS used_mb FROM f GROUP BY 1)
, fr AS (SELECT {TABLE_OF} AS "table", count(*) // 3 AS free_mb, bool_or(l_returnflag = 'R') AS is_done,
    bool_or(l_linestatus = 'O') AS old_exists FROM lineitem GROUP BY 1)
SELECT u."table", used_mb, free_mb, CAST(floor(used_mb * 1.2) AS BIGINT) AS needed_mb,
  CASE WHEN is_done AND old_exists THEN 'done old exists' WHEN is_done THEN 'done'
       WHEN floor(used_mb * 1.2) < free_mb THEN 'space ok' ELSE 'space short' END AS verdict
FROM u JOIN fr ON fr."table" = u."table" """)
def space_check(spark, sf) -> DataFrame:
    files = capacity.partition_files(_listing(spark, sf)).select("table", F.floor(F.col("size") / 1000).cast("bigint").alias("kb"))
    per = table(spark, sf, "lineitem").groupBy(F.expr(TABLE_OF).alias("table")).agg(
        F.floor(F.count("*") / 3).cast("bigint").alias("free_mb"), F.bool_or(F.col("l_returnflag") == "R").alias("is_done"),
        F.bool_or(F.col("l_linestatus") == "O").alias("old_exists"))
    return capacity.space_check(
        files, per.select("table", "free_mb"), per.filter("is_done").select("table", "old_exists"))


@query("latest_modified", f"""WITH {LISTING} SELECT "table", 'PART' || ym AS part, max(mtime) AS mtime FROM f GROUP BY 1, 2""")
def latest_modified(spark, sf) -> DataFrame:
    return capacity.latest_modified(capacity.partition_files(_listing(spark, sf)))


# Documents as files of a data folder: the language tells the kind of file, the source the table.
FILE_OF = """CASE lang WHEN 'en' THEN source || '.frm' WHEN 'fr' THEN source || '#P#part' || (doc_id % 7) || '.ibd'
  WHEN 'de' THEN source || '#p#partmax' || (doc_id % 3) || '.ibd' ELSE source || '.par' END"""
FOLDER_OF = "'d' || (n_chars % 40)"


def _folder(spark, sf):
    return table(spark, sf, "documents").select(
        F.expr(FILE_OF).alias("name"), F.expr("concat('d', cast(n_chars % 40 as string))").alias("folder"))


@query("table_kind", f"""WITH x AS (SELECT {FOLDER_OF} AS folder, {FILE_OF} AS name, source FROM documents)
SELECT folder, source AS "table", CASE WHEN bool_or(name LIKE '%.par') THEN 'partition'
  WHEN bool_or(lower(name) LIKE '%#p#%') THEN 'damaged' ELSE 'metadata' END AS kind
FROM x GROUP BY 1, 2 HAVING bool_or(name LIKE '%.frm')""")
def table_kind(spark, sf) -> DataFrame:
    return capacity.table_kinds(_folder(spark, sf), ["folder"])


UPPER_OF = """CASE WHEN n_chars % 3 = 0 THEN source || '#P#PARTMAX#SP#PARTMAXsp0.ibd' WHEN n_chars % 3 = 1
  THEN source || '#p#partmax#sp#partmaxsp0.ibd' ELSE source || '.frm' END"""
PLATFORM = f"""WITH x AS (SELECT source AS folder, {UPPER_OF} AS name FROM documents)
, g AS (SELECT folder, count(*) FILTER (WHERE name LIKE '%PARTMAX%.ibd') AS upper_files,
  count(*) FILTER (WHERE name LIKE '%partmax%.ibd') AS lower_files, count(*) AS files FROM x GROUP BY 1)
, p AS (SELECT *, CASE WHEN upper_files > 0 AND lower_files = 0 THEN 'linux'
  WHEN lower_files > 0 AND upper_files = 0 THEN 'windows' ELSE 'invalid' END AS platform FROM g) """
LANG_UPPER = """CASE WHEN lang IN ('en', 'fr') AND doc_id % 2 = 0 THEN 'a#P#PARTMAX#SP#PARTMAXsp0.ibd'
  WHEN lang = 'de' THEN 'a#p#partmax#sp#partmaxsp0.ibd' ELSE 'a.frm' END"""


@query("platform_kind", f"""WITH x AS (SELECT source || lang AS folder, {LANG_UPPER} AS name FROM documents)
, g AS (SELECT folder, count(*) FILTER (WHERE name LIKE '%PARTMAX%.ibd') AS upper_files,
  count(*) FILTER (WHERE name LIKE '%partmax%.ibd') AS lower_files FROM x GROUP BY 1)
SELECT *, CASE WHEN upper_files > 0 AND lower_files = 0 THEN 'linux' WHEN lower_files > 0 AND upper_files = 0 THEN 'windows'
  ELSE 'invalid' END AS platform FROM g""")
def platform_kind(spark, sf) -> DataFrame:
    listing = table(spark, sf, "documents").select(
        F.concat("source", "lang").alias("folder"), F.expr(LANG_UPPER).alias("name"))
    return capacity.listing_platform(listing, ["folder"])


@query("datadir_check", PLATFORM + """SELECT p.*, v.version, CASE WHEN files <= 20 THEN 'not enough files'
  WHEN platform <> 'linux' THEN 'wrong platform' WHEN NOT coalesce(regexp_matches(version, '^[0-9]+[.][0-9]+[.][0-9]+([.][0-9]+)?$'), false)
  THEN 'invalid version' ELSE 'ok' END AS verdict
FROM p LEFT JOIN (SELECT source AS folder, max(CASE WHEN n_chars % 2 = 0 THEN '4.5.' || (n_chars % 9) ELSE '4.' || (n_chars % 9) END) AS version
  FROM documents GROUP BY 1) v ON v.folder = p.folder""")
def datadir_check(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    listing = docs.select(F.col("source").alias("folder"), F.expr(UPPER_OF).alias("name"))
    versions = docs.groupBy(F.col("source").alias("folder")).agg(F.max(F.expr(
        "CASE WHEN n_chars % 2 = 0 THEN '4.5.' || (n_chars % 9) ELSE '4.' || (n_chars % 9) END")).alias("version"))
    return capacity.datadir_checks(listing, ["folder"], versions, "linux", 20)


@query("export_status", """WITH x AS (SELECT source || '-' || (doc_id % 97) AS unit,
  CASE n_chars % 4 WHEN 0 THEN 'tmp' WHEN 1 THEN 'sql' WHEN 2 THEN 'done' ELSE 'list' END AS ext FROM documents)
SELECT unit, CASE WHEN bool_or(ext = 'tmp') THEN 'in progress' WHEN bool_or(ext = 'sql') THEN 'exported'
  WHEN bool_or(ext = 'done') THEN 'imported' ELSE 'to do' END AS status FROM x GROUP BY 1""")
def export_status(spark, sf) -> DataFrame:
    name = """source || '-' || (doc_id % 97) || '.' ||
      CASE n_chars % 4 WHEN 0 THEN 'tmp' WHEN 1 THEN 'sql' WHEN 2 THEN 'done' ELSE 'list' END"""
    return capacity.export_status(table(spark, sf, "documents").select(F.expr(name).alias("name")))


# --------------------------------------------------------------------------- re-layout
# Orders as metric rows: the priority is the table, minutes of the order date the key, years its partitions.

YEARS = """cat AS (SELECT DISTINCT o_orderpriority AS "table", year(o_orderdate) AS y FROM orders)
, lim AS (SELECT "table", 'PART' || y AS part, epoch_us(make_timestamp(y + 1, 1, 1, 0, 0, 0.0)) // 60000000 AS hi FROM cat
  UNION ALL SELECT DISTINCT "table", 'PARTMAX', NULL FROM cat)
, bounds AS (SELECT "table", part, coalesce(lag(hi) OVER (PARTITION BY "table" ORDER BY hi NULLS LAST), 0) AS lo, hi FROM lim)
, rows_ AS (SELECT *, o_orderpriority AS "table", epoch_us(o_orderdate) // 60000000 AS ts_min FROM orders)
, placed AS (SELECT r.*, b.part, b.lo, b.hi FROM rows_ r JOIN bounds b ON b."table" = r."table"
    AND r.ts_min >= b.lo AND (b.hi IS NULL OR r.ts_min < b.hi))
"""
# The destination lacks every third order, and all orders of the newest months.
IN_DEST = "o_orderkey % 3 <> 0 AND o_orderdate < TIMESTAMP '2000-06-01 00:00:00'"
IN_DEST_NTZ = "o_orderkey % 3 <> 0 AND o_orderdate < TIMESTAMP_NTZ '2000-06-01 00:00:00'"
MARKS = f""", marks AS (SELECT b."table", b.part, b.lo, b.hi, coalesce(max(p.ts_min), 0) AS src_max,
    coalesce(max(p.ts_min) FILTER (WHERE {IN_DEST}), 0) AS dest_max
  FROM bounds b LEFT JOIN placed p ON p."table" = b."table" AND p.part = b.part GROUP BY ALL)
"""


def _metric_rows(spark, sf):
    return table(spark, sf, "orders").withColumn("table", F.col("o_orderpriority")).withColumn(
        "ts_min", ts_min_of(epoch_of("o_orderdate")))


def _catalog(spark, sf) -> DataFrame:
    """Partition catalog of the orders, one row per sub-partition, stored so that its size is known."""
    year = F.year("o_orderdate")
    closed = _metric_rows(spark, sf).groupBy("table", year.alias("y")).agg(F.count("*").alias("table_rows")).select(
        "table", F.concat(F.lit("PART"), F.col("y").cast("string")).alias("part"), "table_rows",
        ts_min_of(epoch_of(F.make_timestamp_ntz(F.col("y") + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))))
        .cast("string").alias("limit"))
    both = closed.select("table", F.explode(F.array(
        F.struct("part", "table_rows", "limit"),
        F.struct(F.lit("PARTMAX").alias("part"), F.lit(0).cast("bigint").alias("table_rows"), F.lit("MAXVALUE").alias("limit")),
    )).alias("r")).select("table", "r.*")
    return materialize(both, "catalog")


def _bounds(spark, sf):
    return materialize(relayout.partition_bounds(_catalog(spark, sf)), "bounds")


@query("catalog_partitions", """WITH c AS (SELECT o_orderpriority AS "table", year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT "table", 'PART' || y AS part, n AS table_rows, epoch_us(make_timestamp(y + 1, 1, 1, 0, 0, 0.0)) // 60000000 AS "limit" FROM c
UNION ALL SELECT DISTINCT "table", 'PARTMAX', 0, CAST(NULL AS BIGINT) FROM c""")
def catalog_partitions(spark, sf) -> DataFrame:
    return relayout.catalog_partitions(_catalog(spark, sf))


@query("partition_bounds", f'WITH {YEARS} SELECT "table", part, lo, hi FROM bounds')
def partition_bounds(spark, sf) -> DataFrame:
    return relayout.partition_bounds(_catalog(spark, sf))


@query("row_to_partition", f'WITH {YEARS} SELECT o_orderkey, "table", ts_min, part FROM placed')
def row_to_partition(spark, sf) -> DataFrame:
    return relayout.assign_partition(
        _metric_rows(spark, sf), _bounds(spark, sf), "ts_min", ["table"], bin_width=43200
    ).select("o_orderkey", "table", "ts_min", "part")


@query("one_partition_rows", """SELECT o_orderkey, epoch_us(o_orderdate) // 60000000 AS ts_min FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'""")
def one_partition_rows(spark, sf) -> DataFrame:
    lo, hi = 852076800 // 60, 883612800 // 60
    return _metric_rows(spark, sf).filter(relayout.in_partition("ts_min", lo, hi)).select("o_orderkey", "ts_min")


@query("copy_watermarks", f"""WITH {YEARS}{MARKS} SELECT "table", part, src_max, dest_max, src_max - dest_max AS behind,
  'ts_min >= ' || lo || coalesce(' and ts_min < ' || hi, '') AS "range" FROM marks""")
def copy_watermarks(spark, sf) -> DataFrame:
    src = _metric_rows(spark, sf)
    return relayout.copy_report(src, src.filter(IN_DEST_NTZ), _bounds(spark, sf), on=["table"])


@query("partition_report_lines", f"""WITH {YEARS}{MARKS} SELECT printf('%-11s %8d %8d %8d %s', part, src_max, dest_max, src_max - dest_max,
  'ts_min >= ' || lo || coalesce(' and ts_min < ' || hi, '')) AS value FROM marks""")
def partition_report_lines(spark, sf) -> DataFrame:
    return relayout.format_partition_report(copy_watermarks(spark, sf))


@query("copy_missing_rows", f"""WITH {YEARS}{MARKS} SELECT o_orderkey, p."table", ts_min, o_totalprice FROM placed p
JOIN marks m ON m."table" = p."table" AND m.part = p.part AND m.src_max > m.dest_max AND p.part <> 'PARTMAX'
WHERE NOT ({IN_DEST})""")
def copy_missing_rows(spark, sf) -> DataFrame:
    src = _metric_rows(spark, sf)
    return relayout.copy_new_rows(
        src, src.filter(IN_DEST_NTZ), _bounds(spark, sf), ["o_orderkey"], on=["table"], unique_source=True
    ).select("o_orderkey", "table", "ts_min", "o_totalprice")


@query("copy_fill_holes", f"""WITH {YEARS} SELECT o_orderkey, "table", ts_min, o_totalprice FROM placed
WHERE NOT ({IN_DEST}) AND part <> 'PARTMAX'""")
def copy_fill_holes(spark, sf) -> DataFrame:
    src = _metric_rows(spark, sf)
    return relayout.copy_new_rows(
        src, src.filter(IN_DEST_NTZ), _bounds(spark, sf), ["o_orderkey"], on=["table"], fill_holes=True
    ).select("o_orderkey", "table", "ts_min", "o_totalprice")


@query("copy_duplicate_keys", """WITH s AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_returnflag FROM lineitem)
, f AS (SELECT l_orderkey, l_linenumber, min((price, l_returnflag)) AS m FROM s GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, m[1] AS price, m[2] AS l_returnflag FROM f
WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_quantity < 5)""")
def copy_duplicate_keys(spark, sf) -> DataFrame:
    src = table(spark, sf, "lineitem")
    pk = ["l_orderkey", "l_linenumber"]
    rows = src.select(*pk, F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"), "l_returnflag")
    return relayout.first_per_key(rows, pk).join(src.filter("l_quantity < 5").select(*pk), pk, "left_anti")


@query("copy_status", f"""WITH {YEARS}{MARKS}, c AS (SELECT "table", count(*) FILTER (WHERE src_max = dest_max) AS done, count(*) AS total FROM marks GROUP BY 1)
, s AS (SELECT DISTINCT "table", left("table", 1) IN ('1', '2') AS new, left("table", 1) <> '5' AS dest, left("table", 1) = '2' AS old FROM marks)
SELECT s."table", CASE WHEN new AND old THEN 'done old exists' WHEN new THEN 'done'
  WHEN dest THEN 'working ' || done || ' of ' || total ELSE 'original ' || total || ' partitions' END AS status, done, total
FROM s JOIN c ON c."table" = s."table" """)
def copy_status(spark, sf) -> DataFrame:
    src, bounds = _metric_rows(spark, sf), _bounds(spark, sf)
    report = relayout.copy_report(src, src.filter(IN_DEST_NTZ), bounds, on=["table"])
    first = F.left("table", F.lit(1))
    tables = bounds.select("table").distinct().select(
        "table", first.isin("1", "2").alias("key_is_new"), (first != "5").alias("dest_exists"), (first == "2").alias("old_exists"))
    return relayout.relayout_status(report, tables)


# Source and destination catalogs over the same orders: the destination misses later years and knows older ones.
# Finished orders as one side, all others as the other.
FINISHED, OPEN = "o_orderstatus = 'F'", "o_orderstatus <> 'F'"
DIFF = """WITH s AS (SELECT DISTINCT o_orderpriority AS "table", 'PART' || strftime(o_orderdate, '%Y%m') AS part,
    epoch_us(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) // 60000000 AS hi, o_orderstatus FROM orders)
, a AS (SELECT DISTINCT "table", part, hi FROM s WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT "table", part, hi FROM s WHERE o_orderstatus <> 'F')
"""


def _tight_bounds(spark, sf, which: str) -> DataFrame:
    """Bounds whose limits are the day after the newest order of each month."""
    catalog = table(spark, sf, "orders").filter(which).groupBy(
        F.col("o_orderpriority").alias("table"),
        F.concat(F.lit("PART"), (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("string")).alias("part"),
    ).agg((ts_min_of(epoch_of(F.max("o_orderdate"))) + 1440).alias("limit"))
    return relayout.partition_bounds(catalog)


def _month_catalog(spark, sf, which: str) -> DataFrame:
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    following = F.add_months(month.cast("date"), 1).cast("timestamp_ntz")
    return table(spark, sf, "orders").filter(which).select(
        F.col("o_orderpriority").alias("table"),
        F.concat(F.lit("PART"), (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("string")).alias("part"),
        ts_min_of(epoch_of(following)).alias("limit")).distinct()


@query("partition_diff", DIFF + """SELECT "table", part, 'drop' AS action, CAST(NULL AS BIGINT) AS "limit" FROM b
  WHERE ("table", part) NOT IN (SELECT ("table", part) FROM a)
UNION ALL SELECT "table", part, 'add', hi FROM a WHERE ("table", part) NOT IN (SELECT ("table", part) FROM b)""")
def partition_diff(spark, sf) -> DataFrame:
    return relayout.partition_diff(_month_catalog(spark, sf, FINISHED), _month_catalog(spark, sf, OPEN), ["table"])


TIGHT = """SELECT "table", part, coalesce(lag(hi) OVER (PARTITION BY "table" ORDER BY hi), 0) AS lo, hi FROM (
  SELECT o_orderpriority AS "table", 'PART' || strftime(o_orderdate, '%Y%m') AS part, max(epoch_us(o_orderdate)) // 60000000 + 1440 AS hi
  FROM orders WHERE {s} GROUP BY 1, 2)"""


@query("bound_mismatches", f"""WITH x AS ({TIGHT.format(s=FINISHED)}), y AS ({TIGHT.format(s=OPEN)})
SELECT x."table", x.part, x.lo, x.hi, y.lo AS dest_lo, y.hi AS dest_hi FROM x JOIN y ON x."table" = y."table" AND x.part = y.part
WHERE x.lo <> y.lo OR x.hi <> y.hi""")
def bound_mismatches(spark, sf) -> DataFrame:
    return relayout.bound_mismatches(_tight_bounds(spark, sf, FINISHED), _tight_bounds(spark, sf, OPEN), ["table"])


@query("key_columns_listagg", """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey AS "table", string_agg('`c' || l_linenumber || '`', ',' ORDER BY l_linenumber) AS key FROM d GROUP BY 1""")
def key_columns_listagg(spark, sf) -> DataFrame:
    catalog = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("table"), F.col("l_linenumber").alias("ordinal"),
        F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("column"))
    return relayout.key_columns(catalog)


@query("partition_name_list", """WITH d AS (SELECT DISTINCT o_orderpriority AS "table", 'PART' || year(o_orderdate) AS part FROM orders)
SELECT "table", '(' || string_agg('''' || part || '''', ',' ORDER BY part) || ')' AS parts FROM d GROUP BY 1""")
def partition_name_list(spark, sf) -> DataFrame:
    return relayout.partition_names(_catalog(spark, sf).filter(F.col("part") != relayout.OPEN_PART))


@query("metadata_tables", """SELECT DISTINCT n_name AS "table" FROM nation
WHERE n_name NOT IN (SELECT 'NATION_' || (s_suppkey % 50) FROM supplier WHERE s_acctbal < 500)
  AND n_name NOT IN (SELECT 'NATION_' || r_regionkey FROM region)""")
def metadata_tables(spark, sf) -> DataFrame:
    def named(df, key):
        return df.select(F.concat(F.lit("NATION_"), key.cast("string")).alias("table"))
    partitioned = named(table(spark, sf, "supplier").filter("s_acctbal < 500"), F.col("s_suppkey") % 50)
    ignore = named(table(spark, sf, "region"), F.col("r_regionkey"))
    return relayout.metadata_tables(table(spark, sf, "nation").select(F.col("n_name").alias("table")), partitioned, ignore)


@query("interleaved_worklist", """SELECT o_orderpriority AS "table", o_orderkey,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn FROM orders""")
def interleaved_worklist(spark, sf) -> DataFrame:
    units = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("table"), "o_orderkey")
    return relayout.interleaved(units, "table", ["o_orderkey"], F.floor(F.col("o_orderkey") / 4096).cast("bigint"))


@query("pending_batch", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def pending_batch(spark, sf) -> DataFrame:
    return relayout.pending_batch(
        table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), 200, [F.desc("o_orderdate"), F.col("o_orderkey")])


# --------------------------------------------------------------------------- health


@query("keep_newest_k", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events)
WHERE rk <= 5""")
def keep_newest_k(spark, sf) -> DataFrame:
    return health.keep_newest(
        table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


BUFFERS = recursive(E) + ", r AS (SELECT host AS k, fast AS t, event_id, cents FROM e)" + BURSTS.format(order="t, event_id")


def _buffers(spark, sf):
    return burst_numbers(
        events(spark, sf).select("host", "fast", "event_id", "cents"), ["host"], "fast", ["event_id"], slice_seconds=300)


@query("buffer_numbers", BUFFERS + "SELECT k AS host, t AS epoch, event_id, buffer FROM b")
def buffer_numbers(spark, sf) -> DataFrame:
    return _buffers(spark, sf).select("host", F.col("fast").alias("epoch"), "event_id", "buffer")


@query("buffer_slow_only", BUFFERS + "SELECT k AS host, t AS epoch, cents, buffer FROM b WHERE cents > 2000")
def buffer_slow_only(spark, sf) -> DataFrame:
    return _buffers(spark, sf).filter("cents > 2000").select("host", F.col("fast").alias("epoch"), "cents", "buffer")


# One host per ten users, so that failure runs get long enough to fire.
RUNS = E + """, p AS (SELECT user_id % 10 AS host_id, epoch, event_id, event_type IN ('error', 'view', 'click', 'signup') AS failed FROM e)
, g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY host_id ORDER BY epoch, event_id) AS grp FROM p)
, n AS (SELECT *, CASE WHEN failed THEN sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY host_id, grp ORDER BY epoch, event_id) ELSE 0 END AS losecount FROM g)
"""


def _pings(spark, sf):
    return events(spark, sf).select(
        (F.col("user_id") % 10).alias("host_id"), "epoch", "event_id", (F.col("event_type") != "purchase").alias("failed"))


@query("failure_runs", RUNS + "SELECT host_id, epoch, event_id, CAST(losecount AS BIGINT) AS losecount FROM n")
def failure_runs(spark, sf) -> DataFrame:
    return health.failure_runs(_pings(spark, sf), "host_id", "epoch", ["event_id"], F.col("failed")).select(
        "host_id", "epoch", "event_id", "losecount")


@query("failure_fires", "WITH RECURSIVE" + RUNS[4:] + """
, c AS (SELECT host_id, epoch, event_id, row_number() OVER (PARTITION BY host_id ORDER BY epoch, event_id) AS rn FROM n WHERE losecount > 0 AND losecount % 5 = 0)
, a AS (SELECT host_id, epoch, event_id, rn, epoch AS last, true AS acted FROM c WHERE rn = 1
  UNION ALL SELECT c.host_id, c.epoch, c.event_id, c.rn, CASE WHEN c.epoch > a.last + 14400 THEN c.epoch ELSE a.last END,
    c.epoch > a.last + 14400 FROM a JOIN c ON c.host_id = a.host_id AND c.rn = a.rn + 1)
SELECT host_id, epoch, event_id, acted FROM a""")
def failure_fires(spark, sf) -> DataFrame:
    return health.failure_fires(
        _pings(spark, sf), "host_id", "epoch", ["event_id"], F.col("failed"), suppress_secs=14400
    ).select("host_id", "epoch", "event_id", "acted")


@query("spaced_alerts", "WITH RECURSIVE" + E[4:] + """
, c AS (SELECT user_id % 10 AS host_id, epoch, event_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY epoch, event_id) AS rn FROM e)
, a AS (SELECT *, epoch AS last, true AS picked FROM c WHERE rn = 1
  UNION ALL SELECT c.*, CASE WHEN c.epoch > a.last + 1800 THEN c.epoch ELSE a.last END, c.epoch > a.last + 1800
  FROM a JOIN c ON c.host_id = a.host_id AND c.rn = a.rn + 1)
SELECT host_id, epoch, event_id, picked FROM a""")
def spaced_alerts(spark, sf) -> DataFrame:
    return spaced_picks(
        _pings(spark, sf).drop("failed"), ["host_id"], "epoch", ["event_id"], min_gap=1800
    ).select("host_id", "epoch", "event_id", "picked")


@query("service_rate_wait", E + """, p AS (SELECT host, epoch, event_id, event_id * 3 AS requests, cents,
  lag(epoch) OVER w AS e0, lag(event_id * 3) OVER w AS r0 FROM e WINDOW w AS (PARTITION BY host ORDER BY epoch, event_id))
, q AS (SELECT *, CASE WHEN epoch > e0 THEN CAST(requests - r0 AS DOUBLE) / (epoch - e0) END AS rate FROM p)
SELECT host, event_id, round(rate, 9) AS rate, CASE WHEN rate > 0 THEN CAST(round_even(cents / rate, 0) AS BIGINT) ELSE 0 END AS est_wait FROM q""")
def service_rate_wait(spark, sf) -> DataFrame:
    samples = events(spark, sf).select("host", "epoch", "event_id", (F.col("event_id") * 3).alias("requests"), F.col("cents").alias("queued"))
    return health.service_wait(samples, ties=["event_id"]).select(
        "host", "event_id", F.round("rate", 9).alias("rate"), "est_wait")


@query("new_high_water", E + """, p AS (SELECT event_type, epoch, event_id, cents, max(cents) OVER (PARTITION BY event_type ORDER BY epoch, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM e)
SELECT event_type, event_id, cents, prior FROM p WHERE prior IS NULL OR cents > prior""")
def new_high_water(spark, sf) -> DataFrame:
    jobs = events(spark, sf).select("event_type", "epoch", "event_id", "cents")
    return health.new_high_water(jobs, ["event_type"], "epoch", ["event_id"], "cents").filter("is_record").select(
        "event_type", "event_id", "cents", "prior")


@query("next_boundary", E + "SELECT event_id, " + ", ".join(
    f"((epoch + ({p} - {o}) * 60) // ({p} * 60)) * {p} * 60 + {o} * 60 AS next_{n}" for n, (p, o) in SCHEDULES.items()) + " FROM e")
def boundaries(spark, sf) -> DataFrame:
    return events(spark, sf).select(
        "event_id", *[next_boundary("epoch", p, o).alias(f"next_{n}") for n, (p, o) in SCHEDULES.items()])


@query("defer_near_boundary", E + """, p AS (SELECT event_type, event_id, epoch, max(cents // 100) OVER (PARTITION BY event_type ORDER BY epoch, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS longest FROM e)
SELECT event_id, coalesce(longest, 0) AS longest, coalesce(longest, 0) > 0 AND
  ((epoch + (30 - 2) * 60) // 1800) * 1800 + 120 - epoch < coalesce(longest, 0) AS defer FROM p""")
def defer_near_boundary(spark, sf) -> DataFrame:
    jobs = events(spark, sf).select(
        "event_type", "epoch", "event_id", F.floor(F.col("cents") / 100).cast("bigint").alias("seconds"))
    seen = health.new_high_water(jobs, ["event_type"], "epoch", ["event_id"], "seconds").fillna(0, ["prior"])
    return seen.select(
        "event_id", F.col("prior").alias("longest"), defer_for_boundary("epoch", F.col("prior"), *SCHEDULES["min"]).alias("defer"))


@query("collapsed_lines", E + """, p AS (SELECT user_id % 10 AS host_id, event_id, event_type,
  lag(event_type) OVER (PARTITION BY user_id % 10 ORDER BY epoch, event_id) AS prev FROM e)
SELECT host_id, event_id, event_type AS line FROM p WHERE prev IS NULL OR prev <> event_type""")
def collapsed_lines(spark, sf) -> DataFrame:
    lines = events(spark, sf).select((F.col("user_id") % 10).alias("host_id"), "epoch", "event_id", F.col("event_type").alias("line"))
    return collapse_repeats(
        lines, ["host_id"], time_slice(F.col("epoch"), 86400), ["epoch", "event_id"], "line"
    ).select("host_id", "event_id", "line")


@query("running_row_numbers", E + "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY epoch, event_id) AS rn FROM e")
def running_row_numbers(spark, sf) -> DataFrame:
    return row_numbers(
        events(spark, sf).select("event_type", "epoch", "event_id"), ["event_type"], time_slice(F.col("epoch"), 86400),
        ["epoch", "event_id"]).select("event_id", "rn")


READING = """CASE event_type WHEN 'error' THEN 'open files' WHEN 'view' THEN 'processes' WHEN 'click' THEN 'swap'
  WHEN 'signup' THEN 'free swap' ELSE 'load' END"""


@query("threshold_rules", E + f""", x AS (SELECT event_id, host, {READING} AS name, cents * 5 AS value FROM e)
SELECT event_id, name, value, CASE name WHEN 'open files' THEN 'not enough open files = ' WHEN 'processes' THEN 'not enough processes = '
  WHEN 'swap' THEN 'not enough swap space = ' ELSE 'not enough free swap space = ' END || value AS message FROM x
WHERE value < CASE name WHEN 'open files' THEN 100000 WHEN 'processes' THEN 8192 WHEN 'swap' THEN 10000 WHEN 'free swap' THEN 4000 END""")
def threshold_rules(spark, sf) -> DataFrame:
    readings = events(spark, sf).select("event_id", F.expr(READING).alias("name"), (F.col("cents") * 5).alias("value"))
    return rules.threshold_violations(readings, rules.threshold_rules(spark)).select("event_id", "name", "value", "message")


@query("file_dedupe", """SELECT source AS host, md5(text) AS md5, n_chars AS size, min('f' || lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS file_path
FROM documents GROUP BY 1, 2, 3""")
def file_dedupe(spark, sf) -> DataFrame:
    from ..sources.files import dedupe_files

    files = table(spark, sf, "documents").select(
        F.lit("docs").alias("monitor"), F.col("source").alias("host"), F.md5("text").alias("md5"), F.col("n_chars").alias("size"),
        F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("file_path"))
    return dedupe_files(files).select("host", "md5", "size", "file_path")


PATH_OF = """CASE page_id % 16 WHEN 0 THEN '/controller/instance/' || page_id || '/metrics' WHEN 1 THEN '/controller/instance/0/applicationConfiguration'
  WHEN 2 THEN '/controller/instance/' || page_id || '/applicationConfiguration' WHEN 3 THEN '/controller/instance/9/registerDB'
  WHEN 4 THEN '/controller/instance/9/db-monitor-config' WHEN 5 THEN '/controller/sim/4/user' WHEN 6 THEN '/controller/sim/4/machines'
  WHEN 7 THEN '/controller/restui/analytics' WHEN 8 THEN '/controller/rest/applications' WHEN 9 THEN '/controller/restui/entity/search'
  WHEN 10 THEN '/controller/restui/dashboards' WHEN 11 THEN '/controller/restui/warrooms' WHEN 12 THEN '/controller/rest/serverstatus'
  WHEN 13 THEN '/controller/instance/7/writeQueryStats' WHEN 14 THEN '/controller/instance/3/events' ELSE '' END"""


@query("url_class", f"""WITH p AS (SELECT page_id, {PATH_OF} || regexp_extract(url, '^[a-z]+://[^/]*(/.*)?$', 1) AS path FROM pages)
SELECT page_id, path, CASE WHEN regexp_matches(path, '^/controller/instance/.*/metrics') THEN 'metrics'
  WHEN path LIKE '/controller/instance/0/applicationConfiguration%' THEN 'configreg'
  WHEN regexp_matches(path, '^/controller/instance/.*/applicationConfiguration') THEN 'configuration'
  WHEN regexp_matches(path, '^/controller/instance/.*/(registerDB|registerSQL|writeQueryStats|collectWaitTimes|db-monitor-config)') THEN 'dbmon'
  WHEN path LIKE '/controller/instance/%' THEN 'agent' WHEN regexp_matches(path, '^/controller/sim/.*/user') THEN 'other'
  WHEN path LIKE '/controller/sim/%' THEN 'agent' WHEN path LIKE '/controller/restui/analytics/%' THEN 'analyticsui'
  WHEN path LIKE '/controller/rest/applications%' THEN 'restapi' WHEN path LIKE '/controller/restui/entity/search%' THEN 'entitysearch'
  WHEN regexp_matches(path, '^/controller/restui/(dashboards|events|warrooms)/') THEN 'ajax'
  WHEN path = '/controller/rest/serverstatus' THEN 'status' ELSE 'other' END AS class FROM p""")
def url_class(spark, sf) -> DataFrame:
    from ..sources.appserver import access_paths

    pages = access_paths(table(spark, sf, "pages")).withColumn("path", F.concat(F.expr(PATH_OF), F.col("path")))
    return pages.select("page_id", "path", rules.url_class("path").alias("class"))
