"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, time, versions
from .base import E, events, query, table


@query("host_from_filename", """SELECT c_custkey, replace(replace(lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '-' END || c_custkey, ' ', '_'), '-', '_') AS host FROM customer""")
def host_from_filename(spark, sf) -> DataFrame:
    name = F.concat(
        F.lit("/captures/x_y/214903_iostat_"), F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, " ").otherwise("-"),
        F.col("c_custkey").cast("string"), F.lit(".intranet.example.com_1593031296.txt"))
    return table(spark, sf, "customer").select("c_custkey", text.host_from_path(name).alias("host"))


A = "CAST(p_size % 5 AS VARCHAR) || '.' || (p_partkey % 3) || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '.' || (p_partkey % 2) END || CASE WHEN p_partkey % 4 = 3 THEN '.9' ELSE '' END"
B = "CAST(p_size % 5 AS VARCHAR) || '.' || (p_partkey % 3) || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '.' || (p_size % 2) END || CASE WHEN p_partkey % 5 > 2 THEN '.9' ELSE '' END"


def _versions(spark, sf) -> DataFrame:
    def own(x):
        return F.expr(x.replace("VARCHAR", "STRING"))
    return table(spark, sf, "part").select("p_partkey", own(A).alias("a"), own(B).alias("b"))


VERSIONS = f"WITH v AS (SELECT p_partkey, {A} AS a, {B} AS b FROM part) "


@query("version_loose_equal", VERSIONS + """, s AS (SELECT *, string_split(a, '.') AS x, string_split(b, '.') AS y FROM v)
SELECT p_partkey, a, b, CASE WHEN len(x) = len(y) THEN a = b WHEN abs(len(x) - len(y)) = 1 AND least(len(x), len(y)) >= 3
  THEN x[1:least(len(x), len(y))] = y[1:least(len(x), len(y))] ELSE false END AS equal FROM s""")
def version_loose_equal(spark, sf) -> DataFrame:
    return _versions(spark, sf).select("p_partkey", "a", "b", versions.version_loose_eq("a", "b").alias("equal"))


@query("version_valid", VERSIONS + "SELECT p_partkey, regexp_full_match(a, '[0-9]+[.][0-9]+[.][0-9]+([.][0-9]+)?') AS valid FROM v")
def version_valid(spark, sf) -> DataFrame:
    return _versions(spark, sf).select("p_partkey", versions.is_version("a").alias("valid"))


@query("version_newer", VERSIONS + "SELECT p_partkey, CAST(string_split(a, '.') AS INTEGER[]) > CAST(string_split(b, '.') AS INTEGER[]) AS newer FROM v")
def version_newer(spark, sf) -> DataFrame:
    return _versions(spark, sf).select("p_partkey", versions.version_newer("a", "b").alias("newer"))


@query("version_from_padded", "SELECT p_partkey, (p_size % 10) || '.' || (p_partkey % 100) || '.' || p_size || '.0' AS version FROM part")
def version_from_padded(spark, sf) -> DataFrame:
    padded = F.format_string("%03d-%03d-%03d-000", F.col("p_size") % 10, F.col("p_partkey") % 100, "p_size")
    return table(spark, sf, "part").select("p_partkey", versions.version_from_padded(padded).alias("version"))


@query("human_bytes", """WITH b AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 97 WHEN 2 THEN 100003 ELSE 1000000007 END // CASE WHEN o_orderkey % 8 = 0 THEN 100000 ELSE 1 END AS n FROM orders)
SELECT o_orderkey, CASE WHEN n > 1e12 THEN printf('%.3fT', n / 1000.0::DOUBLE / 1000 / 1000 / 1000) WHEN n > 1e9 THEN printf('%.3fG', n / 1000.0::DOUBLE / 1000 / 1000)
  WHEN n > 1e6 THEN printf('%.3fM', n / 1000.0::DOUBLE / 1000) WHEN n > 1e3 THEN printf('%.3fK', n / 1000.0::DOUBLE) ELSE printf('%.3f ', CAST(n AS DOUBLE)) END AS size FROM b""")
def human_bytes(spark, sf) -> DataFrame:
    factor = F.when(F.col("o_orderkey") % 4 == 0, 1).when(F.col("o_orderkey") % 4 == 1, 97).when(F.col("o_orderkey") % 4 == 2, 100003).otherwise(1000000007)
    n = F.floor(F.round(F.col("o_totalprice") * 100).cast("bigint") * factor / F.when(F.col("o_orderkey") % 8 == 0, 100000).otherwise(1))
    return table(spark, sf, "orders").select("o_orderkey", text.human_bytes(n.cast("bigint")).alias("size"))


@query("duration_seconds", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size * 60 WHEN 1 THEN p_size * 3600 WHEN 2 THEN p_size * 86400 WHEN 3 THEN p_size * 604800
  WHEN 4 THEN p_size * 2592000 END::BIGINT AS seconds FROM part""")
def duration_seconds(spark, sf) -> DataFrame:
    unit = F.get(F.array(*[F.lit(u) for u in ("M", "h", "d", "w", "m", "x")]), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, sf, "part").select(
        "p_partkey", time.duration_seconds(F.concat(F.col("p_size").cast("string"), unit)).alias("seconds"))


@query("us_datetime", E + "SELECT event_id, iso AS us, iso AS us_short FROM e")
def us_datetime(spark, sf) -> DataFrame:
    from .roundtrips import _us_stamp

    short = F.regexp_replace(_us_stamp(), r"^(\d+/\d+/)20", "$1")
    return events(spark, sf).select(
        "event_id", time.iso(time.parse_us(_us_stamp())).alias("us"), time.iso(time.parse_us(short)).alias("us_short"))


@query("long_datetime", E + "SELECT event_id, iso AS stamp FROM e")
def long_datetime(spark, sf) -> DataFrame:
    from .roundtrips import _long_stamp

    return events(spark, sf).select("event_id", time.iso(time.parse_long(_long_stamp())).alias("stamp"))


@query("epoch_in_zone", "SELECT o_orderkey, CAST(epoch(timezone('America/Los_Angeles', o_orderdate + INTERVAL 12 HOUR)) AS BIGINT) AS epoch FROM orders")
def epoch_in_zone(spark, sf) -> DataFrame:
    noon = F.col("o_orderdate") + F.expr("INTERVAL 12 HOURS")
    return table(spark, sf, "orders").select("o_orderkey", time.epoch_in_zone(noon, "America/Los_Angeles").alias("epoch"))


@query("zone_clock", """SELECT o_orderkey, strftime(timezone('Asia/Kolkata', to_timestamp(epoch_us(o_orderdate) // 1000000 + o_orderkey)), '%Y-%m-%dT%H:%M:%S') AS clock FROM orders""")
def zone_clock(spark, sf) -> DataFrame:
    epoch = time.epoch_of("o_orderdate") + F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", time.iso(time.ntz_in_zone(epoch, "Asia/Kolkata")).alias("clock"))


@query("midnight_clock", E + "SELECT event_id, left(iso, 16) AS minute FROM e")
def midnight_clock(spark, sf) -> DataFrame:
    from .roundtrips import _us_stamp

    stamp = _us_stamp()
    at = time.at_clock(time.parse_us_date(stamp), F.lit(0), time.clock_seconds(stamp))
    return events(spark, sf).select("event_id", time.iso(at, minutes=True).alias("minute"))


@query("number_helpers", E + """SELECT event_id, cents + 1 AS commas, CAST(round_even(cents / 1024.0::DOUBLE, 0) AS BIGINT) AS mb, (cents - 1) // 7 + 1 AS sevens,
  CASE WHEN event_id % 3 = 0 THEN 'none' ELSE host END AS name, ts_min - 8 AS minutes_ago FROM e""")
def number_helpers(spark, sf) -> DataFrame:
    return events(spark, sf).select(
        "event_id", text.no_commas(F.format_number(F.col("cents") + 1, 0)).cast("bigint").alias("commas"),
        text.kb_to_mb("cents").alias("mb"), text.ceil_div("cents", 7).alias("sevens"),
        text.or_default(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("host")), "none").alias("name"),
        time.minutes_ago("epoch", 8).alias("minutes_ago"))


@query("metric_headers", E + "SELECT event_id, 'c' || (event_id % 9) || '_x%pct_' || event_type || '%' AS header FROM e")
def metric_headers(spark, sf) -> DataFrame:
    raw = F.concat(F.lit(" c"), (F.col("event_id") % 9).cast("string"), F.lit("(x%)_"), F.col("event_type"), F.lit("% "))
    # Only the first percent sign is replaced, so the header is turned round to match the SQL text.
    turned = F.regexp_replace(text.metric_header(raw), r"^(c\d_x)pct_(.*)$", r"$1%pct_$2")
    return events(spark, sf).select("event_id", turned.alias("header"))


@query("simulated_nodes", E + "SELECT event_id, (cents * 100 - 1) // 4000 + 1 AS nodes, ((cents * 100 - 1) // 4000) // 10 + 1 AS agents FROM e")
def simulated_nodes(spark, sf) -> DataFrame:
    from ..operators.saturation import nodes_needed

    load = events(spark, sf).withColumn("load", F.col("cents") * 100)
    nodes, agents = nodes_needed("load", 4000, 10)
    return load.select("event_id", nodes.alias("nodes"), agents.alias("agents"))
