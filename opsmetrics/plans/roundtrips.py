"""Parser queries: events are rendered to raw captures and parsed back; the SQL computes the same straight from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import iso
from ..operators.points import map_to_points, to_import_lines, to_points, to_put_lines
from ..sources import appserver, catalog, dbstatus, iostat, monitors, slowlog
from ..sources.files import check_columns, column_counts, read_multi_header_csv, split_rows
from .base import BURSTS, E, FAST_ISO, captures, fast_iso, query, recursive, table

TAB = "\t"


def _cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _n(expr: str) -> Column:
    return F.expr(f"cast({expr} as string)")


def _captured(ev: DataFrame, text: Column, *extra: str) -> DataFrame:
    return ev.select("host", "event_id", *extra, text.alias("value"))


def _stamped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("timestamp", iso("timestamp"))


def _oracle(fields: dict[str, str], where: str = "", keep: str = "host, iso AS timestamp") -> str:
    cols = ", ".join(f'CAST({x} AS BIGINT) AS "{c}"' for c, x in fields.items())
    return f"{E} SELECT {keep}, {cols} FROM e {where}"


# --------------------------------------------------------------------------- line monitors

VMSTAT = {c: f"event_id * {i} % 1009" if i % 2 else f"cents + {i}" for i, c in enumerate(monitors.VMSTAT_FIELDS, start=1)}


def _vmstat_lines(ev: DataFrame) -> DataFrame:
    by_position = {p: VMSTAT[c] for c, p in monitors.VMSTAT_FIELDS.items()}
    line = F.concat_ws(" ", F.lit(""), *[_n(by_position.get(i, "event_id % 3")) for i in range(1, 18)], "iso")
    header = F.lit("procs -----------memory---------- ---swap--\n r  b   swpd   free\n")
    return _captured(ev, F.when(F.col("event_id") % 50 == 0, _cat(header, line))
                     .when(F.col("event_id") % 10 == 3, _cat(line, "\r\n")).otherwise(line))


@query("roundtrip_vmstat", _oracle(VMSTAT))
def roundtrip_vmstat(spark, sf) -> DataFrame:
    return _stamped(monitors.parse_vmstat(_vmstat_lines(captures(spark, sf))).rows)


@query("roundtrip_fdcount", _oracle({
    "gf_fdcount": "cents", "mysql_fdcount": "CASE WHEN event_type = 'error' THEN 0 ELSE event_id END"}))
def roundtrip_fdcount(spark, sf) -> DataFrame:
    mysql = F.when(F.col("event_type") == "error", "NO_MYSQL_RUNNING").otherwise(_n("event_id"))
    line = _cat("gf_fdcount=", _n("cents"), TAB, "mysql_fdcount=", mysql, TAB, F.col("iso"))
    return _stamped(monitors.parse_fdcount(_captured(captures(spark, sf), line)).rows)


def _memsize_lines(ev: DataFrame) -> DataFrame:
    """Old two- and three-size rows and new per-process rows in one capture."""
    stopped = F.col("event_type") == "error"
    two = _cat("gf_rss_prss=", _n("cents"), "m,", _n("cents + 5"), "m", TAB, "mysql_rss_prss=", _n("event_id"), "m,",
               _n("event_id + 7"), "m", TAB, "os_bfree_sused=10m,0m", TAB, F.col("iso"))
    three = _cat("gf_rss_prss_swap=", _n("cents"), "m,", _n("cents + 5"), "m,4m", TAB, "mysql_rss_prss_swap=",
                 F.when(stopped, "NO_MYSQL_RUNNING").otherwise(_cat(_n("event_id"), "m,", _n("event_id + 7"), "m,9m")), TAB, F.col("iso"))
    new = _cat(F.col("iso"), " mysql peak_m=", _n("cents + 9"), " rss_m=", _n("cents"), " swap_m=0 threads=", _n("event_id"), "\n", F.col("iso"),
               F.when(stopped, " NO_GLASSFISH_RUNNING").otherwise(_cat(" gf peak_m=8 rss_m=", _n("event_id"), " swap_m=1 threads=", _n("cents"))))
    return _captured(ev, F.when(F.col("event_id") % 3 == 0, two).when(F.col("event_id") % 3 == 1, three).otherwise(new))


@query("roundtrip_memsize_v1", _oracle({
    "gf_rss_m": "cents", "gf_prss_m": "cents + 5", "gf_swap_m": "CASE WHEN event_id % 3 = 1 THEN 4 END",
    "mysql_rss_m": "event_id", "mysql_prss_m": "event_id + 7", "mysql_swap_m": "CASE WHEN event_id % 3 = 1 THEN 9 END"},
    "WHERE event_id % 3 = 0 OR (event_id % 3 = 1 AND event_type <> 'error')"))
def roundtrip_memsize_v1(spark, sf) -> DataFrame:
    return _stamped(monitors.parse_memsize(_memsize_lines(captures(spark, sf)))["v1"].rows)


@query("roundtrip_memsize_v2", E + """SELECT host, iso AS timestamp, 'mysql' AS node, cents + 9 AS peak_m, cents AS rss_m,
  CAST(0 AS BIGINT) AS swap_m, event_id AS threads FROM e WHERE event_id % 3 = 2
UNION ALL SELECT host, iso, 'gf', 8, event_id, 1, cents FROM e WHERE event_id % 3 = 2 AND event_type <> 'error'""")
def roundtrip_memsize_v2(spark, sf) -> DataFrame:
    return _stamped(monitors.parse_memsize(_memsize_lines(captures(spark, sf)))["v2"].rows)


PROCIO = {k: f"cents * {i} + event_id" for i, k in enumerate(monitors.PROCIO_KEYS)}


@query("roundtrip_procio", _oracle(PROCIO, "WHERE event_type <> 'view'", "host, iso AS timestamp, 'gf' AS node"))
def roundtrip_procio(spark, sf) -> DataFrame:
    body = F.concat_ws(" ", F.lit("gf"), *[_cat(f"{k}=", _n(x)) for k, x in PROCIO.items()])
    line = _cat(F.col("iso"), " ", F.when(F.col("event_type") == "view", "UNABLE_TO_READ_/proc/1/io [x]").otherwise(body), "\r")
    return _stamped(monitors.parse_procio(_captured(captures(spark, sf), line)).rows)


CONX = {s: f"CASE WHEN event_id % {i + 2} = 0 THEN cents % {i + 40} ELSE 0 END" for i, s in enumerate(monitors.TCP_STATES)}
CONX_ORACLE = {"port": "8090 + event_id % 3", **CONX, "TOTAL": "cents"}


def _conx_lines(ev: DataFrame) -> DataFrame:
    states = [F.when(F.col("event_id") % (i + 2) == 0, _cat(f"{s}=", _n(f"cents % {i + 40}"))) for i, s in enumerate(monitors.TCP_STATES)]
    odd = F.when(F.col("event_id") % 13 == 0, F.lit("BOGUS=1"))
    body = F.concat_ws(",", _cat("port=", _n("8090 + event_id % 3")), *states, odd, _cat("TOTAL=", _n("cents")))
    return _captured(ev, _cat(body, F.when(F.col("event_id") % 2 == 0, ",").otherwise(""), TAB, F.col("iso")))


@query("roundtrip_conxcount", _oracle(CONX_ORACLE).replace(
    " FROM e ", ", CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS ignored_states FROM e ", 1))
def roundtrip_conxcount(spark, sf) -> DataFrame:
    return _stamped(monitors.parse_conxcount(_conx_lines(captures(spark, sf))).rows)


DBV1 = {k: f"cents + {i} * event_id" for i, k in enumerate(monitors.DBVARS_V1)}
DBV2 = {k: f"cents * {i} + event_id" for i, k in enumerate(monitors.DBVARS_V2) if k not in monitors.DBVARS_PERCENT}


def _dbvars_lines(ev: DataFrame) -> DataFrame:
    v1 = _cat(F.concat_ws(",", *[_cat(f"{k}=", _n(x)) for k, x in DBV1.items()]), TAB, F.col("iso"))
    cells = [F.format_string("%.1f", (F.col("cents") % 1000) / 10.0) if k in monitors.DBVARS_PERCENT else _n(DBV2[k]) for k in monitors.DBVARS_V2]
    v2 = F.concat_ws(",", F.col("iso"), *cells)
    header = _cat(",".join(("timestamp", *monitors.DBVARS_V2)), "\n", v2)
    broken = _cat(F.col("iso"), ',"get DB stats timed out" retc=124\n\n')
    return _captured(ev, F.when(F.col("event_id") % 31 == 0, broken).when(F.col("event_id") % 2 == 0, v1)
                     .when(F.col("event_id") % 20 == 1, header).otherwise(v2))


@query("roundtrip_dbvars_v1", _oracle(DBV1, "WHERE event_id % 31 <> 0 AND event_id % 2 = 0"))
def roundtrip_dbvars_v1(spark, sf) -> DataFrame:
    return _stamped(monitors.parse_dbvars(_dbvars_lines(captures(spark, sf)))["v1"].rows)


@query("roundtrip_dbvars_v2", _oracle(DBV2, "WHERE event_id % 31 <> 0 AND event_id % 2 = 1").replace(
    " FROM e ", "".join(f", CAST(cents % 1000 AS DOUBLE) / 10 AS {k}" for k in monitors.DBVARS_PERCENT) + " FROM e ", 1))
def roundtrip_dbvars_v2(spark, sf) -> DataFrame:
    return _stamped(monitors.parse_dbvars(_dbvars_lines(captures(spark, sf)))["v2"].rows)


def _slow_lines(ev: DataFrame) -> DataFrame:
    """Lines with a buffer number (even ids), without one (odd), a few of the wrong shape, every fifth twice."""
    buffer = F.when(F.col("event_id") % 2 == 0, _cat("buffer=", _n("event_id % 4 + 1"), TAB)).otherwise("")
    line = _cat(fast_iso(), TAB, buffer, "query_tm=", F.format_string("%.2f", F.col("cents") / 100.0), TAB, "lock_tm=",
                F.format_string("%.6f", F.col("event_id") / 1000000.0), TAB, "rows=", _n("event_id"))
    line = F.when(F.col("event_id") % 97 == 0, _cat(line, " trailing=1 text")).otherwise(line)
    return _captured(ev, F.when(F.col("event_id") % 5 == 0, _cat(line, "\n", line)).otherwise(line))


SLOW = recursive(E) + """, r AS (SELECT host AS k, fast AS t, event_id, CAST(cents AS DOUBLE) / 100 AS query_tm FROM e
  WHERE event_id % 97 <> 0 AND event_id % 2 = 1)""" + BURSTS.format(order="t, query_tm, event_id") + f"""
, u AS (SELECT k AS host, t AS fast, event_id, buffer FROM b
  UNION ALL SELECT host, fast, event_id, event_id % 4 + 1 FROM e WHERE event_id % 97 <> 0 AND event_id % 2 = 0)
SELECT u.host, {FAST_ISO.replace('fast', 'u.fast')} AS timestamp, CAST(buffer AS BIGINT) AS buffer, CAST(cents AS DOUBLE) / 100 AS query_tm,
  CAST(u.event_id AS DOUBLE) / 1000000 AS lock_tm, u.event_id AS rows FROM u JOIN e ON e.event_id = u.event_id"""


@query("roundtrip_slowlog", SLOW)
def roundtrip_slowlog(spark, sf) -> DataFrame:
    return _stamped(monitors.parse_slowlog(_slow_lines(captures(spark, sf))).rows)


@query("slowlog_rejects", E + "SELECT host, 'wrong shape' AS reason, count(*) AS lines FROM e, range(2) x(i) WHERE event_id % 97 = 0 AND (event_id % 5 = 0 OR i = 0) GROUP BY 1")
def slowlog_rejects(spark, sf) -> DataFrame:
    bad = monitors.parse_slowlog(_slow_lines(captures(spark, sf)), number_missing=False).rejects
    return bad.groupBy("host", "reason").agg(F.count("*").alias("lines"))


# --------------------------------------------------------------------------- section records

HTTP = {k: f"cents + {i} * event_id" for i, k in enumerate(monitors.POOL_SECTIONS["http-service"])}
THREADS = {k: f"cents * {i} + event_id" for i, k in enumerate(monitors.POOL_SECTIONS["thread-pool"][1:])}
CONP = {k: f"event_id * {i} + cents" for i, k in enumerate(monitors.POOL_SECTIONS["connection-pool"][1:])}


def _pool_records(ev: DataFrame) -> DataFrame:
    def block(section, rows):
        head = f"#section {section}:\ntimestamp," + ",".join(monitors.POOL_SECTIONS[section]) + "\n"
        return _cat(head, *[x for r in rows for x in (F.concat_ws(",", "iso", *r), "\n")], "\n")
    def cells(fields):
        return [_n(x) for x in fields.values()]
    text = _cat(
        block("http-service", [cells(HTTP)]),
        block("thread-pool", [[F.lit("http-listener-1"), *cells(THREADS)], [F.lit("admin"), *cells(THREADS)]]),
        block("connection-pool", [[F.lit("main_pool"), *cells(CONP)]]),
        '#section error:\n', F.col("iso"), ' "timed out" retc=124\n\n',
    )
    return _captured(ev, text)


@query("roundtrip_gfpools", _oracle(HTTP))
def roundtrip_gfpools(spark, sf) -> DataFrame:
    return _stamped(monitors.parse_gfpools(_pool_records(captures(spark, sf)))["http-service"].rows)


@query("roundtrip_gfpools_threads", _oracle(THREADS, ", (VALUES ('http-listener-1'), ('admin')) v(l)", "host, iso AS timestamp, l AS listener"))
def roundtrip_gfpools_threads(spark, sf) -> DataFrame:
    return _stamped(monitors.parse_gfpools(_pool_records(captures(spark, sf)))["thread-pool"].rows)


@query("roundtrip_gfpools_connections", _oracle(CONP, "", "host, iso AS timestamp, 'main_pool' AS pool"))
def roundtrip_gfpools_connections(spark, sf) -> DataFrame:
    return _stamped(monitors.parse_gfpools(_pool_records(captures(spark, sf)))["connection-pool"].rows)


ORDERS = {f"order{i}": f"cents % {i + 5} + z * 3 + n" for i in range(11)}


def _numa_records(ev: DataFrame) -> DataFrame:
    def buddy(n, z, zone):
        values = [F.expr(x.replace("z * 3", f"{z} * 3").replace("+ n", f"+ {n}")).cast("string") for x in ORDERS.values()]
        return _cat(F.concat_ws(" ", F.lit(f"Node {n}, zone   {zone}"), *values), "\n")
    nodes = "                          Node 0          Node 1           Total\n                 --------------- --------------- ---------------\n"
    return _captured(ev, _cat(
        "datetime: ", F.col("iso"), "\n#section buddyinfo:\n", buddy(0, 0, "DMA"), buddy(0, 1, "Normal"), buddy(1, 1, "Normal"),
        "\n#section procvmstat:\nnuma_hit ", _n("cents"), "\nnuma_miss ", _n("event_id"), "\n\n#section numastat:\n\nPer-node system memory usage (in MBs):\n", nodes,
        "MemTotal ", _n("cents"), " ", _n("event_id"), " 99\nActive(anon) ", _n("cents + 1"), " ", _n("event_id + 1"), " 98\n\nPer-node numastat info (in MBs):\n", nodes,
        "Numa_Hit ", _n("cents + 2"), " ", _n("event_id + 2"), " 97\n\n"))


@query("roundtrip_buddyinfo", _oracle(ORDERS, ", (VALUES (0, 0, 'DMA'), (0, 1, 'Normal'), (1, 1, 'Normal')) v(n, z, zn)",
                                      "host, iso AS timestamp, CAST(n AS VARCHAR) AS node, zn AS zone"))
def roundtrip_buddyinfo(spark, sf) -> DataFrame:
    return _stamped(monitors.parse_numabuddyrefs(_numa_records(captures(spark, sf)))["buddyinfo"].rows)


@query("roundtrip_procvmstat", _oracle({"numa_hit": "cents", "numa_miss": "event_id"}))
def roundtrip_procvmstat(spark, sf) -> DataFrame:
    parsed = monitors.parse_numabuddyrefs(_numa_records(captures(spark, sf)), vmstat_keys=["numa_hit", "numa_miss"])
    return _stamped(parsed["procvmstat"].rows)


@query("roundtrip_numastat", E + """SELECT host, iso AS timestamp, CAST(n AS VARCHAR) AS node, CAST(CASE n WHEN 0 THEN cents ELSE event_id END AS DOUBLE) AS memtotal_mb,
  CAST(CASE n WHEN 0 THEN cents ELSE event_id END + 1 AS DOUBLE) AS active_anon_mb, CAST(CASE n WHEN 0 THEN cents ELSE event_id END + 2 AS DOUBLE) AS numa_hit
FROM e, (VALUES (0), (1)) v(n)""")
def roundtrip_numastat(spark, sf) -> DataFrame:
    rows = monitors.parse_numabuddyrefs(_numa_records(captures(spark, sf)))["numastat"].rows
    def pick(k):
        return F.try_element_at("measures", F.lit(k))
    return _stamped(rows).select(
        "host", "timestamp", "node", pick("MemTotal_mb").alias("memtotal_mb"), pick("Active_anon_mb").alias("active_anon_mb"),
        pick("Numa_Hit").alias("numa_hit"))


# --------------------------------------------------------------------------- whole-file reports
# A report holds sixteen consecutive events.

DEVICE_HEAD = "Device:         rrqm/s     r/s     w/s    await   %util"


def _report_files(ev: DataFrame, banner: Column, stamp: Column) -> DataFrame:
    money = F.format_string("%.2f", F.col("cents") / 100.0)
    share = F.format_string("%.2f", (F.col("cents") % 10000) / 100.0)
    sample = _cat(
        stamp, "\navg-cpu:  %user   %nice %system %iowait  %steal   %idle\n           ", share, "    0.00    0.50    0.10    0.00   98.40\n\n",
        DEVICE_HEAD, "\nsda               0.00    ", money, "    1.00    2.00   ", share, "\ndm-0              9.00    9.00    9.00    9.00    9.00\nnvme0n1           0.00    ",
        _n("event_id"), ".00    1.00    2.00   0.50\n\n")
    grouped = ev.withColumn("report", F.floor(F.col("event_id") / 16).cast("bigint")).groupBy("report").agg(
        F.sort_array(F.collect_list(F.struct("epoch", "event_id", sample.alias("s")))).alias("samples"),
        F.min_by(banner, "epoch").alias("banner"))
    body = F.array_join(F.transform("samples", lambda x: x["s"]), "")
    return grouped.select("report", _cat("host", _n("report")).alias("host"), F.concat("banner", F.lit("\n\n"), body).alias("value"))


def _us_stamp() -> Column:
    t = F.col("ts").cast("string")
    hour = F.hour("ts")
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.concat(F.substring(t, 6, 2), F.lit("/"), F.substring(t, 9, 2), F.lit("/"), F.substring(t, 1, 4), F.lit(" "),
                    F.lpad(twelve.cast("string"), 2, "0"), F.substring(t, 14, 6), F.when(hour < 12, " AM").otherwise(" PM"))


def _long_stamp() -> Column:
    t = F.col("ts").cast("string")
    return _cat("Tuesday ", F.substring(t, 9, 2), " January ", F.substring(t, 1, 4), " ", F.substring(t, 12, 8), "  IST")


def _dated_reports(ev: DataFrame) -> DataFrame:
    style = F.floor(F.col("event_id") / 16) % 3
    stamp = F.when(style == 0, _us_stamp()).when(style == 1, _cat(F.col("iso"), "-0700")).otherwise(_long_stamp())
    date = F.when(style == 0, "01/15/2024").when(style == 1, "2024-01-15").otherwise("Monday 15 January 2024")
    return _report_files(ev, _cat("Linux 3.10.0-957.el7.x86_64 (some-host) \t", date, " \t_x86_64_\t(8 CPU)"), stamp)


DEVICES = """SELECT 'host' || (event_id // 16) AS host, {stamp} AS timestamp, d AS device,
  CASE d WHEN 'sda' THEN CAST(cents AS DOUBLE) / 100 ELSE CAST(event_id AS DOUBLE) END AS reads,
  CASE d WHEN 'sda' THEN CAST(cents % 10000 AS DOUBLE) / 100 ELSE 0.5::DOUBLE END AS util, CAST(cents % 10000 AS DOUBLE) / 100 AS cpu_user
FROM e, (VALUES ('sda'), ('nvme0n1')) v(d)"""


def _devices(rows: DataFrame, minutes: bool = False) -> DataFrame:
    def pick(k):
        return F.try_element_at("measures", F.lit(k))
    return rows.select("host", iso("timestamp", minutes).alias("timestamp"), "device", pick("r/s").alias("reads"),
                       pick("%util").alias("util"), pick("%user").alias("cpu_user"))


@query("roundtrip_iostat", E + DEVICES.format(stamp="iso"))
def roundtrip_iostat(spark, sf) -> DataFrame:
    return _devices(iostat.parse_iostat(_dated_reports(captures(spark, sf))).rows)


@query("roundtrip_iostat_clock", E + DEVICES.format(stamp="left(iso, 16)"))
def roundtrip_iostat_clock(spark, sf) -> DataFrame:
    t = F.col("ts").cast("string")
    banner = _cat("Linux 2.6.32-431.el6 (host) ", F.substring(t, 6, 2), "/", F.substring(t, 9, 2), "/", F.substring(t, 3, 2))
    stamp = _cat("Time: ", F.substring_index(_us_stamp(), " ", -2))
    return _devices(iostat.parse_iostat_clock(_report_files(captures(spark, sf), banner, stamp)).rows, minutes=True)


@query("disk_slow_join", E + """, d AS (SELECT host, left(iso, 13) AS h, sum(cents) AS s, count(*) AS n FROM e WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2)
, s AS (SELECT host, left(iso, 13) AS h, sum(cents) AS s, count(*) AS n FROM e WHERE event_type IN ('error', 'signup') GROUP BY 1, 2)
SELECT d.host, d.h || ':00' AS minute, round(CAST(d.s AS DOUBLE) / d.n, 6) AS util, round(CAST(s.s AS DOUBLE) / s.n, 6) AS query_tm
FROM d JOIN s ON s.host = d.host AND s.h = d.h""")
def disk_slow_join(spark, sf) -> DataFrame:
    ev = captures(spark, sf).withColumn("timestamp", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    disk = ev.filter(F.col("event_type").isin("click", "view", "purchase")).select("host", "timestamp", F.col("cents").alias("util"))
    slow = ev.filter(F.col("event_type").isin("error", "signup")).select("host", "timestamp", F.col("cents").alias("query_tm"))
    return iostat.disk_with_slow_inserts(disk, slow).select(
        "host", F.translate("minute", " ", "T").alias("minute"), F.round("util", 6).alias("util"), F.round("query_tm", 6).alias("query_tm"))


def _two_header_files(ev: DataFrame) -> DataFrame:
    """Sixteen events per file; even ids under one header, odd ids under another."""
    a = F.when(F.col("event_id") % 2 == 0, F.concat_ws(",", "iso", F.lit("n1"), _n("cents")))
    b = F.when(F.col("event_id") % 2 == 1, F.concat_ws(", ", "iso", F.lit("Normal"), _n("event_id"), _n("cents + 1")))
    grouped = ev.withColumn("file", F.floor(F.col("event_id") / 16).cast("bigint")).groupBy("file").agg(
        F.sort_array(F.collect_list(a)).alias("a"), F.sort_array(F.collect_list(b)).alias("b"))
    text = F.concat(F.lit("timestamp,node,mem(kb)\n"), F.array_join("a", "\n"), F.lit("\r\ntimestamp, zone,b, c%d%\n"), F.array_join("b", "\n"))
    return grouped.select(_cat("f", _n("file")).alias("host"), text.alias("value"))


@query("multi_header_csv", E + """SELECT 'f' || (event_id // 16) AS host, iso AS timestamp, CASE WHEN event_id % 2 = 0 THEN 'n1' END AS node,
  CASE WHEN event_id % 2 = 1 THEN 'Normal' END AS zone, CASE WHEN event_id % 2 = 0 THEN cents END AS mem_kb,
  CASE WHEN event_id % 2 = 1 THEN event_id END AS b, CASE WHEN event_id % 2 = 1 THEN cents + 1 END AS c_first FROM e""")
def multi_header_csv(spark, sf) -> DataFrame:
    rows = read_multi_header_csv(_two_header_files(captures(spark, sf))).rows
    def cell(k):
        return F.try_element_at("cells", F.lit(k))
    return rows.select(
        "host", cell("timestamp").alias("timestamp"), cell("node").alias("node"), cell("zone").alias("zone"),
        cell("mem_kb").cast("bigint").alias("mem_kb"), cell("b").cast("bigint").alias("b"), cell("cpctd%").cast("bigint").alias("c_first"))


# --------------------------------------------------------------------------- logs and snapshots


def _slow_records(ev: DataFrame) -> DataFrame:
    statement = (
        F.when(F.col("event_type") == "click", "INSERT IGNORE INTO metricdata_min   SELECT * FROM x;")
        .when(F.col("event_type") == "view", "LOAD DATA CONCURRENT LOCAL INFILE 'dummy.txt' IGNORE INTO TABLE metricdata_min FIELDS TERMINATED BY ',';")
        .when(F.col("event_type") == "error", "/* x LOAD DATA CONCURRENT LOCAL INFILE 'dummy.txt' IGNORE INTO TABLE metricdata_min FIELDS;")
        .otherwise("SELECT 1;"))
    text = _cat("# User@Host: root[root] @ localhost []\n# Query_time: ", F.format_string("%.2f", F.col("cents") / 100.0), "  Lock_time: ",
                F.format_string("%.6f", F.col("event_id") / 1000000.0), " Rows_sent: 0  Rows_examined: ", _n("event_id"), "\nSET timestamp=",
                _n("fast"), ";\n", statement, "\n")
    return _captured(ev, text)


IN_SLOW = "event_type IN ('click', 'view')"


@query("roundtrip_slow_query_log", E + f"""SELECT host, fast AS epoch, CAST(cents AS DOUBLE) / 100 AS query_tm, CAST(event_id AS DOUBLE) / 1000000 AS lock_tm,
  event_id AS rows FROM e WHERE {IN_SLOW}""")
def roundtrip_slow_query_log(spark, sf) -> DataFrame:
    return slowlog.parse_mysql_slow_log(_slow_records(captures(spark, sf)))


@query("mined_slow_log", recursive(E) + f", r AS (SELECT host AS k, fast AS t, event_id, cents FROM e WHERE {IN_SLOW})" + BURSTS.format(order="t, cents, event_id") + """
SELECT k AS host, strftime(make_timestamp((t - 28800) * 1000000), '%Y-%m-%dT%H:%M:%S') AS timestamp, buffer,
  CAST(cents AS DOUBLE) / 100 AS query_tm, event_id AS rows FROM b WHERE cents > 1000""")
def mined_slow_log(spark, sf) -> DataFrame:
    mined = slowlog.mine_slow_log(_slow_records(captures(spark, sf)), "America/Los_Angeles", 10)
    return _stamped(mined).select("host", "timestamp", "buffer", "query_tm", "rows")


DBS = {
    "OS_file_reads": "event_id", "OS_file_writes": "cents", "OS_fsyncs": "event_id % 100", "Log_sequence_number": "cents * 1000 + event_id",
    "Log_flushed_up_to": "cents * 1000", "Last_checkpoint_at": "cents * 900", "pending_log_flushes": "event_id % 3", "pending_chkp_writes": "event_id % 4",
    "log_ios_done": "cents + 1", "Database_pages": "cents + 2", "Old_database_pages": "cents + 3",
    "Modified_db_pages": "cents + 4", "Pending_writes_LRU": "event_id % 9", "Pending_writes_flush": "event_id % 8", "Pending_writes_single": "event_id % 7",
    "rows_inserted": "cents + 5", "rows_updated": "cents + 6", "rows_deleted": "cents + 7", "rows_read": "cents + 8",
    **{k: f"event_id + {i}" for i, k in enumerate(dbstatus.STATUS_FIELDS)}, "current_query_maxtime": "event_id % 77", "current_query_count": "event_id % 5",
}


def _status_snapshots(ev: DataFrame) -> DataFrame:
    def n(k):
        return _n(DBS[k])
    text = _cat(
        "START SECTION 1\nFILE I/O\n", n("OS_file_reads"), " OS file reads, ", n("OS_file_writes"), " OS file writes, ", n("OS_fsyncs"), " OS fsyncs\n",
        "LOG\nLog sequence number ", n("Log_sequence_number"), "\nLog flushed up to   ", n("Log_flushed_up_to"), "\nLast checkpoint at  ", n("Last_checkpoint_at"), "\n",
        n("pending_log_flushes"), " pending log flushes, ", n("pending_chkp_writes"), " pending chkp writes\n", n("log_ios_done"), " log i/o's done, 0.00 log i/o's/second\n",
        "BUFFER POOL AND MEMORY\nBuffer pool size   ", _n("event_id + 1000"), "\nFree buffers       ", _n("event_id"), "\nDatabase pages     ", n("Database_pages"),
        "\nOld database pages ", n("Old_database_pages"), "\nModified db pages  ", n("Modified_db_pages"), "\nPending writes: LRU ", n("Pending_writes_LRU"), ", flush list ",
        n("Pending_writes_flush"), ", single page ", n("Pending_writes_single"), "\nINDIVIDUAL BUFFER POOL INFO\nDatabase pages     1\nROW OPERATIONS\nNumber of rows inserted ",
        n("rows_inserted"), ", updated ", n("rows_updated"), ", deleted ", n("rows_deleted"), ", read ", n("rows_read"), "\nSTART SECTION 2\n",
        *[x for k in dbstatus.STATUS_FIELDS for x in (f"{k}\t", n(k), "\n")], "START SECTION 3\nhiwat: ", n("current_query_maxtime"), "\nxcount: ", n("current_query_count"), "\n")
    return _captured(ev, text, "ts").withColumnRenamed("ts", "timestamp").drop("event_id")


# Log sizes as name/value rows, read off the region table.
SIZES = """CASE r_regionkey WHEN 0 THEN 'innodb_log_buffer_size' WHEN 1 THEN 'innodb_log_file_size' WHEN 2 THEN 'innodb_log_files_in_group' ELSE r_name END"""
SIZE_VALUES = "CASE r_regionkey WHEN 0 THEN '8388608' WHEN 1 THEN '50331648' WHEN 2 THEN '2' ELSE '0' END"


@query("roundtrip_db_status", _oracle(DBS).replace(" FROM e ", """, CAST(printf('%.1f', 100.0::DOUBLE * event_id / 8388608) AS DOUBLE) AS Log_unflushed_pct_buf,
  CAST(printf('%.1f', 100.0::DOUBLE * (cents * 100 + event_id) / (50331648 * 2)) AS DOUBLE) AS checkpoint_age_pct_log,
  CAST(printf('%.1f', 100.0::DOUBLE * event_id / (event_id + 1000)) AS DOUBLE) AS free_pct_bufpages FROM e """, 1))
def roundtrip_db_status(spark, sf) -> DataFrame:
    variables = dbstatus.log_settings(table(spark, sf, "region").select(
        F.expr(SIZES).alias("name"), F.expr(SIZE_VALUES).alias("value")))
    return _stamped(dbstatus.parse_db_status(_status_snapshots(captures(spark, sf)), variables))


@query("query_sessions", E + "SELECT host, max(cents) AS hiwat, count(*) AS xcount FROM e WHERE event_type = 'click' GROUP BY 1")
def query_sessions(spark, sf) -> DataFrame:
    processes = captures(spark, sf).select(
        "host", F.when(F.col("event_type") == "click", "Query").otherwise("Sleep").alias("command"), F.col("cents").alias("time"))
    return dbstatus.query_sessions(processes, ["host"])


def _dumps(ev: DataFrame) -> DataFrame:
    http = [(f"server.http-service.server.request.{c}", f"event_id * 5 + {i}") for i, c in enumerate(appserver.HTTP_FIELDS.values())]
    queue = [(f"connection-queue.{c}", f"cents + {i}" if c != "maxqueued-count" else "-1 - event_id") for i, c in enumerate(appserver.QUEUE_FIELDS.values())]
    threads = [(f"thread-pool.{c}", f"cents * 2 + {i}") for i, c in enumerate(appserver.THREAD_FIELDS.values())]
    net = [(f"server.network.{li}.{c}", x) for li in ("http-listener-1", "admin") for c, x in queue + threads]
    net.append(("server.network.http-listener-1.keep-alive.maxrequests-count", "event_id - 500"))
    pool = [(f"server.resources.controller_mysql_pool.{c}", f"event_id + {i} * 2") for i, c in enumerate(appserver.POOL_FIELDS.values())]
    lines = [x for p, v in http + net + pool for x in (f"{p} = ", _n(v), "\n")]
    return _captured(ev, _cat(*lines, "server.network.http-listener-1.name = http-listener-1\n"), "ts").withColumnRenamed("ts", "timestamp")


DUMP_HTTP = {k: f"event_id * 5 + {i}" for i, k in enumerate(appserver.HTTP_FIELDS)}
DUMP_QUEUE = {k: "9999" if k == "conq_maxq" else f"cents + {i}" for i, k in enumerate(appserver.QUEUE_FIELDS)}
DUMP_THREADS = {k: f"cents * 2 + {i}" for i, k in enumerate(appserver.THREAD_FIELDS)}
DUMP_POOL = {k: f"event_id + {i} * 2" for i, k in enumerate(appserver.POOL_FIELDS)}


@query("roundtrip_appserver", _oracle(DUMP_HTTP))
def roundtrip_appserver(spark, sf) -> DataFrame:
    return _stamped(appserver.parse_appserver_dump(_dumps(captures(spark, sf)))["http-service"])


@query("roundtrip_appserver_listeners", E + """, p AS (SELECT *, lag(epoch) OVER w AS e0, lag(event_id) OVER w AS i0 FROM e WINDOW w AS (PARTITION BY host ORDER BY epoch))
, q AS (SELECT *, CASE WHEN epoch > e0 THEN CAST((event_id - i0) * 5 AS DOUBLE) / (epoch - e0) END AS rate FROM p)
SELECT host, iso AS timestamp, l AS listener, """ + ", ".join(
    f"CAST({x} AS BIGINT) AS {k}" for k, x in {**DUMP_QUEUE, **DUMP_THREADS}.items()) + """,
  CASE WHEN rate > 0 THEN CAST(round_even((cents + 1) / rate, 0) AS BIGINT) ELSE 0 END AS thrp_est_wait
FROM q, (VALUES ('http-listener-1'), ('admin')) v(l)""")
def roundtrip_appserver_listeners(spark, sf) -> DataFrame:
    return _stamped(appserver.parse_appserver_dump(_dumps(captures(spark, sf)))["thread-pool"])


@query("roundtrip_appserver_pool", _oracle(DUMP_POOL, "", "host, iso AS timestamp, 'controller_mysql_pool' AS pool"))
def roundtrip_appserver_pool(spark, sf) -> DataFrame:
    return _stamped(appserver.parse_appserver_dump(_dumps(captures(spark, sf)))["connection-pool"])


METRIC_LABELS = [
    ("Thread Pool|{l}|Connection-Queue|Active", "cents"), ("Thread Pool|{l}|Connection-Queue|Queued", "cents + 1"),
    ("Thread Pool|{l}|Connection-Queue|Max", "0"), ("Thread Pool|{l}|Busy", "cents * 2"), ("Thread Pool|{l}|Max", "cents * 2 + 1"),
]
POOL_LABELS = [
    ("Average Wait Time", "event_id"), ("Acquired", "event_id + 4"), ("Released", "event_id + 6"), ("Used", "event_id + 8"),
    ("Wait Queue Max", "event_id + 12"), ("Free", "event_id + 14"), ("Timed Out", "event_id + 16"),
]
CUSTOM = E + ", m AS (" + " UNION ALL ".join(
    [f"SELECT event_id, '{n.format(l=li)}' AS name, {x} AS value FROM e" for li in ("http-listener-1", "admin") for n, x in METRIC_LABELS]
    + ["SELECT event_id, 'Thread Pool|http-listener-1|Keep-Alive|Max' AS name, greatest(event_id - 500, 0) AS value FROM e"]
    + [f"SELECT event_id, 'MySQL Connection Pool|{n}' AS name, {x} AS value FROM e" for n, x in POOL_LABELS]) + ") "


@query("appserver_metrics", CUSTOM + "SELECT event_id, name, CAST(value AS BIGINT) AS value FROM m")
def appserver_metrics(spark, sf) -> DataFrame:
    return appserver.appserver_metrics(_dumps(captures(spark, sf)).select("event_id", "value"))


@query("custom_metric_lines", CUSTOM + "SELECT 'name=Custom Metrics|' || name || ',aggregator=OBSERVATION,value=' || value AS value FROM m")
def custom_metric_lines(spark, sf) -> DataFrame:
    return appserver.to_custom_metric_lines(appserver_metrics(spark, sf))


@query("connection_counts", E + "SELECT host, left(iso, 13) AS hour, 8090 + event_id % 4 AS port, " + ", ".join(
    f"count(*) FILTER (WHERE cents % 12 = {i}) AS {s}" for i, s in enumerate(monitors.TCP_STATES)) + ', count(*) AS "TOTAL" FROM e WHERE event_id % 4 < 3 GROUP BY 1, 2, 3')
def connection_counts(spark, sf) -> DataFrame:
    states = F.array(*[F.lit(s) for s in monitors.TCP_STATES])
    line = _cat("tcp        0      0 10.0.0.1:", _n("8090 + event_id % 4"), "       10.0.0.9:55555        ",
                F.get(states, (F.col("cents") % 12).cast("int")), "  ")
    lines = captures(spark, sf).select("host", F.substring("iso", 1, 13).alias("hour"), line.alias("value"))
    return appserver.connection_counts(lines, ["host", "hour"], [8090, 8091, 8092])


@query("process_memory", E + """SELECT host, event_id, CAST(round_even((cents + 2048) / 1024.0::DOUBLE, 0) AS BIGINT) AS peak_m, CAST(round_even(cents / 1024.0::DOUBLE, 0) AS BIGINT) AS rss_m,
  CAST(round_even(event_id * 512 / 1024.0::DOUBLE, 0) AS BIGINT) AS swap_m, event_id % 50 AS threads FROM e""")
def process_memory(spark, sf) -> DataFrame:
    text = _cat("Name:\tmysqld\nVmPeak:\t 99 kB\nVmHWM:\t  ", _n("cents + 2048"), " kB\nVmRSS:\t  ", _n("cents"), " kB\nVmSwap:\t   ", _n("event_id * 512"),
                " kB\nThreads:\t", _n("event_id % 50"), "\n")
    return appserver.process_memory(_captured(captures(spark, sf), text))


@query("xml_ports", E + "SELECT event_id, 8000 + cents % 900 AS port FROM e UNION ALL SELECT event_id, 9000 + event_id FROM e WHERE event_type <> 'error'")
def xml_ports(spark, sf) -> DataFrame:
    on = F.when(F.col("event_type") == "error", "false").otherwise("true")
    text = _cat('<domain><configs><config name="server-config"><network-config><network-listeners><network-listener port="', _n("8000 + cents % 900"),
                '"/><network-listener port="', _n("9000 + event_id"), '" enabled="', on, '"/><network-listener port="${ADMIN_PORT}"/></network-listeners></network-config></config>',
                '<config name="other"><network-config><network-listeners><network-listener port="1"/></network-listeners></network-config></config></configs></domain>')
    return appserver.xml_ports(_captured(captures(spark, sf), text).drop("host"))


@query("ddl_partitions", E + """SELECT 't' || event_id AS "table", 'ts_min' AS key, 'PART' || (event_id + i) AS part, CASE i WHEN 0 THEN 0 ELSE cents + i - 1 END AS lo, cents + i AS hi FROM e, range(3) x(i)
UNION ALL SELECT 't' || event_id, 'ts_min', 'PARTMAX', cents + 2, NULL FROM e""")
def ddl_partitions(spark, sf) -> DataFrame:
    parts = [x for i in range(3) for x in ("PARTITION PART", _n(f"event_id + {i}"), " VALUES LESS THAN (", _n(f"cents + {i}"), ") ENGINE = InnoDB,\n ")]
    text = _cat("CREATE TABLE `t", _n("event_id"), "` (\n  `ts_min` int NOT NULL\n) ENGINE=InnoDB\n/*!50100 PARTITION BY RANGE (ts_min)\n(", *parts,
                "PARTITION PARTMAX VALUES LESS THAN MAXVALUE ENGINE = InnoDB) */")
    return catalog.ddl_partitions(_captured(captures(spark, sf), text).select("value"))


@query("properties", E + "SELECT event_id, 'port' AS name, CAST(cents AS VARCHAR) AS value FROM e UNION ALL SELECT event_id, 'options', 'a=' || user_id FROM e")
def properties(spark, sf) -> DataFrame:
    text = _cat("[mysqld]\nport = ", _n("cents"), "\noptions=a=", _n("user_id"), "\r\n")
    return catalog.parse_properties(_captured(captures(spark, sf), text).drop("host"))


@query("json_metric_sum", """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * (event_id % 2) AS dropped FROM events""")
def json_metric_sum(spark, sf) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1)
    found = _cat('[{"metricPath":"Relay","metricValues":[{"count":2,"sum": ', k, ',"value":1}]}]')
    return table(spark, sf, "events").select(
        "event_id", catalog.metric_sum(F.when(F.col("event_id") % 2 == 1, found).otherwise("[]")).alias("dropped"))


@query("json_lookup", "SELECT event_id, user_id * 10 AS id FROM events WHERE event_type = 'click'")
def json_lookup(spark, sf) -> DataFrame:
    text = _cat('[{"id": 1, "name": "clicks"}, {"id": ', _n("user_id * 10"), ', "name": "', F.col("event_type"), '"}]')
    return catalog.json_lookup(_captured(captures(spark, sf), text).drop("host"), "click")


# --------------------------------------------------------------------------- quality

DAMAGED = "event_id % 97 = 0"


def _damaged(spark, sf) -> DataFrame:
    line = F.concat_ws(" ", "iso", "host", _n("cents"))
    return captures(spark, sf).select(
        "host", (F.col("event_id") % 2).alias("data_version"),
        F.when(F.expr(DAMAGED), _cat(line, " extra")).when(F.col("event_id") % 2 == 0, _cat(line, " v0")).otherwise(line).alias("value"))


FIELDS = f"CASE WHEN {DAMAGED} THEN 4 WHEN event_id % 2 = 0 THEN 4 ELSE 3 END"


@query("column_count_check", E + f"""SELECT host, event_id % 2 AS data_version, CAST(min({FIELDS}) AS INTEGER) AS min_cols, CAST(max({FIELDS}) AS INTEGER) AS max_cols, count(*) AS lines,
  min({FIELDS}) = max({FIELDS}) AS consistent FROM e GROUP BY 1, 2""")
def column_count_check(spark, sf) -> DataFrame:
    return column_counts(_damaged(spark, sf), ["host", "data_version"], F.size(F.split("value", " ")))


@query("column_count_rejects", E + f", x AS (SELECT *, event_id % 2 AS v, {FIELDS} AS n FROM e)" + """
, c AS (SELECT v, n, count(*) AS c FROM x GROUP BY 1, 2), u AS (SELECT v, max_by(n, c) AS usual FROM c GROUP BY 1)
SELECT host, 'inconsistent column count' AS reason, count(*) AS lines FROM x JOIN u ON u.v = x.v WHERE n <> usual GROUP BY 1""")
def column_count_rejects(spark, sf) -> DataFrame:
    bad = check_columns(_damaged(spark, sf), ["data_version"], F.size(F.split("value", " "))).rejects
    return bad.groupBy("host", "reason").agg(F.count("*").alias("lines"))


@query("numeric_check", E + "SELECT event_type <> 'error' AS good, count(*) AS lines FROM e GROUP BY 1")
def numeric_check(spark, sf) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(_n("cents"))
    res = split_rows(captures(spark, sf).select(text.alias("value")), F.col("value").try_cast("bigint").isNotNull(), "not a number")
    good = res.rows.select(F.lit(True).alias("good"))
    return good.unionByName(res.rejects.select(F.lit(False).alias("good"))).groupBy("good").agg(F.count("*").alias("lines"))


# --------------------------------------------------------------------------- points


def _point_rows(spark, sf) -> DataFrame:
    return captures(spark, sf).select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("device"), (F.col("event_id") % 4 + 1).alias("buffer"),
        F.when(F.col("event_id") % 7 != 0, F.col("cents")).alias("w/s"), F.col("event_id").alias("%util(avg)"), "host")


POINT_COLS = "(SELECT *, 'w/s' AS col, CASE WHEN event_id % 7 <> 0 THEN cents END AS n FROM e UNION ALL SELECT *, 'pctutil_avg', event_id FROM e)"
# The wall clock is kept in Los Angeles, eight hours behind in January.
POINTS = E + f", p AS (SELECT * FROM {POINT_COLS} WHERE n IS NOT NULL) "
LINE = "'iostat ' || (epoch + 28800) || ' ' || n || ' col=' || col || ' device=' || event_type || ' buffer=' || (event_id % 4 + 1) || ' host=' || host || ' Z=L3'"


def _points(spark, sf) -> DataFrame:
    return to_points(_point_rows(spark, sf), "iostat", host="host", load_id="L3")


@query("unpivot_points", POINTS + """SELECT 'iostat' AS metric, epoch + 28800 AS epoch, col, CAST(n AS VARCHAR) AS raw, CAST(n AS DOUBLE) AS value,
  event_type AS device, CAST(event_id % 4 + 1 AS VARCHAR) AS buffer, host, 'L3' AS load_id FROM p""")
def unpivot_points(spark, sf) -> DataFrame:
    def tag(k):
        return F.try_element_at("tags", F.lit(k)).alias(k)
    return _points(spark, sf).select("metric", "epoch", "col", "raw", "value", tag("device"), tag("buffer"), "host", "load_id")


@query("put_lines", POINTS + f"SELECT 'put ' || {LINE} AS value FROM p")
def put_lines(spark, sf) -> DataFrame:
    return to_put_lines(_points(spark, sf))


@query("import_lines", POINTS + f"SELECT {LINE} AS value FROM p")
def import_lines(spark, sf) -> DataFrame:
    return to_import_lines(_points(spark, sf))


@query("section_points", E + """SELECT 'numa' AS metric, epoch + 28800 AS epoch, 'f' || (event_id // 16) AS host, col, raw, node, zone FROM (
  SELECT *, 'mem_kb' AS col, CAST(cents AS VARCHAR) AS raw, 'n1' AS node, NULL::VARCHAR AS zone FROM e WHERE event_id % 2 = 0
  UNION ALL SELECT *, 'b', CAST(event_id AS VARCHAR), NULL, 'Normal' FROM e WHERE event_id % 2 = 1
  UNION ALL SELECT *, 'cpctd%', CAST(cents + 1 AS VARCHAR), NULL, 'Normal' FROM e WHERE event_id % 2 = 1)""")
def section_points(spark, sf) -> DataFrame:
    rows = read_multi_header_csv(_two_header_files(captures(spark, sf))).rows
    def tag(k):
        return F.try_element_at("tags", F.lit(k)).alias(k)
    return map_to_points(rows, "numa", host="host").select("metric", "epoch", "host", "col", "raw", tag("node"), tag("zone"))


@query("pivot_states_zero_fill", E + "SELECT host, left(iso, 10) AS day, " + ", ".join(
    f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in ("click", "purchase", "error", "signup", "view", "logout")) + ', count(*) AS "TOTAL" FROM e GROUP BY 1, 2')
def pivot_states_zero_fill(spark, sf) -> DataFrame:
    rows = captures(spark, sf).select("host", F.substring("iso", 1, 10).alias("day"), "event_type")
    return appserver.zero_filled(rows, ["host", "day"], "event_type", ["click", "purchase", "error", "signup", "view", "logout"])
