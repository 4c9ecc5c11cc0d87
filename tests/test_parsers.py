"""Literal captures of every format and version; each is parsed as is and with CRLF line ends."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsmetrics.plans import streams
from opsmetrics.sources import appserver, catalog, dbstatus, iostat, monitors, slowlog
from opsmetrics.sources.files import check_columns, column_counts, read_multi_header_csv, split_rows

TS = "2021-04-21T20:41:30"
AT = dt.datetime(2021, 4, 21, 20, 41, 30)


@pytest.fixture(params=["\n", "\r\n"], ids=["lf", "crlf"])
def text(request, spark):
    def make(*values, **cols):
        rows = [(v.replace("\n", request.param), "h1", *cols.values()) for v in values]
        return spark.createDataFrame(rows, ["value", "host", *cols])
    return make


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_vmstat(text):
    res = monitors.parse_vmstat(text(f"procs ---\n r  b\n 1 9 500 20 8 900 0 0 5 6 100 200 3 1 96 0 0 {TS}\n1 2 3 {TS}"))
    r = only(res.rows)
    assert (r["running"], r["swpd"], r["free"], r["cache"], r["bi"], r["id"], r["timestamp"]) == (1, 500, 20, 900, 5, 96, AT)
    assert only(res.rejects)["reason"] == "not a vmstat row"


def test_fdcount(text):
    r = only(monitors.parse_fdcount(text(f"gf_fdcount=812\tmysql_fdcount=NO_MYSQL_RUNNING\t{TS}")).rows)
    assert (r["gf_fdcount"], r["mysql_fdcount"]) == (812, 0)


def test_memsize_all_versions(text):
    res = monitors.parse_memsize(text(
        "gf_rss_prss=812m,900m\tmysql_rss_prss=70m,80m\tos_bfree_sused=10m,0m\t2019-03-12T10:00:00",
        "gf_rss_prss_swap=812m,900m,4m\tmysql_rss_prss_swap=70m,80m,0m\t2020-07-23T10:00:00",
        f"{TS} mysql peak_m=900 rss_m=812 swap_m=0 threads=64\n{TS} NO_GLASSFISH_RUNNING",
        f"{TS} UNABLE_TO_READ_/proc/1/status [x]", "gf_rss_prss=NO_GLASSFISH_RUNNING mysql_rss_prss=1m,2m\t2019-03-12T10:00:00",
        "gf_rss_prss=8m,9m,1m\tmysql_rss_prss=7m,8m\t2019-03-12T10:00:00"))
    v1 = {r["timestamp"].year: r for r in res["v1"].rows.collect()}
    assert set(v1) == {2019, 2020} and v1[2019]["gf_swap_m"] is None and v1[2020]["gf_swap_m"] == 4
    assert only(res["v2"].rows)["threads"] == 64
    assert res["v1"].rejects.count() == 1  # three sizes for one process, two for the other


def test_procio(text):
    r = only(monitors.parse_procio(text(
        f"{TS} gf rchar=10 wchar=20 syscr=1 syscw=2 read_bytes=3 write_bytes=4 cancelled_write_bytes=0\n{TS} NO_MYSQL_RUNNING")).rows)
    assert (r["node"], r["wchar"], r["cancelled_write_bytes"]) == ("gf", 20, 0)


def test_conxcount_old_and_new(text):
    rows = monitors.parse_conxcount(text(
        f"port=8090,ESTABLISHED=12,LISTEN=1,BOGUS=3,TOTAL=13\t{TS}", f"port=8091,TIME_WAIT=2,TOTAL=2,\t{TS}")).rows
    r = {x["port"]: x for x in rows.collect()}
    assert (r[8090]["ESTABLISHED"], r[8090]["CLOSING"], r[8090]["TOTAL"], r[8090]["ignored_states"]) == (12, 0, 13, 1)
    assert (r[8091]["TIME_WAIT"], r[8091]["ignored_states"]) == (2, 0)


def test_dbvars_versions_mixed(text):
    v2 = ",".join([TS, *[str(i) for i in range(37)]])
    res = monitors.parse_dbvars(text(
        "Queries=10,Aborted_clients=0,Aborted_connects=0,Connections=5,Created_tmp_tables=2,Created_tmp_disk_tables=1,Threads_created=4\t2020-05-01T10:00:00\n"
        + ",".join(("timestamp", *monitors.DBVARS_V2)) + f'\n{v2}\n{TS},"get DB stats timed out" retc=124\n\n{TS},1,2'))
    assert only(res["v1"].rows)["Threads_created"] == 4
    r = only(res["v2"].rows)
    assert r["OS_file_writes"] == 1 and r["Log_unflushed_pct_buf"] == 5.0 and r["current_query_count"] == 36
    assert only(res["v2"].rejects)["reason"] == "wrong number of columns"


def test_fail_mode_raises(text):
    with pytest.raises(Exception, match="not a vmstat row"):
        monitors.parse_vmstat(text(f"1 2 3 {TS}"), on_bad="fail").rows.collect()


def test_slowlog_shapes(text):
    rows = monitors.parse_slowlog(text(
        "2020-09-25T10:00:00\tbuffer=3\tquery_tm=1.5\tlock_tm=0.1\trows=1000",
        *[f"2019-02-27T10:00:{s:02d}\tquery_tm=1.5\tlock_tm=0.1\trows={s}" for s in (0, 3, 15, 16)],
        "2019-02-27T10:00:00\tquery_tm=1.5\tlock_tm=0.1\trows=0", "2019-02-27T10:00:00 broken=1"))
    got = {r["rows"]: r["buffer"] for r in rows.rows.collect()}
    assert got == {1000: 3, 0: 1, 3: 2, 15: 3, 16: 1} and rows.rejects.count() == 1


def test_gfpools(text):
    http = ",".join(["timestamp", *monitors.POOL_SECTIONS["http-service"]])
    conn = ",".join(["timestamp", *monitors.POOL_SECTIONS["connection-pool"]])
    res = monitors.parse_gfpools(text(
        f"#section http-service:\n{http}\n{TS}," + ",".join(map(str, range(11))) + f"\n\n#section connection-pool:\n{conn}\n{TS},p1," +
        ",".join(map(str, range(9))) + f'\n\n#section error:\n{TS} "timed out" retc=124\n\n'))
    assert only(res["http-service"].rows)["http_avgtime"] == 10
    assert only(res["connection-pool"].rows)["pool"] == "p1"
    assert res["thread-pool"].rows.count() == 0


NUMA = f"""datetime: {TS}
#section buddyinfo:
Node 0, zone   Normal 1 2 3 4 5 6 7 8 9 10 11

#section procvmstat:
numa_hit 100
numa_miss 7

#section numastat:

Per-node system memory usage (in MBs):
                 Node 0 Node 1 Total
                 ------ ------ -----
MemTotal         65490  65536  131026
Active(anon)     10     20     30

                 Node 0 Node 1 Total
                 ------ ------ -----
Numa_Hit         5      6      11

"""


def test_numabuddyrefs(text):
    res = monitors.parse_numabuddyrefs(text(NUMA * 2))
    buddy = res["buddyinfo"].rows.collect()
    assert len(buddy) == 2 and (buddy[0]["node"], buddy[0]["zone"], buddy[0]["order0"], buddy[0]["order10"]) == ("0", "Normal", 1, 11)
    assert res["procvmstat"].rows.first()["counters"] == {"numa_hit": 100, "numa_miss": 7}
    numa = {r["node"]: r["measures"] for r in res["numastat"].rows.collect()}
    assert numa == {"0": {"MemTotal_mb": 65490.0, "Active_anon_mb": 10.0, "Numa_Hit": 5.0},
                    "1": {"MemTotal_mb": 65536.0, "Active_anon_mb": 20.0, "Numa_Hit": 6.0}}


def report(banner, *stamps):
    return banner + "\n\n" + "".join(
        f"{s}\navg-cpu:  %user   %nice %system %iowait  %steal   %idle\n           {i}.50    0.00    0.50    0.10    0.00   98.40\n\n"
        "Device:         rrqm/s     r/s  %util\nsda               0.00    1.00   1.20\ndm-0    0.1 0.2 0.3\nloop0 1 2 3\n\n"
        for i, s in enumerate(stamps))


@pytest.mark.parametrize("banner,stamp,want", [
    ("Linux 3.10.0 (host) \t08/30/2016 \t_x86_64_\t(8 CPU)", "08/30/2016 10:00:00 PM", dt.datetime(2016, 8, 30, 22)),
    ("Linux 3.10.0 (host) \t2021-04-21 \t_x86_64_\t(8 CPU)", "2021-04-21T20:41:49-0700", dt.datetime(2021, 4, 21, 20, 41, 49)),
    ("Linux 3.10.0 (host) \tTuesday 06 April 2021 \t_x86_64_\t(8 CPU)", "Tuesday 06 April 2021 12:17:01  IST", dt.datetime(2021, 4, 6, 12, 17, 1)),
])
def test_iostat_styles(text, banner, stamp, want):
    r = only(iostat.parse_iostat(text(report(banner, stamp))).rows)
    assert (r["timestamp"], r["device"], r["measures"]["%util"], r["measures"]["%user"]) == (want, "sda", 1.2, 0.5)


def test_iostat_several_reports_in_one_file(text):
    both = report("Linux 3 (h) 08/30/2016 _x86_64_ (8 CPU)", "08/30/2016 10:00:00 PM") + report("Linux 3 (h) 2021-04-21 _x86_64_ (8 CPU)", "2021-04-21T20:41:49+00")
    assert {r["timestamp"].year for r in iostat.parse_iostat(text(both)).rows.collect()} == {2016, 2021}
    assert iostat.parse_iostat(text("Linux odd banner\n\n")).rejects.count() == 1


def test_iostat_clock_counts_days_at_midnight_only(text):
    rows = iostat.parse_iostat_clock(text(report(
        "Linux 2.6 (h) 08/30/16", "Time: 09:36:02 AM", "Time: 07:36:02 PM", "Time: 12:00:30 AM", "Time: 01:00:00 PM", "Time: 03:00:00 AM"))).rows
    assert sorted(str(r["timestamp"]) for r in rows.collect()) == [
        "2016-08-30 09:36:00", "2016-08-30 19:36:00", "2016-08-31 00:00:00", "2016-08-31 13:00:00", "2016-09-01 03:00:00"]


SLOW = """# User@Host: root[root] @ localhost []
# Query_time: 1.5  Lock_time: 0.1 Rows_sent: 0  Rows_examined: 1000
SET timestamp=1600000000;
INSERT IGNORE INTO metricdata_min SELECT 1;
# User@Host: app[app] @ localhost []
# Query_time: 9  Lock_time: 0.2 Rows_sent: 0  Rows_examined: 5
SET timestamp=1600000001;
SELECT 1;
# User@Host: app[app] @ localhost []
# Query_time: 0.5  Lock_time: 0.2 Rows_sent: 0  Rows_examined: 7
SET timestamp=1600000002;
LOAD DATA CONCURRENT LOCAL INFILE 'dummy.txt' IGNORE INTO TABLE metricdata_min FIELDS;
"""


def test_slow_query_log(text):
    rows = slowlog.mine_slow_log(text(SLOW, SLOW), "America/Los_Angeles").collect()
    assert sorted((r["epoch"], r["buffer"], r["query_tm"], r["rows"]) for r in rows) == [(1600000000, 1, 1.5, 1000), (1600000002, 2, 0.5, 7)]
    assert str(min(r["timestamp"] for r in rows)) == "2020-09-13 05:26:40"
    late = slowlog.mine_slow_log(text(SLOW), min_secs=0.5).collect()  # strict, after numbering
    assert [(r["rows"], r["buffer"]) for r in late] == [(1000, 1)]


def test_db_status_keeps_to_its_headings(spark):
    snap = """START SECTION 1
FILE I/O
--------
12 OS file reads, 34 OS file writes, 5 OS fsyncs
LOG
---
Log sequence number 2000
Log flushed up to   1000
Last checkpoint at  500
1 pending log flushes, 2 pending chkp writes
7 log i/o's done, 0.00 log i/o's/second
BUFFER POOL AND MEMORY
Buffer pool size   200
Free buffers       25
Database pages     70
Old database pages 7
Modified db pages  3
Pending writes: LRU 1,000, flush list 2, single page 3
INDIVIDUAL BUFFER POOL INFO
Database pages     1
ROW OPERATIONS
Number of rows inserted 10, updated 2, deleted 3, read 44
START SECTION 2
Queries\t123
Connections\t9
START SECTION 3
hiwat: 3
xcount: 2
"""
    variables = spark.createDataFrame([("innodb_log_buffer_size", "8000"), ("innodb_log_file_size", "1000"), ("innodb_log_files_in_group", "3"), ("x", "y")], "name string, value string")
    df = spark.createDataFrame([(snap, AT)], "value string, timestamp timestamp_ntz")
    r = only(dbstatus.parse_db_status(df, dbstatus.log_settings(variables)))
    assert (r["OS_fsyncs"], r["Log_unflushed_pct_buf"], r["checkpoint_age_pct_log"], r["free_pct_bufpages"]) == (5, 12.5, 50.0, 12.5)
    assert (r["Database_pages"], r["Pending_writes_LRU"], r["rows_read"], r["Queries"], r["Questions"], r["current_query_maxtime"]) == (70, 1000, 44, 123, None, 3)


def test_appserver_dump(spark):
    def dump(n, q):
        return (f"server.http-service.server.request.countrequests-count = {n}\nserver.network.l1.connection-queue.countqueued-count = {q}\n"
                "server.network.l1.connection-queue.maxqueued-count = -1\nserver.network.l2.thread-pool.maxthreads-count = 5\n"
                "server.resources.controller_mysql_pool.numconnfree-current = -4\n")
    df = spark.createDataFrame([("h", AT, dump(100, 1)), ("h", AT + dt.timedelta(seconds=10), dump(120, 9))], "host string, timestamp timestamp_ntz, value string")
    out = appserver.parse_appserver_dump(df)
    waits = {(r["listener"], r["timestamp"].second): r for r in out["thread-pool"].collect()}
    assert set(waits) == {("l1", 30), ("l2", 30), ("l1", 40), ("l2", 40)}  # a listener with thread counters alone counts too
    assert waits["l1", 30]["thrp_est_wait"] == 0 and waits["l1", 40]["thrp_est_wait"] == 4 and waits["l1", 40]["conq_maxq"] == 9999
    assert waits["l2", 40]["thrp_max"] == 5
    named = {(r["name"], r["value"]) for r in appserver.appserver_metrics(df.select("value")).collect()}
    assert ("MySQL Connection Pool|Free", 0) in named and ("Thread Pool|l1|Connection-Queue|Queued", 9) in named
    assert len({n for n, _ in named}) == 4


def test_snapshots(spark):
    mem = spark.createDataFrame([("VmHWM:\t 2560 kB\nVmRSS:\t 1536 kB\nVmSwap:\t 0 kB\nThreads:\t7\n",)], "value string")
    assert only(appserver.process_memory(mem)) == {"peak_m": 2, "rss_m": 2, "swap_m": 0, "threads": 7}
    net = spark.createDataFrame([(f"tcp 0 0 10.0.0.1:{p} 10.0.0.2:5 {s}",) for p, s in ((8090, "LISTEN"), (8090, "TIME_WAIT"), (80, "LISTEN"))] + [("Proto Recv",)], "value string")
    counts = {r["port"]: r for r in appserver.connection_counts(net, []).collect()}
    assert (counts[8090]["TOTAL"], counts[8090]["TIME_WAIT"], counts[80]["ESTABLISHED"]) == (2, 1, 0)


def test_catalog_texts(spark):
    ddl = spark.createDataFrame([("CREATE TABLE `m` (\n) /*!50100 PARTITION BY RANGE (ts_min)\n(PARTITION PART1 VALUES LESS THAN (260) ENGINE = InnoDB,\n PARTITION PARTMAX VALUES LESS THAN MAXVALUE ENGINE = InnoDB) */",)], "value string")
    assert [tuple(r) for r in catalog.ddl_partitions(ddl).collect()] == [("m", "ts_min", "PART1", 0, 260), ("m", "ts_min", "PARTMAX", 260, None)]
    props = spark.createDataFrame([("[x]\nport = 3388\nopt=a=b\n",)], "value string")
    assert {tuple(r) for r in catalog.parse_properties(props).collect()} == {("port", "3388"), ("opt", "a=b")}


def test_multi_header_csv(text):
    res = read_multi_header_csv(text("lost,1\ntimestamp,node,a\n2021-01-01T00:00:00,n1,5\n2021-01-01T00:01:00,n1\ntimestamp,zone,b,c%\n2021-01-01T00:02:00,DMA,1,2\n2021-01-01T00:02:00,DMA,1,2,3\n"))
    assert {r["reason"]: r["value"] for r in res.rejects.collect()} == {
        "no header before the line": "lost,1", "more cells than the header has": "2021-01-01T00:02:00,DMA,1,2,3"}
    assert [r["cells"] for r in res.rows.orderBy("at").collect()] == [
        {"timestamp": "2021-01-01T00:00:00", "node": "n1", "a": "5"}, {"timestamp": "2021-01-01T00:01:00", "node": "n1", "a": None},
        {"timestamp": "2021-01-01T00:02:00", "zone": "DMA", "b": "1", "cpct": "2"}]


def test_column_checks(spark):
    df = spark.createDataFrame([("a", "1 2"), ("a", "1 2"), ("a", "1 2 3"), ("b", "1")], "run string, value string")
    n = F.size(F.split("value", " "))
    assert {r["run"]: r["consistent"] for r in column_counts(df, ["run"], n).collect()} == {"a": False, "b": True}
    res = check_columns(df, ["run"], n)
    assert res.rows.count() == 3 and only(res.rejects)["value"] == "1 2 3"
    with pytest.raises(Exception, match="inconsistent column count"):
        check_columns(df, ["run"], n, "fail").rows.collect()
    assert split_rows(df, F.lit(None).cast("boolean"), "x").rejects.count() == 4


def test_repeats_of_one_capture_stay_and_overlaps_go(spark):
    from opsmetrics.sources.files import without_overlap

    rows = [("h", "f1", 5), ("h", "f1", 5), ("h", "f2", 5), ("h", "f2", 7), (None, "f1", 5), ("h", None, 9)]
    got = without_overlap(spark.createDataFrame(rows, "host string, file_path string, x int")).collect()
    assert sorted((r["host"] or "", r["x"]) for r in got) == [("", 5), ("h", 5), ("h", 5), ("h", 7), ("h", 9)]
    assert without_overlap(spark.createDataFrame(rows, "host string, file_path string, x int").drop("file_path")).count() == 4


def test_memory_node_rejects(text):
    record = (f"datetime: {TS}\n#section buddyinfo:\nNode 0, zone DMA 1 2 3 4 5 6 7 8 9 10 11\n\n#section procvmstat:\nnuma_hit 1\nnuma_miss many\nalone\n\n"
              "#section numastat:\n   Node 0  Node 1  Total\n  ------ ------ ------\nMemTotal 5 6 11\nMemFree 5\nMemUsed 1 x 3\n\n")
    out = monitors.parse_numabuddyrefs(text(record))
    assert {r["value"] for r in out["procvmstat"].rejects.collect()} == {"numa_miss many", "alone"}
    assert only(out["procvmstat"].rows)["counters"] == {"numa_hit": 1}
    assert {r["value"] for r in out["numastat"].rejects.collect()} == {"MemFree 5", "MemUsed 1 x 3"}
    assert {r["node"]: r["measures"]["MemTotal_mb"] for r in out["numastat"].rows.collect()} == {"0": 5.0, "1": 6.0}
    assert monitors.parse_numabuddyrefs(text(record.replace("procvmstat", "other")))["buddyinfo"].rejects.count() == 1


REPORT = """{banner}

{stamp}
avg-cpu:  %user   %idle
           1.50   98.50

Device:  r/s  %util
sda      2.00  3.00
dm-0     9.00  9.00
nvme0n1  nan  0.50
"""


@pytest.mark.parametrize("parse, banner, stamp", [
    (iostat.parse_iostat, "Linux 3.10 (h) \t01/15/2024 \t_x86_64_\t(8 CPU)", "01/15/2024 01:02:03 PM"),
    (iostat.parse_iostat_clock, "Linux 3.10 (h) 01/15/24", "Time: 01:02:03 PM")])
def test_report_texts_are_shuffled_before_they_are_cut(spark, parse, banner, stamp):
    """The lines of a text need no shuffle, and numeric words that begin with a letter still count as numbers."""
    text = REPORT.format(banner=banner, stamp=stamp)
    rows, rejects = parse(spark.createDataFrame([("h", text), ("g", None)], "host string, value string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and plan.index("Generate") < plan.index("Exchange") and plan.count("Exchange") == 1
    got = {r["device"]: r["measures"] for r in rows.collect()}
    assert got["sda"] == {"r/s": 2.0, "%util": 3.0, "%user": 1.5, "%idle": 98.5} and set(got) == {"sda", "nvme0n1"}
    assert str(got["nvme0n1"]["r/s"]) == "nan"
    assert rejects.count() == 0


def test_metric_names_are_computed_once(spark):
    dump = "server.network.http-listener-1.thread-pool.maxthreads-count = 7\nserver.network.x = 1\nserver.resources.controller_mysql_pool.numconnused-current = -3\n"
    metrics = appserver.appserver_metrics(spark.createDataFrame([(1, dump), (2, None)], "i int, value string"))
    assert metrics._jdf.queryExecution().optimizedPlan().toString().count("numconnused-current") == 1
    lines = appserver.to_custom_metric_lines(metrics.union(spark.sql("SELECT 3, 'n', CAST(null AS bigint)")))
    assert sorted(r["value"] for r in lines.collect()) == [
        "name=Custom Metrics|MySQL Connection Pool|Used,aggregator=OBSERVATION,value=0",
        "name=Custom Metrics|Thread Pool|http-listener-1|Max,aggregator=OBSERVATION,value=7", "name=Custom Metrics|n,aggregator=OBSERVATION,value=null"]


def test_metric_stream_shares_out_a_table_in_one_piece(spark, tmp_path):
    import duckdb

    duckdb.sql(f"""COPY (SELECT range AS event_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (range) SECOND AS ts, range % 3 AS user_id, 'view' AS event_type,
        1.5::DOUBLE AS value, '{{}}' AS props FROM range(40)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    rows = streams.stream_custom_metrics(spark, str(tmp_path))
    assert rows.count() == 40 * 18 and len(rows.inputFiles()) > 1
