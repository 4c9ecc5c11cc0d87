"""Re-layout, capacity, store, ingest and streaming end to end on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from opsmetrics import ingest, registry
from opsmetrics.operators import capacity, fleet, relayout, saturation
from opsmetrics.operators.points import to_points, to_put_lines, to_wide
from opsmetrics.session import materialize, scratch_path, shared_dir
from opsmetrics.sinks import store
from opsmetrics.sources import files
from opsmetrics.sources.monitors import parse_vmstat



def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert materialize(spark.range(5)).count() == 5


@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("open_end", [True, False])
def test_assign_partition_equals_brute_force(spark, width, open_end):
    rnd = random.Random(8)
    cuts = sorted(rnd.sample(range(1, 200), 9))
    bounds = [(f"PART{i}", lo, hi) for i, (lo, hi) in enumerate(zip([0, *cuts], cuts))] + ([("PARTMAX", cuts[-1], None)] if open_end else [])
    keys = [-3, 0, *cuts, *[c - 1 for c in cuts], 10 ** 6]
    df = spark.createDataFrame([(k,) for k in keys], "ts_min bigint")
    b = spark.createDataFrame(bounds, "part string, lo bigint, hi bigint")
    got = sorted((r["ts_min"], r["part"]) for r in relayout.assign_partition(df, b, "ts_min", bin_width=width).collect())
    assert got == sorted((k, p) for k in keys for p, lo, hi in bounds if k >= lo and (hi is None or k < hi))


def catalog_rows(spark, limits):
    rows = [("m", f"PART{i}", 5, str(x)) for i, x in enumerate(limits)] + [("m", "PARTMAX", 0, "MAXVALUE")]
    return spark.createDataFrame(rows + rows[:1], "table string, part string, table_rows bigint, limit string")


def test_incremental_copy(spark):
    bounds = relayout.partition_bounds(catalog_rows(spark, [90, 200])).drop("table")  # numeric, not text, order
    assert {r["part"]: (r["lo"], r["hi"]) for r in bounds.collect()} == {"PART0": (0, 90), "PART1": (90, 200), "PARTMAX": (200, None)}
    src = spark.createDataFrame([(i, t) for i, t in enumerate([10, 20, 50, 100, 150, 150, 500])], "id bigint, ts_min bigint")
    dest = spark.createDataFrame([(0, 10), (2, 50), (3, 100)], "id bigint, ts_min bigint")
    report = {r["part"]: (r["src_max"], r["dest_max"]) for r in relayout.copy_report(src, dest, bounds).collect()}
    assert report == {"PART0": (50, 50), "PART1": (150, 100), "PARTMAX": (500, 0)}
    def copied(**kw):
        return {r["id"] for r in relayout.copy_new_rows(src.union(src), dest, bounds, ["id"], **kw).collect()}
    assert copied() == {4, 5}  # the hole at id 1 lies below the mark, the open partition is skipped
    assert copied(fill_holes=True) == {1, 4, 5}
    line = relayout.format_partition_report(relayout.copy_report(src, dest, bounds).filter("part = 'PART1'")).first()["value"]
    assert line == "PART1            150      100       50 ts_min >= 90 and ts_min < 200"


def test_status_and_diff(spark):
    report = spark.createDataFrame([("a", "P1", 5, 5), ("a", "P2", 6, 4), ("b", "P1", 1, 0), ("c", "P1", 1, 1), ("d", "P1", 1, 1)], "table string, part string, src_max bigint, dest_max bigint")
    tables = spark.createDataFrame([("a", False, True, False), ("b", False, False, False), ("c", True, True, True), ("d", True, True, False)], "table string, key_is_new boolean, dest_exists boolean, old_exists boolean")
    assert {r["table"]: r["status"] for r in relayout.relayout_status(report, tables).collect()} == {
        "a": "working 1 of 2", "b": "original 1 partitions", "c": "done old exists", "d": "done"}
    s, d = relayout.catalog_partitions(catalog_rows(spark, [90, 200])), relayout.catalog_partitions(catalog_rows(spark, [90]))
    assert [tuple(r) for r in relayout.partition_diff(s, d).collect()] == [("PART1", "add", 200)]
    assert [tuple(r) for r in relayout.partition_diff(d, s).collect()] == [("PART1", "drop", None)]


def test_export_pieces_make_up_the_input(spark):
    bounds = materialize(relayout.partition_bounds(catalog_rows(spark, [90, 200])).drop("table"))
    df = spark.createDataFrame([(i, i * 3) for i in range(100)], "id bigint, ts_min bigint")
    path = scratch_path(spark, "export")
    relayout.export_by_partition(df, bounds, "ts_min", ["id"], path)
    back = spark.read.parquet(path)
    assert back.select("id", "ts_min").exceptAll(df).isEmpty() and back.count() == 100
    relayout.import_partitions(materialize(back.filter("part = 'PART1' and id < 40")), path)
    counts = {r["part"]: r["count"] for r in spark.read.parquet(path).groupBy("part").count().collect()}
    assert counts == {"PART0": 30, "PART1": 10, "PARTMAX": 33}


def test_swap_and_reclaim(spark):
    spark.range(1).write.saveAsTable("m1")
    spark.range(2).write.saveAsTable("fast_m1")
    relayout.swap_table(spark, "m1")
    assert (spark.table("m1").count(), spark.table("old_m1").count()) == (2, 1)
    relayout.reclaim(spark, "m1")
    assert not spark.catalog.tableExists("old_m1")


def test_space_projection(spark):
    rows = [("metricdata_min#P#PART1#SP#PART1sp0.ibd", 100), ("metricdata_min#P#PART1#SP#PART1sp1.ibd", 300), ("metricdata_min#P#PARTMAX#SP#PARTMAXsp0.ibd", 9), ("x#P#PART2.ibd", 7)]
    listing = spark.createDataFrame(rows, "name string, size bigint")
    config = spark.createDataFrame([("metrics.min.retention.period", "4"), ("snapshots.retention.period", "9"), ("machine.snapshots.retention.period", "2")], "name string, value string")
    out = {(r["level"], r["group"], r["table"]): r for r in capacity.project_space(capacity.partition_files(listing), config).collect()}
    assert out["table", "minute", "metricdata_min"]["projection"] == 300 * 24 * 4
    assert out["table", "other", "x"]["projection"] == 0 and out["total", None, None]["size"] == 407
    kept = {r["group"]: r["retained"] for r in capacity.retention_settings(config).collect()}
    assert kept["snapshot"] == 9 and kept["machine snapshot"] == 2  # the longer name does not overwrite the shorter


def test_saturation_examples(spark):
    def last(rates, fn):
        df = spark.createDataFrame([(100 + i, r) for i, r in enumerate(rates) if r is not None], "ts_min bigint, rate bigint")
        return fn(df).orderBy(F.desc("ts_min")).first()["saturated"]
    assert last([1000000] * 3, saturation.saturated_by_samples) and last([1000000, 9998, 9999], saturation.saturated_by_samples)
    assert not last([5, 4, 6], saturation.saturated_by_samples) and not last([5], saturation.saturated_by_samples)
    assert not last([5, 5, 5], saturation.saturated_by_minutes) and last([5, None, 4], saturation.saturated_by_minutes)


def test_active_nodes_is_strict(spark):
    fact = spark.createDataFrame([(1, 100000), (2, 100000 - 43200), (3, 100001 - 43200)], "node_id bigint, ts_min bigint")
    assert {r["node_id"] for r in fleet.active_nodes(fact).collect()} == {1, 3}


def test_points_round_trip(spark):
    df = parse_vmstat(spark.createDataFrame([(" 1 9 500 20 8 900 0 0 5 6 100 200 3 1 96 0 0 2020-09-13T05:26:40", "h1")], "value string, host string")).rows
    points = to_points(df, "vmstat", host="host", load_id="L3")
    lines = {r["value"] for r in to_put_lines(points).collect()}
    assert "put vmstat 1600000000 5 col=bi host=h1 Z=L3" in lines and len(lines) == 13
    wide = to_wide(points, ["bi", "id"]).first()
    assert (wide["bi"], wide["id"]) == (5.0, 96.0)


def test_ingest_load_undo_and_empty(spark, tmp_path):
    d = tmp_path / "captures"
    d.mkdir()
    line = " 1 9 500 20 8 900 0 0 5 6 100 200 3 1 96 0 0 2020-09-13T05:26:40\n"
    for name in ("1_vmstat_hosta.x_100.txt", "2_vmstat_hosta.x_101.txt", "1_vmstat_host-b.x_100.txt"):
        (d / name).write_text(line)
    (d / "1_fdcount_hosta.x_100.txt").write_text("gf_fdcount=8\tmysql_fdcount=NO_X\t2020-09-13T05:26:40\n")
    (d / "1_numabuddyrefs_hosta.x_100.txt").write_text("datetime: 2020-09-13T05:26:40\n#section buddyinfo:\nNode 0, zone DMA 1 2 3 4 5 6 7 8 9 10 11\n\n#section procvmstat:\nnuma_hit 1\n\n#section numastat:\n Node 0 Total\n ---\nMemTotal 5 5\n\n")
    hosts = files.monitor_hosts(files.read_monitor(spark, "vmstat", [str(d)]))
    assert {r["host"] for r in hosts.collect()} == {"hosta", "host_b"}
    path, log = scratch_path(spark, "store"), scratch_path(spark, "log")
    report = {r["status"]: r for r in ingest.load_all(spark, [str(d)], path, log, ["vmstat", "fdcount", "procio", "dbtest", "numabuddyrefs"]).collect()}
    assert report["loaded"]["names"] == "fdcount numabuddyrefs vmstat" and report["empty"]["names"] == "procio" and report["loaded"]["exit_status"] == 0
    points = store.read_points(spark, path, log)
    counts = {(r["metric"], r["host"]): r["count"] for r in points.groupBy("metric", "host").count().collect()}
    assert counts["vmstat", "hosta"] == 13 and counts["vmstat", "host_b"] == 13  # the copied capture counts once
    assert counts["fdcount", "hosta"] == 2 and counts["numabuddyrefs", "hosta"] == 13
    seq = points.filter("metric = 'vmstat'").first()["load_seq"]
    points = materialize(points)
    store.undo_load(spark, log, seq)
    store.undo_load(spark, log, seq)
    assert store.read_points(spark, path, log).filter("metric = 'vmstat'").select("load_seq").distinct().count() == 1  # the other host's load stays
    for row in points.filter("metric = 'vmstat'").select("load_seq").distinct().collect():
        store.undo_load(spark, log, row["load_seq"])
    assert store.read_points(spark, path, log).filter("metric = 'vmstat'").isEmpty()
    assert store.next_load_id(store.read_log(spark, log)).first()["load_id"] == "L4"  # one number for each monitor and host
    store.empty_store(spark, path, log)
    assert store.next_load_id(store.read_log(spark, log)).first()["load_id"] == "L0"
    assert store.read_points(spark, path, log).isEmpty()


def test_ingest_keeps_rejects_and_numbers_loads(spark, tmp_path):
    d = tmp_path / "captures"
    d.mkdir()
    good = " 1 9 500 20 8 900 0 0 5 6 100 200 3 1 96 0 0 2020-09-13T05:26:40\n"
    bad = good.replace("2020-09-13", "2020-02-30") + good.replace(" 9 ", " x500 ") + "garbage\n"
    (d / "1_vmstat_007_100.txt").write_text(good + bad)
    path, log = scratch_path(spark, "store"), scratch_path(spark, "log")
    with pytest.warns(UserWarning, match="unknown monitor nonsense"):
        report = ingest.load_all(spark, [str(d)], path, log, ["vmstat", "nonsense"]).first()
    assert (report["status"], report["rejects"]) == ("loaded", 3)
    assert spark.read.parquet(f"{path}-rejects").filter("host = '007' AND file_path IS NOT NULL AND reason IS NOT NULL").count() == 3
    assert store.read_points(spark, path, log).filter("host = '007' AND load_seq = 0").count() == 13
    store.undo_load(spark, log, 0)
    ingest.load_all(spark, [str(d)], path, log, ["vmstat"])
    assert {(r["load_seq"], r["count"]) for r in store.read_points(spark, path, log).groupBy("load_seq").count().collect()} == {(1, 13)}
    with pytest.raises(ValueError, match="used already"):
        store.load_points(store.read_points(spark, path, log).drop("load_seq"), path, log, 1)


def test_registry_choice():
    assert registry.select_monitors(["vmstat", "nonsense"], None) == (["vmstat"], ["nonsense"])
    assert registry.select_monitors(["nonsense"], None)[0] == list(registry.MONITORS)
    assert "dbtest" not in registry.available_monitors()


def test_no_query_pins_a_machine_local_path(spark):
    import pathlib

    for f in pathlib.Path(ingest.__file__).parent.rglob("*.py"):
        text = f.read_text()
        assert "localCheckpoint" not in text and '"/tmp' not in text, f


def test_two_loaders_never_share_or_undo_a_number(spark):
    from concurrent.futures import ThreadPoolExecutor

    path, log = scratch_path(spark, "store"), scratch_path(spark, "log")
    with ThreadPoolExecutor(4) as pool:
        taken = [n for own in pool.map(lambda _: store.reserve(spark, log, 5), range(4)) for n in own]
    assert sorted(taken) == list(range(20))
    df = parse_vmstat(spark.createDataFrame([(" 1 9 500 20 8 900 0 0 5 6 100 200 3 1 96 0 0 2020-09-13T05:26:40", h) for h in ("a", "b", None)], "value string, host string")).rows
    points = to_points(df, "vmstat", host="host")
    mine, theirs = (dict(zip(("a", "b", None), store.reserve(spark, log, 3))) for _ in range(2))
    assert not set(mine.values()) & set(theirs.values()) and min(mine.values()) == 20
    store.load_points(points, path, log, mine)
    store.load_points(points, path, log, theirs)
    for n in mine.values():
        store.undo_load(spark, log, n, "vmstat")
    left = store.read_points(spark, path, log)
    assert {(r["host"], r["load_seq"], r["load_id"]) for r in left.select("host", "load_seq", "load_id").distinct().collect()} == {
        (h, n, f"L{n}") for h, n in theirs.items()}
    with pytest.raises(ValueError, match="used already"):
        store.load_points(points, path, log, theirs["a"])


def test_copy_reads_pushed_ranges(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "id AS ts_min", "id % 7 AS v")
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    rows.write.parquet(src)
    rows.filter("id < 450 OR id BETWEEN 600 AND 799").write.parquet(dst)
    bounds = materialize(relayout.partition_bounds(catalog_rows(spark, [200, 400, 600, 800, 1000])).drop("table"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    got = relayout.copy_new_rows(spark.read.parquet(src), spark.read.parquet(dst), bounds, ["id", "ts_min"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "ts_min" in line]
    assert len(scans) >= 2
    for scan in scans:  # the two partitions that lag, each as a range, in both scans
        pushed = scan[scan.index("PushedFilters"):]
        assert all(f"(ts_min,{n})" in pushed for n in (400, 600, 800, 1000)), pushed
    assert sorted(r["id"] for r in got.collect()) == [*range(450, 600), *range(800, 1000)]


def test_export_keeps_rows_outside_all_ranges(spark):
    bounds = materialize(relayout.partition_bounds(catalog_rows(spark, [90, 200])).drop("table").filter("hi IS NOT NULL"))
    df = spark.createDataFrame([(1, 5), (2, 150), (3, 200), (4, -1), (5, None)], "id bigint, ts_min bigint")
    path = scratch_path(spark, "export")
    relayout.export_by_partition(df, bounds, "ts_min", ["id"], path)
    assert {r["id"]: r["part"] for r in relayout.exported(spark, path).collect()} == {1: "PART0", 2: "PART1"}
    assert sorted((r["id"], r["ts_min"]) for r in relayout.outside_ranges(spark, path).collect()) == [(3, 200), (4, -1), (5, None)]


def test_captures_with_other_columns_load_as_they_are(spark, tmp_path):
    d = tmp_path / "captures"
    d.mkdir()
    at = "2020-09-13T05:26:40"
    (d / "1_dbvars_hosta.x_100.txt").write_text(
        f"timestamp,Queries,New_counter\n{at},5,6\n{at},7,8\ntimestamp,Only\n{at},9\n{at},1,2\n"
        f"Queries=1,Fresh=2\t{at}\nQueries=x,Fresh=2\t{at}\n{at},get DB stats timed out\n")
    (d / "1_procio_hosta.x_100.txt").write_text(f"{at} gf rchar=1 wchar=2 brand_new=3\n{at} gf rchar=one\n")
    (d / "1_gfpools_hosta.x_100.txt").write_text(
        f"#section thread-pool:\ntimestamp,listener,conq_open,extra\n{at},http,1,2\n\n#section newer:\ntimestamp,pool,depth\n{at},p1,4\n{at},p1\n\n#section error:\n{at} timed out\n")
    (d / "1_memsize_hosta.x_100.txt").write_text(f"{at} gf peak_m=1 rss_m=2 swap_m=3 threads=4 more_m=5\n")
    path, log = scratch_path(spark, "store"), scratch_path(spark, "log")
    report = ingest.load_all(spark, [str(d)], path, log, ["dbvars", "procio", "gfpools", "memsize"], zone="UTC").collect()
    assert [(r["status"], r["rejects"]) for r in report] == [("loaded", 4)]
    got = {(r["metric"], r["col"], r["value"]) for r in store.read_points(spark, path, log).collect()}
    assert got == {
        ("dbvars", "Queries", 5.0), ("dbvars", "New_counter", 6.0), ("dbvars", "Queries", 7.0), ("dbvars", "New_counter", 8.0), ("dbvars", "Only", 9.0),
        ("dbvars", "Queries", 1.0), ("dbvars", "Fresh", 2.0), ("procio", "rchar", 1.0), ("procio", "wchar", 2.0), ("procio", "brand_new", 3.0),
        ("gfpools", "conq_open", 1.0), ("gfpools", "extra", 2.0), ("gfpools", "depth", 4.0),
        *(("memsize", c, float(k)) for k, c in enumerate(("peak_m", "rss_m", "swap_m", "threads", "more_m"), start=1))}
    tags = {r["col"]: r["tags"] for r in store.read_points(spark, path, log).collect()}
    assert tags["depth"] == {"pool": "p1"} and tags["extra"] == {"listener": "http"} and tags["brand_new"] == {"node": "gf"}
    bad = {r["value"] for r in spark.read.parquet(f"{path}-rejects").collect()}
    assert bad == {f"{at},1,2", f"Queries=x,Fresh=2\t{at}", f"{at} gf rchar=one", f"{at},p1"}


def test_points_without_a_place_are_no_lines(spark):
    from opsmetrics.operators.points import without_place

    rows = [("m", 5, "c", "1", "h"), ("m", None, "c", "1", "h"), ("m", 6, "c", "2", None), ("m", 7, None, "2", "h")]
    points = spark.createDataFrame(rows, "metric string, epoch bigint, col string, raw string, host string").selectExpr(
        "*", "cast(raw as double) AS value", "cast(map() as map<string,string>) AS tags", "'L1' AS load_id")
    assert sorted(r["value"] for r in to_put_lines(points).collect()) == ["put m 5 1 col=c host=h Z=L1", "put m 6 2 col=c Z=L1"]
    assert without_place(points).count() == 2
