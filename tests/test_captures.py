"""Capture files read in splits: the same rows, rejects and content keys wherever a file is cut."""

import random

import pytest
from pyspark.sql import functions as F

from opsmetrics.sources import files, iostat


@pytest.fixture(params=[150, 700, 1 << 20])
def cut(request, spark):
    """Reads that cut files every so many bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def report(style, samples, first=0):
    banner = {"us": "08/30/2016", "iso": "2021-04-21", "long": "Tuesday 06 April 2021"}[style]
    out = [f"Linux 3.10.0 (host) \t{banner} \t_x86_64_\t(8 CPU)", ""]
    for k in range(samples):
        m = first + k
        clock = f"{m // 60 % 24:02d}:{m % 60:02d}:07"
        out.append({"us": f"08/30/2016 {clock}", "iso": f"2021-04-21T{clock}+00", "long": f"Tuesday 06 April 2021 {clock}  IST"}[style])
        out += ["avg-cpu:  %user   %nice %system %iowait  %steal   %idle", f"           {m}.00    0.00    0.50    0.10    0.00   98.40", "",
                "Device:         rrqm/s     r/s   %util", f"sda   0.00  {m}.50   1.00", "dm-0   9.00   9.00   9.00", f"nvme0n1   0.00  {m}.25   2.00", ""]
    return out


def captured(tmp_path, name, lines, end="\n"):
    (tmp_path / name).write_bytes((end.join(lines) + end).encode())


def test_iostat_cut_anywhere(spark, tmp_path, cut):
    captured(tmp_path, "1_iostat_hosta.x_1.txt", report("us", 25) + report("long", 10))
    captured(tmp_path, "1_iostat_hostb.x_1.txt", report("iso", 20), "\r\n")
    lost = report("iso", 6)
    at = [k for k, line in enumerate(lost) if line.startswith("2021")][3]
    lost[at] = "21 April at noon"
    captured(tmp_path, "1_iostat_hostc.x_1.txt", ["stray line", *lost])
    lines = files.read_monitor(spark, "iostat", [str(tmp_path)], places=True)
    assert (lines.rdd.getNumPartitions() > 8) == (cut < 1000)
    got = iostat.parse_iostat(lines)
    rows = sorted((r["host"], str(r["timestamp"]), r["device"], r["measures"]["r/s"], r["measures"]["%user"]) for r in got.rows.collect())
    want = []
    for host, day, n in (("hosta", "2016-08-30", 25), ("hosta", "2021-04-06", 10), ("hostb", "2021-04-21", 20), ("hostc", "2021-04-21", 6)):
        for m in range(n):
            if (host, m) != ("hostc", 3):
                for device, more in (("sda", 0.5), ("nvme0n1", 0.25)):
                    want.append((host, f"{day} 00:{m:02d}:07", device, m + more, float(m)))
    assert rows == sorted(want)
    rejects = sorted((r["host"], r["value"], r["reason"]) for r in got.rejects.collect())
    assert rejects == [("hostc", "21 April at noon", "not a line of a report"), ("hostc", "nvme0n1   0.00  3.25   2.00", "not a device row"),
                       ("hostc", "sda   0.00  3.50   1.00", "not a device row"), ("hostc", "stray line", "not a line of a report")]


def test_clock_reports_cut_anywhere(spark, tmp_path, cut):
    def clocked(date, clocks):
        out = [f"Linux 2.6 (h) {date}", ""]
        for c in clocks:
            out += [f"Time: {c}", "avg-cpu:  %user   %idle", "           1.00   98.40", "", "Device:   r/s   %util", "sda   0.50   1.00", ""]
        return out

    times = ["09:36:02 AM", "07:36:02 PM", "12:00:30 AM", "01:00:00 PM", "03:00:00 AM"]
    captured(tmp_path, "1_iostat_hosta.x_1.txt", clocked("08/30/16", times) + clocked("01/01/17", times[:3]))
    got = iostat.parse_iostat_clock(files.read_monitor(spark, "iostat", [str(tmp_path)], places=True))
    assert sorted(str(r["timestamp"]) for r in got.rows.collect()) == [
        "2016-08-30 09:36:00", "2016-08-30 19:36:00", "2016-08-31 00:00:00", "2016-08-31 13:00:00", "2016-09-01 03:00:00",
        "2017-01-01 09:36:00", "2017-01-01 19:36:00", "2017-01-02 00:00:00"]
    assert got.rejects.count() == 0


def test_headers_are_carried_over_splits(spark, tmp_path, cut):
    lines, want = ["early,1"], []
    for b in range(4):
        names = ["timestamp", f"c{b}", "x%"]
        lines.append(",".join(names))
        for k in range(17 * (b + 1)):
            cells = [f"2021-01-01T00:{b:02d}:{k % 60:02d}", str(k), "1"][: 3 if k % 5 else 2]
            lines.append(",".join(cells) + (",9,9" if k == 7 else ""))
            if k != 7:
                want.append(dict(zip(["timestamp", f"c{b}", "xpct"], [*cells, None])) | ({} if k % 5 else {"xpct": None}))
    captured(tmp_path, "1_vmstat_hosta.x_1.txt", lines)
    got = files.read_multi_header_csv(files.read_monitor(spark, "vmstat", [str(tmp_path)], places=True))
    key = lambda c: sorted(c.items(), key=str)
    assert sorted((r["cells"] for r in got.rows.collect()), key=lambda c: str(key(c))) == sorted(want, key=lambda c: str(key(c)))
    assert sorted({r["block"] for r in got.rows.select("block").distinct().collect()}) == [1, 2, 3, 4]
    assert {r["reason"]: r["n"] for r in got.rejects.groupBy("reason").agg(F.count("*").alias("n")).collect()} == {
        "no header before the line": 1, "more cells than the header has": 4}


def test_content_keys_of_files_in_many_tasks(spark, tmp_path, cut):
    rnd = random.Random(4)
    lines = [str(rnd.randint(0, 50)) for _ in range(900)]
    swapped = list(lines)
    a, b = next((i, j) for i in range(900) for j in range(i + 1, 900) if lines[i] != lines[j] and len(lines[i]) == len(lines[j]))
    swapped[a], swapped[b] = swapped[b], swapped[a]
    for name, own in (("a", lines), ("b", lines), ("c", swapped), ("d", lines[:-1] + ["1" * len(lines[-1])]), ("e", [])):
        captured(tmp_path, f"{name}_vmstat_hosta.x_1.txt", own)
    every = files.list_captures(spark, "vmstat", [str(tmp_path)]).collect()
    keys = {r["file_path"].rsplit("/", 1)[1][0]: r["md5"] for r in every}
    assert keys["a"] == keys["b"] and len({keys[k] for k in "acde"}) == 4
    unique = files.dedupe_files(files.list_captures(spark, "vmstat", [str(tmp_path)]))
    assert sorted(r["file_path"].rsplit("/", 1)[1][0] for r in unique.collect()) == ["a", "c", "d", "e"]
    placed = files.read_monitor(spark, "vmstat", [str(tmp_path)], record_sep="\n", places=True)
    first = next(r["file_path"] for r in every if r["file_path"].rsplit("/", 1)[1][0] == "a")
    pairs = spark.createDataFrame([(r["file_path"], first) for r in every], "file_path string, first string")
    assert sorted(r["file_path"].rsplit("/", 1)[1][0] for r in files.unequal_content(placed, pairs).collect()) == ["c", "d", "e"]
