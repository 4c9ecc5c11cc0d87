import pytest
from pyspark.sql import functions as F

from opsmetrics.functions import text, time, versions
from opsmetrics.operators.points import metric_name, tag_of
from opsmetrics.operators.rules import url_class


@pytest.mark.parametrize("a,b,equal", [
    ("4.5.6", "4.5.6.X", True), ("4", "4.5.6.1", False), ("4.5", "4.5.6.1", False), ("4.5", "4.5.6", False),
    ("4.5.6.1", "4.5.6.5", False), ("20.3.7.2", "20.3.7.2", True), ("4.5", "4.5", True),
])
def test_version_loose_eq(one, a, b, equal):
    assert one(versions.version_loose_eq("a", "b"), a=a, b=b) is equal


def test_version_helpers(one):
    assert one(versions.version_from_padded("v"), v="004-005-018-000") == "4.5.18.0"
    assert one(versions.is_version("v"), v="4.5.18") and not one(versions.is_version("v"), v="4.5")
    assert one(versions.version_newer("a", "b"), a="4.10.0", b="4.9.9")


@pytest.mark.parametrize("path,host", [
    ("214903_iostat_abcdef000003700.intranet.mycompany.com_1593031296.txt", "abcdef000003700"),
    ("/a/b_c/1_vmstat_my-host name.x_99.txt", "my_host_name"),
    ("1_vmstat_under_score_99.txt", "score"),
])
def test_host_from_path(one, path, host):
    assert one(text.host_from_path("p"), p=path) == host


@pytest.mark.parametrize("raw,want", [
    ("08/30/2016 10:00:00 PM", "2016-08-30T22:00:00"), ("08/30/16 12:05:09 AM", "2016-08-30T00:05:09"),
    ("08/30/16 12:05:09 PM", "2016-08-30T12:05:09"), ("08/30/75 01:02:03", "1975-08-30T01:02:03"), ("13/45/16 01:02:03", None),
])
def test_us_dates(one, raw, want):
    assert one(time.iso(time.parse_us("d")), d=raw) == want


def test_other_dates(one):
    assert one(time.iso(time.parse_long("d")), d="Tuesday 06 April 2021 12:17:01  IST") == "2021-04-06T12:17:01"
    assert one(time.parse_long("d"), d="Tuesday 06 Avril 2021 12:17:01  IST") is None
    assert one(time.iso(time.parse_iso("d")), d="2021-04-21T20:41:49-0700") == "2021-04-21T20:41:49"
    assert one(time.iso(time.parse_iso("d")), d="2021-04-21T20:41") == "2021-04-21T20:41:00"


def test_zones(one):
    # The second pass through a repeated hour is not told apart: the first is taken.
    at = time.epoch_in_zone(time.parse_iso("d"), "America/Los_Angeles")
    assert one(at, d="2020-11-01T01:30:00") == 1604219400
    assert one(at, d="2020-09-13T05:26:40") == 1600000000
    assert one(time.iso(time.ntz_in_zone(F.col("e").cast("bigint"), "America/Los_Angeles")), e="1600000000") == "2020-09-13T05:26:40"


def test_epochs_ignore_the_session_zone(spark, one):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert one(time.epoch_of(time.parse_iso("d")), d="2020-03-08T02:30:00") == 1583634600
        assert one(time.iso(time.ntz_of(F.lit(1583634600))), d="x") == "2020-03-08T02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("raw,secs", [("4d", 345600), ("3M", 180), ("2h", 7200), ("1w", 604800), ("1m", 2592000), ("5x", None)])
def test_durations(one, raw, secs):
    assert one(time.duration_seconds("d"), d=raw) == secs


def test_next_boundary(one):
    assert one(time.next_boundary(F.lit(1600000000).cast("bigint"), 30, 2)) == 1600000320
    for period, offset in time.SCHEDULES.values():
        p, o = period * 60, offset * 60
        for e in (o, o + 1, o - 1, 1600000000, p * 7 + o):
            assert one(time.next_boundary(F.lit(e).cast("bigint"), period, offset)) == ((e + (p - o)) // p) * p + o


@pytest.mark.parametrize("n", [0, 999, 1000, 1001, 42733500, 26564500, 999999, 1000001, 5_000_000_000, 7 * 10 ** 13, 2500500])
def test_human_bytes_rounds_as_printf(one, n):
    amount, unit = float(n), 0
    while amount > 1000 and unit < 4:
        amount /= 1000
        unit += 1
    assert one(text.human_bytes(F.lit(n).cast("bigint"))) == "%.3f%s" % (amount, " KMGT"[unit])


def test_scaled_round_matches_printf(one):
    for x in (0.35, 2.25, -0.35, 0.05, 12.345, 99.95, 1e-9, 0.25, 0.15):
        assert one(text.scaled_round(F.lit(x), 1) / 10.0) == float("%.1f" % x)


def test_text_helpers(one):
    assert one(text.pairs("s"), s="a=1,b=2,a=3,") == {"a": "3", "b": "2"}
    assert one(text.kb_to_mb(F.lit(2560))) == 2 and one(text.kb_to_mb(F.lit(1536))) == 2
    assert one(text.ceil_div(F.lit(8), 4)) == 2 and one(text.ceil_div(F.lit(9), 4)) == 3
    assert one(text.or_default("s", "d"), s="") == "d"
    assert one(text.metric_header("s"), s=" a%b%(c) ") == "apctb%_c"
    assert one(text.json_metric_sum("s"), s='[{"metricValues":[{"sum" : 1,234}]}]'.replace("1,234", "1234")) == 1234
    assert one(text.json_metric_sum("s"), s="[]") == 0
    assert metric_name(" a%b%(c) ") == "apctb%_c"
    assert [tag_of(c) for c in ("Device:", "buffer", "portx", "listener", "listenerx", "EVENT_NAME", "host", "w/s")] == [
        "device", "buffer", "port", "listener", None, "event", "connhost", None]


@pytest.mark.parametrize("path,label", [
    ("/controller/instance/7/metrics?x", "metrics"), ("/controller/instance/0/applicationConfiguration", "configreg"),
    ("/controller/instance/5/applicationConfiguration", "configuration"), ("/controller/sim/v2/user/app", "other"),
    ("/controller/restui/entity/search/x", "entitysearch"), ("/controller/restui/other", "other"), ("/", "other"),
])
def test_url_class(one, path, label):
    assert one(url_class("p"), p=path) == label
