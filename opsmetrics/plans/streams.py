"""Streaming queries: landed files are run to the end and must equal their batch counterparts.

The events land as several files, in an order of arrival that is not the order of their times. Streams are keyed by host
alone, like their batch twins; a host's state is a few numbers and the rows the watermark has not passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import ntz_of
from ..operators.points import to_points
from ..registry import MONITORS, registry_frame, select_monitor_rows
from ..session import scratch_path
from ..sinks import store
from ..sources import appserver
from ..sources.files import monitor_availability, monitor_hosts
from ..streaming import eventtime, jobs
from .base import BURSTS, START, E, events, query, recursive, table, with_helpers
from .roundtrips import CUSTOM, _dumps


def _stream(spark, sf) -> DataFrame:
    """The events as they lie, in one pass; for streams without any order."""
    schema = table(spark, sf, "events").schema
    return with_helpers(jobs.read_landed(spark, sf, schema, glob="events.parquet", max_files=64))


PIECES, DISORDER = 4, 600
STEP_ROWS = 1_000_000


def landed(rows: DataFrame, clock: str, name: str, step_rows: int | None = None) -> tuple[DataFrame, str]:
    """(``rows`` as a stream, how late a row may be) after landing in ``PIECES`` steps of arrival, up to ``DISORDER`` seconds off their times.

    ``clock`` are seconds; the stream has them as the timestamp ``at``. A file that only moves the clock lands last. A
    micro-batch takes as many files as a step lands, so that their number does not grow with the input; with
    ``step_rows``, larger inputs land in more steps, of that many rows on average, so that their size does not.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("at", F.timestamp_seconds(clock))
    arrival = F.col(clock) + F.pmod(F.xxhash64("event_id"), F.lit(DISORDER))
    span = rows.agg(F.min(arrival).alias("lo"), F.max(arrival).alias("hi"), F.count("*").alias("n")).first()
    path = scratch_path(spark, name)
    width, files = 1, [0, 1]
    if span["lo"] is not None:
        pieces = max(PIECES, -(-span["n"] // step_rows)) if step_rows else PIECES
        width = (span["hi"] - span["lo"]) // pieces + 1
        step, source = F.floor((arrival - span["lo"]) / width), rows
        if pieces > PIECES:  # one pass over the input, not one for each step
            held = scratch_path(spark, f"{name}-steps")
            rows.withColumn("__step", step).write.partitionBy("__step").parquet(held)
            source, step = spark.read.parquet(held), F.col("__step")
        for k in range(pieces):
            source.filter(step == k).select(rows.columns).write.mode("append").parquet(path)
            files.append(len(spark.read.schema(rows.schema).parquet(path).inputFiles()))
    jobs.close(spark, path, rows.schema, "at")
    most = max(b - a for a, b in zip(files, files[1:]))
    return jobs.read_landed(spark, path, rows.schema, max_files=most), f"{2 * width + DISORDER} seconds"


@query("stream_buffer_numbers", recursive(E) + ", r AS (SELECT host AS k, fast AS t, event_id FROM e)" + BURSTS.format(order="t, event_id")
       + "SELECT event_id, buffer FROM b")
def stream_buffer_numbers(spark, sf) -> DataFrame:
    s, lateness = landed(events(spark, sf).select("host", "fast", "event_id"), "fast", "landed-bursts")
    return jobs.run_available(eventtime.burst_numbers(s, ["host"], "at", "fast", ["event_id"], lateness=lateness), "buffers").select("event_id", "buffer")


FIRES = "WITH RECURSIVE" + E[4:] + """, p AS (SELECT user_id % 10 AS host_id, epoch, event_id, event_type <> 'purchase' AS failed,
    row_number() OVER (PARTITION BY user_id % 10 ORDER BY epoch, event_id) AS rn FROM e)
, s AS (SELECT host_id, epoch, event_id, rn, CASE WHEN failed THEN 1 ELSE 0 END AS losecount, -1::BIGINT AS last, false AS acted FROM p WHERE rn = 1
  UNION ALL SELECT p.host_id, p.epoch, p.event_id, p.rn,
    CASE WHEN NOT p.failed THEN 0 WHEN s.losecount = 5 THEN 1 ELSE s.losecount + 1 END,
    CASE WHEN p.failed AND s.losecount = 4 AND (s.last < 0 OR p.epoch > s.last + 1800) THEN p.epoch ELSE s.last END,
    p.failed AND s.losecount = 4 AND (s.last < 0 OR p.epoch > s.last + 1800)
  FROM s JOIN p ON p.host_id = s.host_id AND p.rn = s.rn + 1)
"""


@query("stream_failure_fires", FIRES + "SELECT event_id, CAST(losecount AS BIGINT) AS losecount, losecount = 5 AS fired, acted FROM s")
def stream_failure_fires(spark, sf) -> DataFrame:
    # Spark hands a key's state to Python once for every 10,000 new rows, and ten keys own all rows
    s, lateness = landed(events(spark, sf).select(
        (F.col("user_id") % 10).alias("host_id"), "epoch", "event_id", (F.col("event_type") != "purchase").alias("failed")), "epoch", "landed-pings", STEP_ROWS)
    return jobs.run_available(
        eventtime.failure_fires(s, ["host_id"], "at", "epoch", ["event_id"], "failed", lateness=lateness), "fires"
    ).select("event_id", "losecount", "fired", "acted")


@query("stream_rates", E + """, p AS (SELECT event_id, epoch, lag(epoch) OVER w AS e0, lag(event_id) OVER w AS i0 FROM e WINDOW w AS (PARTITION BY host ORDER BY epoch, event_id))
SELECT event_id, round(CASE WHEN epoch > e0 THEN CAST((event_id - i0) * 3 AS DOUBLE) / (epoch - e0) END, 9) AS rate FROM p""")
def stream_rates(spark, sf) -> DataFrame:
    s, lateness = landed(events(spark, sf).select("host", "epoch", "event_id", (F.col("event_id") * 3).alias("requests")), "epoch", "landed-counters")
    return jobs.run_available(
        eventtime.rates(s, ["host"], "at", "epoch", ["event_id"], "requests", lateness=lateness), "rates"
    ).select("event_id", F.round("rate", 9).alias("rate"))


# Event time runs 60 times faster, so that minutes hold rows to count; two sources of rows.
@query("stream_saturation", E + f""", c AS (SELECT user_id % 2 AS side, ((epoch - {START}) // 60 + {START}) // 60 AS ts_min, count(*) AS rate FROM e GROUP BY ALL)
, s AS (SELECT * FROM c WHERE (ts_min + 8) % 12 = 0)
SELECT a.side, a.ts_min, a.rate, coalesce(p2.rate, 0) >= coalesce(p1.rate, 0) AND coalesce(p2.rate, 0) >= a.rate AS saturated
FROM s a LEFT JOIN s p1 ON p1.side = a.side AND p1.ts_min = a.ts_min - 12 LEFT JOIN s p2 ON p2.side = a.side AND p2.ts_min = a.ts_min - 24""")
def stream_saturation(spark, sf) -> DataFrame:
    """Rows counted per minute in event time; every 12 minutes the minute 8 minutes back is held against the two samples before."""
    s, lateness = landed(events(spark, sf).select(
        (F.col("user_id") % 2).alias("side"), "event_id", (F.floor((F.col("epoch") - START) / 60).cast("bigint") + START).alias("paced")), "paced", "landed-ingest")
    samples = jobs.staged(eventtime.sampled_minutes(eventtime.minute_counts(s, ["side"], "at", lateness)), "minutes", "at")
    return jobs.run_available(eventtime.saturation(samples, ["side"], "at", lateness=lateness), "saturation").select("side", "ts_min", "rate", "saturated")


@query("stream_sampled_periods", """SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%dT%H:%M:%S') AS period_start, event_type,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_sampled_periods(spark, sf) -> DataFrame:
    s, lateness = landed(events(spark, sf).select("event_id", "epoch", "event_type", "cents"), "epoch", "landed-samples")
    sampled = jobs.sampled_stream(s, "at", "30 minutes", ["event_type"], [F.sum("cents").alias("total"), F.count("*").alias("n")], lateness)
    text = F.date_format("period_start", "yyyy-MM-dd'T'HH:mm:ss")
    return jobs.run_available(sampled, "sampled").select(text.alias("period_start"), "event_type", "total", "n")


@query("stream_until_deadline", E + "SELECT event_id, iso FROM e WHERE ts < TIMESTAMP '2024-01-11 00:00:00'")
def stream_until_deadline(spark, sf) -> DataFrame:
    s = jobs.until(_stream(spark, sf), "ts", F.expr("timestamp_ntz'2024-01-11 00:00:00'"))
    return jobs.run_available(s.select("event_id", "iso"), "deadline")


@query("stream_distinct_lines", E + "SELECT DISTINCT host, iso, cents FROM e")
def stream_distinct_lines(spark, sf) -> DataFrame:
    """Every line arrives twice, as from overlapping log chunks: some at once, others two days after."""
    rows = events(spark, sf).select("event_id", "epoch", "host", "iso", "cents")
    again = rows.withColumn("arrived", F.col("epoch") + F.when(F.col("event_id") % 2 == 0, 172_800).otherwise(0))
    s, _ = landed(rows.withColumn("arrived", F.col("epoch")).union(again), "arrived", "landed-lines")
    path = scratch_path(spark, "lines")
    lines = s.filter("host IS NOT NULL").select("host", "iso", "cents", F.timestamp_seconds("epoch").alias("ts"))
    jobs.distinct_lines(lines, ["host", "iso", "cents"], "ts", path, scratch_path(spark, "lines-progress")).awaitTermination()
    return spark.read.parquet(f"{path}/lines").select("host", "iso", "cents")


@query("stream_custom_metrics", CUSTOM + "SELECT event_id, 'name=Custom Metrics|' || name || ',aggregator=OBSERVATION,value=' || value AS value FROM m")
def stream_custom_metrics(spark, sf) -> DataFrame:
    # a table may be a single piece of a file, and the work on a row is large
    rows = _stream(spark, sf).repartition(spark.sparkContext.defaultParallelism)
    named = appserver.appserver_metrics(_dumps(rows).select("event_id", "value"))
    return jobs.run_available(named.select("event_id", appserver.custom_metric_line()), "custom")


@query("stream_catch_up_copy", "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders")
def stream_catch_up_copy(spark, sf) -> DataFrame:
    """Copies into a destination that already holds two thirds of the orders, then runs again and finds nothing to do."""
    orders = table(spark, sf, "orders")
    dest = scratch_path(spark, "copied")
    orders.filter("o_orderkey % 3 <> 0").write.parquet(dest)
    for _ in range(2):
        landed = jobs.read_landed(spark, sf, orders.schema, glob="orders.parquet")
        jobs.copy_batches(landed, dest, ["o_orderkey"], scratch_path(spark, "copy-progress")).awaitTermination()
    return spark.read.parquet(dest).select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("price"))


# --------------------------------------------------------------------------- store, files, registry


@query("store_after_undo", E + """SELECT metric, host, 'L' || seq AS load_id, count(*) AS points, CAST(sum(cents) AS BIGINT) AS total FROM (
  SELECT 'busy' AS metric, 'h' || (user_id % 10) AS host, 
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS seq, cents FROM e WHERE event_type <> 'view') GROUP BY 1, 2, 3""")
def store_after_undo(spark, sf) -> DataFrame:
    """Five loads, one for each type of event, the second withdrawn."""
    path, log = scratch_path(spark, "points"), scratch_path(spark, "load-log")
    for kind in ("click", "view", "error", "purchase", "signup"):
        rows = events(spark, sf).filter(F.col("event_type") == kind).select(
            F.col("ts").alias("timestamp"), F.concat(F.lit("h"), (F.col("user_id") % 10).cast("string")).alias("host"), "cents")
        seq = store.next_load_id(store.read_log(spark, log)).first()["load_seq"]
        store.load_points(to_points(rows, "busy", "UTC", host="host"), path, log, seq)
    store.undo_load(spark, log, 1)
    return store.read_points(spark, path, log).groupBy("metric", "host", "load_id").agg(
        F.count("*").alias("points"), F.sum("value").cast("bigint").alias("total"))


@query("partition_export_import", """SELECT 'PART' || year(o_orderdate) AS part, count(*) AS n, CAST(sum(CASE WHEN year(o_orderdate) = 1997 THEN 2 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS price
FROM orders GROUP BY 1""")
def partition_export_import(spark, sf) -> DataFrame:
    """Exports orders by year, then replaces one partition, twice, with doubled prices."""
    from ..operators import relayout
    from .analytics import _bounds, _metric_rows

    rows = _metric_rows(spark, sf).select("table", "o_orderkey", "ts_min", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("price"))
    path = scratch_path(spark, "export")
    relayout.export_by_partition(rows, _bounds(spark, sf), "ts_min", ["o_orderkey"], path, on=["table"])
    doubled = rows.filter(F.year(ntz_of(F.col("ts_min") * 60)) == 1997).withColumn("part", F.lit("PART1997")).withColumn("price", F.col("price") * 2)
    for _ in range(2):
        relayout.import_partitions(doubled, path)
    return relayout.exported(spark, path).groupBy("part").agg(F.count("*").alias("n"), F.sum("price").alias("price"))


@query("csv_round_trip", E + "SELECT host, iso AS timestamp, cents FROM e")
def csv_round_trip(spark, sf) -> DataFrame:
    path = scratch_path(spark, "csv")
    store.write_csv(events(spark, sf).select("host", F.col("iso").alias("timestamp"), "cents"), path)
    return spark.read.schema("timestamp string, host string, cents bigint").csv(path, header=True).select("host", "timestamp", "cents")


# Document sources as hosts, their languages as monitors.
MONITOR_OF = "CASE lang WHEN 'en' THEN 'iostat' WHEN 'fr' THEN 'vmstat' WHEN 'de' THEN 'memsize' ELSE 'unknown' END"


@query("monitor_hosts", "SELECT DISTINCT source AS host FROM documents")
def hosts(spark, sf) -> DataFrame:
    return monitor_hosts(table(spark, sf, "documents").select(F.col("source").alias("host")))


@query("monitor_availability", f"""WITH f AS (SELECT {MONITOR_OF} AS monitor, count(*) AS files FROM documents GROUP BY 1)
SELECT r.monitor, r.supported, coalesce(files, 0) AS files, coalesce(files, 0) > 0 AS has_data FROM (VALUES """ + ", ".join(
    f"('{m}', {str(MONITORS[m].parse is not None).lower()})" for m in MONITORS) + ") r(monitor, supported) LEFT JOIN f ON f.monitor = r.monitor")
def availability(spark, sf) -> DataFrame:
    files = table(spark, sf, "documents").select(F.expr(MONITOR_OF).alias("monitor"))
    return monitor_availability(files, registry_frame(spark))


@query("monitor_selection", "SELECT DISTINCT source AS monitor FROM documents WHERE source IN ('src1', 'src2', 'src3') AND source <> 'src2'")
def monitor_selection(spark, sf) -> DataFrame:
    registry = table(spark, sf, "documents").select(F.col("source").alias("monitor")).distinct()
    return select_monitor_rows(registry, ["src1", "src2", "src3", "nonsense"], ["src2"])


OUTCOME = "CASE WHEN n_chars % 3 = 0 THEN 'empty' WHEN n_chars % 3 = 1 THEN 'failed' ELSE 'loaded' END"


@query("load_report", f"""WITH o AS (SELECT DISTINCT source AS monitor, {OUTCOME} AS status FROM documents)
SELECT status, count(*) AS monitors, string_agg(monitor, ' ' ORDER BY monitor) AS names,
  (SELECT count(*) FROM o WHERE status = 'loaded') = (SELECT count(DISTINCT source) FROM documents) AS all_loaded,
  CASE WHEN (SELECT count(*) FROM o WHERE status = 'failed') > 0 OR (SELECT count(*) FROM o WHERE status = 'loaded') = 0 THEN 1 ELSE 0 END AS exit_status
FROM o GROUP BY 1""")
def load_report(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    outcomes = docs.select(F.col("source").alias("monitor"), F.expr(OUTCOME).alias("status"))
    return store.load_report(outcomes, docs.select(F.col("source").alias("monitor")).distinct())
