"""Streams in event-time order: several files out of order, late rows, released state."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmetrics.plans import streams
from opsmetrics.session import scratch_path
from opsmetrics.streaming import eventtime, jobs

from .test_ordered import fold_bursts, skewed


def land(spark, rows, schema, clock, path, pieces=5, disorder=20, seed=1, late=()):
    """Rows as files in an order of arrival that is not that of their times; ``late`` rows come in the last file."""
    rnd = random.Random(seed)
    arrival = sorted(rows, key=lambda r: r[clock] + rnd.randint(0, disorder))
    size = len(arrival) // pieces + 1
    chunks = [arrival[k * size : (k + 1) * size] for k in range(pieces)]
    chunks[-1] = chunks[-1] + list(late)
    for chunk in chunks:
        rnd.shuffle(chunk)
        spark.createDataFrame(chunk, schema).withColumn("at", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(path)
    full = spark.read.parquet(path).schema
    jobs.close(spark, path, full, "at")
    return jobs.read_landed(spark, path, full, max_files=1)


def test_bursts_from_disordered_files(spark, tmp_path):
    rows = [(k or "none", t, i) for k, t, i in skewed(3, 400, 900)]
    last = max(t for _, t, _ in rows)
    late = [("none", last - 700 + j, 5000 + j) for j in range(7)]
    stream = land(spark, rows, "k string, t bigint, i bigint", 1, str(tmp_path / "l"), late=late)
    width = (last - min(t for _, t, _ in rows)) // 5
    # a piece is as wide as the rows' time over five, more or less
    got = jobs.run_counted(eventtime.burst_numbers(stream, ["k"], "at", "t", ["i"], lateness=f"{width + 60} seconds"), "b", timeout=300)
    assert {r["i"]: r["buffer"] for r in got.rows.collect()} == fold_bursts(rows)
    assert got.late == len(late) and got.state_rows == 0 and got.batches > 5


def test_in_order_pieces_with_short_lateness(spark, tmp_path):
    rows = [("a", 1000 + 7 * i + (i % 3), i) for i in range(300)] + [("b", 1500, 900)]
    stream = land(spark, rows, "k string, t bigint, i bigint", 1, str(tmp_path / "l"), pieces=6, disorder=0)
    got = jobs.run_counted(eventtime.burst_numbers(stream, ["k"], "at", "t", ["i"], lateness="400 seconds"), "b", timeout=300)
    assert {r["i"]: r["buffer"] for r in got.rows.collect()} == fold_bursts(rows)
    assert (got.late, got.state_rows) == (0, 0)


def test_calls_grow_neither_with_files_nor_with_keys(spark):
    """Files of one step make one micro-batch, and keys share state rows."""
    rows = spark.range(3000).selectExpr("'k' || id % 1500 AS k", "1000 + 700 * (id DIV 1500) + id % 5 AS t", "if(id = 7, null, id + 9007199254740993) AS event_id", "id AS c")
    stream, lateness = streams.landed(rows.repartition(5), "t", "many")
    got = jobs.run_counted(eventtime.rates(stream, ["k"], "at", "t", ["event_id"], "c", lateness=lateness), "r", timeout=300)
    found = {(r["k"], r["c"]): (r["event_id"], r["rate"]) for r in got.rows.collect()}
    assert found == {(f"k{i % 1500}", i): (None if i == 7 else i + 9007199254740993, 1500 / 700 if i >= 1500 else None) for i in range(3000)}
    assert got.batches <= streams.PIECES + 2 and 0 < got.state_rows <= eventtime.GROUPS and got.late == 0


def test_a_key_with_many_rows_is_folded_in_blocks(spark):
    """One key owns all rows: a call of the fold gets a few blocks of them, not all that the watermark passed at once."""
    n = 150_000
    rows = spark.range(n).selectExpr("'k' AS k", "if(id = 5, null, (id * 7919) % 150000) AS event_id", "5000 + (id * 7919) % 150000 DIV 10 AS t", "id % 3 = 0 AS odd", "cast(null AS string) AS note")

    def fold(rows, state):
        rows = list(rows)
        return [(state[0] + k, len(rows)) for k in range(len(rows))], (state[0] + len(rows),)

    stream, lateness = streams.landed(rows, "t", "hot")
    folded = eventtime.in_event_order(
        stream, ["k"], "at", ["event_id"], ["t"], {"place": T.LongType(), "size": T.LongType()}, ["n"], fold, (0,), lambda state, last: None, lateness)
    got = jobs.run_counted(folded, "f", timeout=300)
    lost = 5 * 7919 % n
    last = lost // 10 * 10 + 9  # a null id is the last one of its time
    place = lambda r: last if r["event_id"] is None else r["event_id"] - (lost < r["event_id"] <= last)
    found = got.rows.collect()
    assert len(found) == n and all(r["place"] == place(r) and r["odd"] is not None and r["note"] is None for r in found)
    assert max(r["size"] for r in found) <= 2 * eventtime.BLOCK and got.late == 0


def test_larger_inputs_land_in_more_steps(spark):
    """The same rows, in steps of about the rows asked for, within a lateness that shrinks with the steps."""
    rows = spark.range(2000).selectExpr("id % 3 AS k", "1000 + id * 10 AS t", "if(id = 7, null, id) AS event_id", "id % 4 <> 0 AS bad")
    found = []
    for step_rows in (None, 1000, 200):
        stream, lateness = streams.landed(rows, "t", "steps", step_rows)
        got = jobs.run_counted(eventtime.failure_fires(stream, ["k"], "at", "t", ["event_id"], "bad", lateness=lateness), "f", timeout=300)
        found.append((sorted(map(str, got.rows.drop("at").collect())), got.batches, int(lateness.split()[0])))
        assert got.late == 0 and got.state_rows <= 3
    assert found[0] == found[1] and found[0][0] == found[2][0] and len(found[0][0]) == 2000
    assert found[2][1] > found[0][1] and found[2][2] < found[0][2]


def test_runs_are_merged_by_time(monkeypatch):
    """Blocks ascend, and one time lies in one block, however many rows it has."""
    monkeypatch.setattr(eventtime, "RUN", 500)
    monkeypatch.setattr(eventtime, "BLOCK", 60)
    rnd, schema = random.Random(9), pa.schema([("x", pa.int64()), (eventtime.MS, pa.int64())])
    for span in (1, 7, 40, 100_000):
        rows = [(i, rnd.randrange(span)) for i in range(3000)]
        chunks = [pd.DataFrame(rows[k : k + 130], columns=schema.names) for k in range(0, 2000, 130)]
        waiting = eventtime._Run(schema)
        waiting.add(eventtime._in_time(pa.table(dict(zip(schema.names, zip(*rows[2080:]))), schema=schema)))
        blocks = list(eventtime._merged([eventtime._blocks(waiting.data()), *eventtime._runs(chunks, schema)]))
        assert sorted(x for b in blocks for x in b["x"].to_pylist()) == sorted(x for x, _ in rows)
        times = [b[eventtime.MS].to_numpy() for b in blocks]
        assert all(a.max() < b.min() for a, b in zip(times, times[1:]))
        assert span < 100_000 or max(map(len, times)) <= 60 * 6
    assert list(eventtime._merged([])) == []


def test_failures_and_silence(spark, tmp_path):
    rnd = random.Random(5)
    rows, t = [], 0
    for i in range(400):
        t += rnd.choice((30, 60, 60, 400, 4000 if i % 90 == 0 else 60))
        rows.append(("h", 10_000 + t, i, rnd.random() < 0.85))
    stream = land(spark, rows, "k string, t bigint, i bigint, bad boolean", 1, str(tmp_path / "l"))
    wanted, count, acted_at, before = {}, 0, -1, -1
    for _, t, i, bad in sorted(rows, key=lambda r: (r[1], r[2])):
        if before >= 0 and t - before > 3000:
            count, acted_at = 0, -1
        before = t
        count = count + 1 if bad else 0
        fired = count == 5
        acted = fired and (acted_at < 0 or t > acted_at + 1800)
        acted_at = t if acted else acted_at
        wanted[i] = (count, fired, acted)
        count = 0 if fired else count
    got = jobs.run_counted(eventtime.failure_fires(stream, ["k"], "at", "t", ["i"], "bad", ttl=3000, lateness="2 days"), "f", timeout=300)
    assert {r["i"]: (r["losecount"], r["fired"], r["acted"]) for r in got.rows.collect()} == wanted
    assert any(a for _, _, a in wanted.values()) and (got.late, got.state_rows) == (0, 0)


@pytest.mark.parametrize("ttl", [None, 500])
def test_rates(spark, tmp_path, ttl):
    rnd = random.Random(6)
    rows, t = [], 100
    for i in range(200):
        t += rnd.choice((0, 5, 60, 60, 700))
        rows.append((f"h{i % 2}", t, i, i * rnd.randint(1, 9)))
    stream = land(spark, rows, "k string, t bigint, i bigint, c bigint", 1, str(tmp_path / "l"))
    wanted, last = {}, {}
    for k, t, i, c in sorted(rows, key=lambda r: (r[1], r[2])):
        t0, c0 = last.get(k, (None, None))
        gap = None if t0 is None else t - t0
        wanted[i] = (c - c0) / gap if gap and (ttl is None or gap <= ttl) else None
        last[k] = (t, c)
    got = jobs.run_counted(eventtime.rates(stream, ["k"], "at", "t", ["i"], "c", ttl=ttl, lateness="2 days"), "r", timeout=300)
    assert {r["i"]: r["rate"] for r in got.rows.collect()} == pytest.approx(wanted)
    assert got.state_rows == (0 if ttl else 2)  # a counter's last sample stays unless it may be forgotten


def test_saturation_counts_rows_and_knows_empty_samples(spark, tmp_path):
    counts = {4: 5, 16: 5, 28: 4, 29: 50, 40: 9, 64: 1, 76: 1, 112: 3, 124: 2}  # minutes; 52, 88, 100 have no rows
    rows = [("s", m * 60 + j, 100 * m + j) for m, n in counts.items() for j in range(n)]
    stream = land(spark, rows, "k string, t bigint, i bigint", 1, str(tmp_path / "l"))
    samples = jobs.staged(eventtime.sampled_minutes(eventtime.minute_counts(stream, ["k"], "at", "2 hours")), "minutes", "at")
    got = jobs.run_counted(eventtime.saturation(samples, ["k"], "at", lateness="3 hours"), "s", timeout=300)
    rate = lambda m: counts.get(m, 0)
    wanted = {m: (rate(m), rate(m - 24) >= rate(m - 12) and rate(m - 24) >= rate(m)) for m in counts if m % 12 == 4}
    assert {r["ts_min"]: (r["rate"], r["saturated"]) for r in got.rows.collect()} == wanted
    assert {s for _, s in wanted.values()} == {True, False} and (got.late, got.state_rows) == (0, 0)


def test_periods_are_released(spark, tmp_path):
    rows = [("s", 60 * i, i) for i in range(500)]
    stream = land(spark, rows, "k string, t bigint, i bigint", 1, str(tmp_path / "l"), late=[("s", 5, 1000)])
    got = jobs.run_counted(jobs.sampled_stream(stream, "at", "30 minutes", ["k"], [F.count("*").alias("n")], "110 minutes"), "p", timeout=300)
    assert sorted(r["n"] for r in got.rows.collect()) == [20] + [30] * 16
    assert (got.late, got.state_rows) == (1, 0)


def lines_into(spark, chunks, path, **more):
    schema = "line string, host string, day string"
    landing = scratch_path(spark, "chunks")
    for chunk in chunks:
        spark.createDataFrame(chunk, schema).withColumn("ts", F.to_timestamp("day")).drop("day").coalesce(1).write.mode("append").parquet(landing)
    stream = jobs.read_landed(spark, landing, spark.read.parquet(landing).schema, max_files=1)
    jobs.distinct_lines(stream, ["line", "host"], "ts", path, scratch_path(spark, "progress"), **more).awaitTermination()


def test_a_repeat_days_after_is_dropped(spark):
    path = scratch_path(spark, "lines")
    chunks = [[("a", "h", "2024-01-01"), ("a", "h", "2024-01-01"), ("b", None, "2024-01-01"), ("n", "h", None)], [("c", "h", "2024-01-03")],
              [("a", "h", "2024-01-01"), ("b", None, "2024-01-01"), ("a", "h", "2024-01-04"), ("n", "h", None)]]
    for _ in range(2):  # the same chunks again, by another stream, change nothing
        lines_into(spark, chunks, path)
        assert sorted((r.line, str(r.day)) for r in spark.read.parquet(f"{path}/lines").collect()) == [
            ("a", "2024-01-01"), ("a", "2024-01-04"), ("b", "2024-01-01"), ("c", "2024-01-03"), ("n", "None")]


def test_lines_behind_the_kept_days_are_counted(spark):
    path = scratch_path(spark, "lines")
    lines_into(spark, [[("new", "h", "2024-01-20")], [("old", "h", "2024-01-02"), ("near", "h", "2024-01-15"), ("none", "h", None)], [("older", "h", "2024-01-01")]], path, keep_days=7)
    assert {r.line for r in spark.read.parquet(f"{path}/lines").collect()} == {"new", "near", "none"}
    assert {r.line for r in spark.read.parquet(f"{path}/late").collect()} == {"old", "older"}


def test_catch_up_copy_reads_its_range_only(spark, tmp_path):
    dest, landing = str(tmp_path / "dest"), str(tmp_path / "landing")
    spark.range(0, 1000).selectExpr("id", "id * 2 AS v").filter("id % 3 <> 0").repartitionByRange(8, "id").write.parquet(dest)
    spark.range(100, 200).selectExpr("id", "id * 2 AS v").coalesce(1).write.parquet(landing)
    for k in range(2):
        stream = jobs.read_landed(spark, landing, spark.read.parquet(landing).schema)
        jobs.copy_batches(stream, dest, ["id"], str(tmp_path / f"progress{k}")).awaitTermination()
        got = spark.read.parquet(dest)
        assert got.filter("id BETWEEN 100 AND 199").count() == 100 and got.count() == 666 + 33
