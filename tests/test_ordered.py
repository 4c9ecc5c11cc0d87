import random

import pytest
from pyspark.sql import functions as F

from opsmetrics.operators import health, ordered
from opsmetrics.operators.bursts import burst_numbers, spaced_picks
from opsmetrics.operators.ordered import KEY, SLICE, previous, row_numbers, time_slice, with_slice


def fold_bursts(rows, max_gap=15, max_group=4):
    """The rule read literally: one pass in time order per key."""
    out, state = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        anchor, n = state.get(k, (None, 0))
        if n and n < max_group and t - anchor <= max_gap:
            n += 1
        else:
            anchor, n = t, 1
        state[k] = (anchor, n)
        out[i] = n
    return out


def fold_picks(rows, gap):
    out, last = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        take = k not in last or t > last[k] + gap
        if take:
            last[k] = t
        out[i] = take
    return out


def skewed(seed, n=900, span=1500):
    """One key owns a third of the rows, another none; some keys are null."""
    rnd = random.Random(seed)
    return [(rnd.choice(["hot"] * 3 + ["a", "b", "c", "d", "e", None]), rnd.randrange(span), i) for i in range(n)]


@pytest.mark.parametrize("width", [16, 40, 100000])
@pytest.mark.parametrize("seed", [1, 2])
def test_bursts_equal_the_sequential_fold(spark, width, seed):
    rows = skewed(seed)
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint")
    got = {r["i"]: r["buffer"] for r in burst_numbers(df, ["k"], "t", ["i"], slice_seconds=width).collect()}
    assert got == fold_bursts(rows)


def test_bursts_without_keys_and_sparse_slices(spark):
    rows = [(None, t, i) for i, t in enumerate([0, 1, 2, 3, 4, 17, 31, 32, 200, 500, 501, 515, 516])]
    df = spark.createDataFrame([(t, i) for _, t, i in rows], "t bigint, i bigint")
    got = {r["i"]: r["buffer"] for r in burst_numbers(df, [], "t", ["i"], slice_seconds=16).collect()}
    assert got == fold_bursts(rows)


def test_state_crosses_batches(spark):
    """Slices longer than an Arrow batch, and batches without the end of any slice."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    rows = skewed(9, 700, 1200)
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint")
    try:
        spark.conf.set(size, 7)
        for width in (50, 100000):
            got = {r["i"]: r["buffer"] for r in burst_numbers(df, ["k"], "t", ["i"], slice_seconds=width).collect()}
            assert got == fold_bursts(rows)
            got = {r["i"]: r["picked"] for r in spaced_picks(df, ["k"], "t", ["i"], min_gap=40, slice_seconds=width).collect()}
            assert got == fold_picks(rows, 40)
    finally:
        spark.conf.set(size, before)


@pytest.mark.parametrize("width", [7, 60, 100000])
@pytest.mark.parametrize("gap", [5, 60])
def test_spaced_picks_equal_the_greedy_fold(spark, width, gap):
    rows = skewed(3)
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint")
    got = {r["i"]: r["picked"] for r in spaced_picks(df, ["k"], "t", ["i"], min_gap=gap, slice_seconds=width).collect()}
    assert got == fold_picks(rows, gap)


@pytest.mark.parametrize("width", [10, 300])
def test_running_and_previous(spark, width):
    rnd = random.Random(5)
    rows = [(k, t, i, rnd.choice([None, rnd.randrange(50)])) for k, t, i in skewed(4, 300)]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, v bigint")
    s = time_slice(F.col("t"), width)
    run = ordered.running(df, ["k"], s, ["t", "i"], {
        "total": ("sum", F.col("v")), "top": ("max", F.col("v")), "latest": ("last", F.col("v"))})
    prev = ordered.previous(df, ["k"], s, ["t", "i"], F.col("v"), ["p1", "p2"])
    got_run = {r["i"]: (r["total"], r["top"], r["latest"]) for r in run.collect()}
    got_prev = {r["i"]: (r["p1"], r["p2"]) for r in prev.collect()}
    seen = {}
    for k, t, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        past = seen.setdefault(k, [])
        assert got_prev[i] == (past[-1] if past else None, past[-2] if len(past) > 1 else None)
        past.append(v)
        known = [x for x in past if x is not None]
        assert got_run[i] == (sum(known) if known else None, max(known, default=None), known[-1] if known else None)


@pytest.mark.parametrize("width", [10, 300])
def test_failure_runs_and_fires(spark, width):
    rnd = random.Random(6)
    rows = [(k, t, i, rnd.random() < 0.9) for k, t, i in skewed(7, 500)]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, bad boolean")
    got = {r["i"]: r["losecount"] for r in health.failure_runs(df, "k", "t", ["i"], F.col("bad"), width).collect()}
    acted = {r["i"]: r["acted"] for r in health.failure_fires(
        df, "k", "t", ["i"], F.col("bad"), n=5, suppress_secs=100, slice_seconds=width).collect()}
    run, count, last, want = {}, {}, {}, {}
    for k, t, i, bad in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        run[k] = run.get(k, 0) + 1 if bad else 0
        assert got[i] == run[k]
        count[k] = count.get(k, 0) + 1 if bad else 0
        if count[k] == 5:
            want[i] = k not in last or t > last[k] + 100
            last[k] = t if want[i] else last[k]
            count[k] = 0
    assert acted == want


def test_collapse_repeats_and_top_k(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([1, 1, None, None, 2, 1, 1])], "k string, t bigint, v int")
    kept = ordered.collapse_repeats(df, ["k"], time_slice(F.col("t"), 2), ["t"], "v").collect()
    assert sorted(r["t"] for r in kept) == [0, 2, 4, 5]
    assert {r["t"] for r in ordered.top_k(df, ["k"], [F.desc("t")], 2).collect()} == {5, 6}


def test_service_wait(spark):
    df = spark.createDataFrame([("h", 0, 100, 9), ("h", 10, 120, 5), ("h", 20, 120, 5), ("h", 20, 90, 5)], "host string, epoch bigint, requests bigint, queued bigint")
    waits = [r["est_wait"] for r in health.service_wait(df, ties=["requests"]).orderBy("epoch", "requests").collect()]
    assert waits == [0, 2, 0, 0]  # first sample, 5 / 2 rounded to even, falling counter, no time passed


def test_null_keys_are_sliced_like_others(spark):
    """A third of the keys is null; every (key, slice) stays within its width, and null rows follow each other like others."""
    rows = [(None if i % 3 == 0 else "a", i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint")
    sliced = with_slice(df, ["k"], time_slice(F.col("t"), 100))
    assert max(r["count"] for r in sliced.groupBy(KEY, SLICE).count().collect()) <= 100
    got = {r["i"]: (r["rn"], r["before"]) for r in previous(
        row_numbers(df, ["k"], time_slice(F.col("t"), 100), ["t"]), ["k"], time_slice(F.col("t"), 100), ["t"], F.col("i"), ["before"]).collect()}
    seen: dict = {}
    for k, _, i in rows:
        n, last = seen.get(k, (0, None))
        assert got[i] == (n + 1, last)
        seen[k] = (n + 1, i)
