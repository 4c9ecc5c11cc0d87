"""Counter rates, repeated failures, records, and keep-newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bursts import spaced_picks
from .ordered import previous, run_lengths, running, time_slice, top_k


def service_wait(
    samples: DataFrame, key: str = "host", epoch: str = "epoch", requests: str = "requests",
    queued: str = "queued", ties: list[str] = (), slice_seconds: int = 86400,
) -> DataFrame:
    """Requests per second since the previous sample, and the wait its queue implies.

    The wait is 0 for a first sample and whenever the rate is not positive;
    it is rounded half to even.
    """
    prior = previous(
        samples, [key], time_slice(F.col(epoch), slice_seconds), [epoch, *ties],
        F.struct(F.col(epoch).alias("e"), F.col(requests).alias("r")), ["__p"],
    )
    rate = F.try_divide((F.col(requests) - F.col("__p.r")).cast("double"), F.col(epoch) - F.col("__p.e"))
    return prior.withColumn("rate", rate).withColumn(
        "est_wait", F.when(F.col("rate") > 0, F.bround(F.col(queued) / F.col("rate")).cast("bigint")).otherwise(0)
    ).drop("__p")


def failure_runs(
    pings: DataFrame, key: str, epoch: str, ties: list[str], failed: Column, slice_seconds: int = 86400,
) -> DataFrame:
    """Consecutive failures up to and including each ping."""
    return run_lengths(
        pings, [key], time_slice(F.col(epoch), slice_seconds), [epoch, *ties], failed, "losecount"
    )


def failure_fires(
    pings: DataFrame, key: str, epoch: str, ties: list[str], failed: Column,
    n: int = 5, suppress_secs: int = 1800, slice_seconds: int = 86400,
) -> DataFrame:
    """Every ``n``-th failure of a run is a firing; it acts unless one acted within ``suppress_secs``.

    Suppressed firings restart the count as well, so firings depend on the run
    length alone and suppression works on them afterwards.
    """
    runs = failure_runs(pings, key, epoch, ties, failed, slice_seconds)
    # At most one ping in ``n``; stored once, because the suppression reads them twice.
    firings = materialize(runs.filter((F.col("losecount") > 0) & (F.col("losecount") % n == 0)), "firings")
    return spaced_picks(firings, [key], epoch, ties, "acted", suppress_secs, slice_seconds)


def new_high_water(
    jobs: DataFrame, keys: list[str], epoch: str, ties: list[str], duration: str, slice_seconds: int = 86400,
) -> DataFrame:
    """Rows that set a new longest duration; ``prior`` is the record before the row."""
    seen = running(
        jobs, keys, time_slice(F.col(epoch), slice_seconds), [epoch, *ties],
        {"prior": ("max", F.col(duration))}, before_current=True,
    )
    return seen.withColumn("is_record", F.col("prior").isNull() | (F.col(duration) > F.col("prior")))


def keep_newest(df: DataFrame, keys: list[str], order: list[Column], k: int = 5) -> DataFrame:
    return top_k(df, keys, order, k)
