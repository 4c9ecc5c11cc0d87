"""Is ingest still growing? Rates per minute and the three saturation tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import previous, time_slice


def metrics_per_minute(df: DataFrame, keys: list[str] = (), ts_min: str = "ts_min") -> DataFrame:
    """Rows per minute: (keys, ts_min, rate)."""
    return df.groupBy(*keys, ts_min).agg(F.count("*").alias("rate"))


def rate_at(rates: DataFrame, now_min: int, minutes_back: int = 8) -> DataFrame:
    """The rate of one past minute; the newest minutes are left time to fill."""
    return rates.filter(F.col("ts_min") == now_min - minutes_back)


def saturated_by_samples(rates: DataFrame, keys: list[str] = (), slice_minutes: int = 1440) -> DataFrame:
    """Three samples in a row: neither of the two later ones exceeds the first.

    A missing earlier sample counts as a rate of 0.
    """
    keys = list(keys)
    out = previous(
        rates, keys, time_slice(F.col("ts_min"), slice_minutes), ["ts_min"], F.col("rate"), ["prev1", "prev2"]
    ).fillna(0, ["prev1", "prev2"])
    return out.withColumn(
        "saturated", (F.col("prev2") >= F.col("prev1")) & (F.col("prev2") >= F.col("rate"))
    )


def saturated_by_minutes(rates: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Three contiguous minutes: both later ones lie strictly below the first; an absent minute has rate 0.

    Each rate is handed to its own minute and the two after it, so one grouping
    on (keys, minute) replaces a time-ordered window.
    """
    keys = list(keys)
    spread = rates.select(
        *keys, "ts_min", "rate", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("o")
    ).withColumn("ts_min", F.col("ts_min") + F.col("o"))

    def at(o):
        return F.coalesce(F.max(F.when(F.col("o") == o, F.col("rate"))), F.lit(0))
    return (
        spread.groupBy(*keys, "ts_min")
        .agg(at(0).alias("rate"), at(1).alias("prev1"), at(2).alias("prev2"),
             F.max(F.col("o") == 0).alias("__here"))
        .filter("__here").drop("__here")
        .withColumn("saturated", (F.col("prev2") > F.col("prev1")) & (F.col("prev2") > F.col("rate")))
    )


def saturated_by_drops(
    df: DataFrame, keys: list[str] = (), value: str = "value", ts_min: str = "ts_min", minutes: int = 12,
) -> DataFrame:
    """Dropped-metric total over the last ``minutes``; any drop at all means saturation."""
    newest = df.agg(F.max(ts_min)).scalar()
    recent = F.col(ts_min) > newest - minutes
    return (
        df.groupBy(*keys)
        .agg(F.coalesce(F.sum(F.when(recent, F.col(value))), F.lit(0)).alias("dropped"))
        .withColumn("saturated", F.col("dropped") > 0)
    )


def nodes_needed(metrics: str, per_node: int, per_agent: int):
    """Simulated nodes and agents for a wanted metric load (both rounded up)."""
    from ..functions.text import ceil_div

    nodes = ceil_div(metrics, per_node)
    return nodes, ceil_div(nodes, per_agent)
