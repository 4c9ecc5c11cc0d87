"""Order-dependent operators that never put one key's whole history in one task.

A plain ``Window.partitionBy(host)`` sends every row of a host to one task, and
one host may own a third of all rows. Here each key is cut into slices (usually
of time) that follow the order: rows are windowed per (key, slice), and what an
earlier slice hands to a later one travels in a summary with a single row per
(key, slice). The summary is joined back on (key, slice), the partitioning the
detail rows already have. Narrower slices mean smaller tasks and more summary
rows; the result is the same for every width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICE = "__slice"
KEY = "__key"


def time_slice(epoch: Column, seconds: int) -> Column:
    return F.floor(epoch / F.lit(seconds)).cast("bigint")


def with_slice(df: DataFrame, keys: list[str], slice_expr: Column) -> DataFrame:
    """Add the slice and the key as a struct: structs with equal nulls are equal, so null keys are sliced and joined like others."""
    sliced = df.withColumn(SLICE, slice_expr)
    return sliced.withColumn(KEY, F.struct(*keys)) if keys else sliced


def key_of(keys: list[str]) -> list[str]:
    """The column that stands for the keys after ``with_slice``."""
    return [KEY] if keys else []


def _attach(detail: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    return detail.join(carry, [*key_of(keys), SLICE], "left")


def _before(keys: list[str]):
    return Window.partitionBy(*key_of(keys)).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def running(
    df: DataFrame, keys: list[str], slice_expr: Column, order: list[str],
    specs: dict[str, tuple[str, Column]], before_current: bool = False,
) -> DataFrame:
    """Running ``sum``, ``max``, ``min`` or ``last`` (nulls skipped) per key in order.

    ``specs`` maps output names to (kind, value). With ``before_current`` the
    current row is left out, and the first row of a key gets null.
    """
    sliced = with_slice(df, keys, slice_expr)
    for name, (_, value) in specs.items():
        sliced = sliced.withColumn(f"__v_{name}", value)
    w = Window.partitionBy(*key_of(keys), SLICE).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 if before_current else 0
    )
    plain = {"sum": F.sum, "max": F.max, "min": F.min}
    position = F.struct(*order)
    detail, totals = sliced, []
    for name, (kind, _) in specs.items():
        v = F.col(f"__v_{name}")
        if kind == "last":
            detail = detail.withColumn(name, F.last(v, ignorenulls=True).over(w))
            totals.append(F.max_by(v, F.when(v.isNotNull(), position)).alias(f"__c_{name}"))
        else:
            detail = detail.withColumn(name, plain[kind](v).over(w))
            totals.append(plain[kind](v).alias(f"__c_{name}"))
    carry = sliced.groupBy(*key_of(keys), SLICE).agg(*totals)
    for name, (kind, _) in specs.items():
        c = F.col(f"__c_{name}")
        prior = F.last(c, ignorenulls=True) if kind == "last" else plain[kind](c)
        carry = carry.withColumn(f"__c_{name}", prior.over(_before(keys)))
    joined = _attach(detail, carry, keys)
    for name, (kind, _) in specs.items():
        here, prior = F.col(name), F.col(f"__c_{name}")
        both = {
            "sum": F.coalesce(here + prior, here, prior),
            "max": F.greatest(here, prior),
            "min": F.least(here, prior),
            "last": F.coalesce(here, prior),
        }[kind]
        joined = joined.withColumn(name, both)
    return joined.drop(SLICE, KEY, *[f"__{x}_{n}" for n in specs for x in "vc"])


def row_numbers(df: DataFrame, keys: list[str], slice_expr: Column, order: list[str], out: str = "rn") -> DataFrame:
    """``row_number`` per key; ``slice_expr`` must not decrease along ``order``."""
    return running(df, keys, slice_expr, order, {out: ("sum", F.lit(1).cast("bigint"))})


def previous(
    df: DataFrame, keys: list[str], slice_expr: Column, order: list[str], value: Column, outs: list[str],
) -> DataFrame:
    """The 1st, 2nd, .. previous value per key, one output column each; null before the first row."""
    n = len(outs)
    w = Window.partitionBy(*key_of(keys), SLICE).orderBy(*order)
    # Values are boxed in structs: an absent row is null, a null value is not.
    boxed = with_slice(df, keys, slice_expr).withColumn("__v", F.struct(value.alias("x")))
    detail = boxed.withColumn("__rn", F.row_number().over(w)).withColumn("__end", F.lead(F.lit(1)).over(w).isNull())
    for i in range(1, n + 1):
        detail = detail.withColumn(f"__l{i}", F.lag("__v", i).over(w))
    last = [F.col("__v")] + [F.col(f"__l{i}") for i in range(1, n)]
    tails = detail.filter("__end").select(
        *key_of(keys), SLICE, F.filter(F.array(*last), lambda x: x.isNotNull()).alias("__tail")
    )
    by_slice = Window.partitionBy(*key_of(keys)).orderBy(SLICE)
    empty = F.slice("__tail", 1, 0)
    carry = tails.select(
        *key_of(keys), SLICE,
        F.slice(F.concat(*[F.coalesce(F.lag("__tail", i).over(by_slice), empty) for i in range(1, n + 1)]), 1, n)
        .alias("__carry"),
    )
    out = _attach(detail.drop("__end"), carry, keys)
    for i, name in enumerate(outs, start=1):
        at = F.lit(i) - F.col("__rn") + 1
        old = F.when(at > 0, F.try_element_at("__carry", F.greatest(at, F.lit(1))))
        out = out.withColumn(name, F.coalesce(F.col(f"__l{i}"), old)["x"])
    return out.drop(SLICE, KEY, "__v", "__rn", "__carry", *[f"__l{i}" for i in range(1, n + 1)])


def run_lengths(
    df: DataFrame, keys: list[str], slice_expr: Column, order: list[str], flag: Column, out: str = "run",
) -> DataFrame:
    """Length so far of the unbroken run of true flags ending at each row; 0 where the flag is false."""
    w = Window.partitionBy(*key_of(keys), SLICE).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    detail = (
        with_slice(df, keys, slice_expr)
        .withColumn("__f", F.coalesce(flag, F.lit(False)).cast("bigint"))
        .withColumn("__n", F.sum("__f").over(upto))
        .withColumn("__reset", F.last(F.when(F.col("__f") == 0, F.col("__n")), ignorenulls=True).over(upto))
        .withColumn("__end", F.lead(F.lit(1)).over(w).isNull())
    )
    tails = detail.filter("__end").select(
        *key_of(keys), SLICE,
        (F.col("__n") - F.coalesce("__reset", F.lit(0))).alias("__trail"),
        F.col("__reset").isNotNull().cast("int").alias("__broken"),
    )
    by_slice = Window.partitionBy(*key_of(keys)).orderBy(SLICE)
    carry = (
        tails.withColumn("__grp", F.sum("__broken").over(by_slice.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(
            "__open",
            F.sum("__trail").over(
                Window.partitionBy(*key_of(keys), "__grp").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .select(*key_of(keys), SLICE, F.lag("__open").over(by_slice).alias("__carry"))
    )
    length = F.when(F.col("__reset").isNotNull(), F.col("__n") - F.col("__reset")).otherwise(
        F.col("__n") + F.coalesce("__carry", F.lit(0))
    )
    return (
        _attach(detail.drop("__end"), carry, keys)
        .withColumn(out, length)
        .drop(SLICE, KEY, "__f", "__n", "__reset", "__carry")
    )


def collapse_repeats(
    df: DataFrame, keys: list[str], slice_expr: Column, order: list[str], value: str,
) -> DataFrame:
    """Keep a row only when its value differs from the row before it."""
    seen = previous(
        df.withColumn("__x", F.struct(F.col(value).alias("v"))), keys, slice_expr, order, F.col("__x"), ["__p"]
    )
    return seen.filter(F.col("__p").isNull() | ~F.col("__p").eqNullSafe(F.col("__x"))).drop("__x", "__p")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per key. Spark trims every map partition to ``k`` rows per key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rk", F.row_number().over(w)).filter(F.col("__rk") <= k).drop("__rk")
