"""Range-partitioned tables: bounds, high-water marks, incremental copy, export and publish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

OPEN_PART = "PARTMAX"  # fixed value: name of the open-ended last partition


def catalog_partitions(catalog: DataFrame) -> DataFrame:
    """One row per (table, part) of a catalog that lists sub-partitions: largest row count, numeric limit."""
    return catalog.groupBy("table", "part").agg(
        F.max("table_rows").alias("table_rows"),
        F.max(F.col("limit").cast("string").try_cast("bigint")).alias("limit"),
    )


def partition_bounds(catalog: DataFrame) -> DataFrame:
    """Half-open ranges ``lo <= key < hi``; the open partition has a null ``hi``, the first a ``lo`` of 0."""
    w = Window.partitionBy("table").orderBy(F.col("limit").asc_nulls_last())
    parts = catalog.select(
        "table", "part", F.col("limit").cast("string").try_cast("bigint").alias("limit")
    ).distinct()
    return parts.select(
        "table", "part", F.lag("limit", 1, 0).over(w).alias("lo"), F.col("limit").alias("hi")
    )


def bounds_text(key: str, lo: Column | str = "lo", hi: Column | str = "hi") -> Column:
    """The range as a predicate string."""
    low = F.concat(F.lit(f"{key} >= "), F.col(lo) if isinstance(lo, str) else lo)
    high = F.col(hi) if isinstance(hi, str) else hi
    return F.concat(low, F.coalesce(F.concat(F.lit(f" and {key} < "), high), F.lit("")))


def in_partition(key: Column | str, lo: int, hi: int | None) -> Column:
    """Filter for one partition; pushes down to the scan."""
    k = F.col(key) if isinstance(key, str) else key
    return (k >= lo) if hi is None else (k >= lo) & (k < hi)


def assign_partition(
    df: DataFrame, bounds: DataFrame, key: str, on: list[str] = (), bin_width: int = 1440, outside: bool = False,
) -> DataFrame:
    """Give each row the partition whose range holds its key; with ``outside``, rows in no range stay, with a null part.

    Both sides are cut into bins of ``bin_width`` and joined on (``on``, bin), a
    hash join; the range test then settles rows in bins two partitions share.
    The outermost bins stand for everything below the lowest limit and from the
    highest start on, so an open range needs one bin only. Pass ``bounds`` as a
    stored table: Catalyst then knows its size and decides on broadcasting.
    """
    def bin_of(c: Column) -> Column:
        return F.floor(c / F.lit(bin_width)).cast("bigint")
    low, top = bin_of(F.coalesce(F.min("hi"), F.max("lo"))), bin_of(F.max("lo"))
    edge = bounds.agg(F.struct(low.alias("low"), F.greatest(low, top).alias("top"))).scalar()
    def clamp(b: Column) -> Column:
        return F.least(F.greatest(b, edge["low"]), edge["top"])
    last_bin = F.when(F.col("hi").isNull(), edge["top"]).otherwise(clamp(bin_of(F.col("hi") - 1)))
    mine = {c: f"__on_{c}" for c in on}
    ranges = bounds.select(
        *(F.col(c).alias(n) for c, n in mine.items()), "part", "lo", "hi", clamp(bin_of(F.col("lo"))).alias("__from"), last_bin.alias("__to")).select(
        *mine.values(), "part", "lo", "hi", F.explode(F.sequence("__from", F.greatest("__to", "__from"))).alias("__its"))
    keyed = df.withColumn("__bin", F.when(F.col(key).isNotNull(), clamp(bin_of(F.col(key)))))
    inside = (F.col("__bin") == F.col("__its")) & (F.col(key) >= F.col("lo")) & (F.col("hi").isNull() | (F.col(key) < F.col("hi")))
    for c, n in mine.items():
        inside = inside & (F.col(c) == F.col(n))
    return keyed.join(ranges, inside, "left" if outside else "inner").drop("__bin", "__its", "lo", "hi", *mine.values())


def high_water(df: DataFrame, bounds: DataFrame, key: str = "ts_min", on: list[str] = ()) -> DataFrame:
    """Largest key per partition, 0 for a partition without rows.

    Rows are first reduced to the different keys of each task and then of all; only these meet the ranges.
    """
    keys = df.select(*on, key).distinct()
    top = assign_partition(keys, bounds, key, on).groupBy(*on, "part").agg(F.max(key).alias("max_ts"))
    return bounds.select(*on, "part").join(top, [*on, "part"], "left").fillna(0, ["max_ts"])


def copy_report(
    src: DataFrame, dest: DataFrame, bounds: DataFrame, key: str = "ts_min", on: list[str] = (),
) -> DataFrame:
    """Source and destination high-water marks side by side, newest partition first."""
    s = high_water(src, bounds, key, on).withColumnRenamed("max_ts", "src_max")
    d = high_water(dest, bounds, key, on).withColumnRenamed("max_ts", "dest_max")
    return (
        s.join(d, [*on, "part"], "left").fillna(0, ["dest_max"])
        .join(bounds, [*on, "part"])
        .select(*on, "part", "src_max", "dest_max", (F.col("src_max") - F.col("dest_max")).alias("behind"),
                bounds_text(key).alias("range"))
        .orderBy(F.desc("part"))
    )


def format_partition_report(report: DataFrame) -> DataFrame:
    return report.select(
        F.format_string("%-11s %8d %8d %8d %s", "part", "src_max", "dest_max", "behind", "range").alias("value")
    )


def parts_to_copy(report: DataFrame) -> DataFrame:
    """Closed partitions whose source runs ahead of the destination."""
    return report.filter((F.col("part") != OPEN_PART) & (F.col("src_max") > F.col("dest_max")))


def first_per_key(df: DataFrame, pk: list[str]) -> DataFrame:
    """One row per primary key: the smallest by its other columns, so reruns agree."""
    rest = [c for c in df.columns if c not in pk]
    if not rest:
        return df.distinct()
    return df.groupBy(*pk).agg(F.min(F.struct(*rest)).alias("__row")).select(
        *pk, *[F.col(f"__row.{c}").alias(c) for c in rest]
    )


RANGES = 100  # literal ranges a scan is asked for; more of them are asked for as one, from the lowest to the highest


def literal_ranges(parts: DataFrame, bounds: DataFrame, key: str, on: list[str] = ()) -> Column:
    """A predicate of literals that holds for the rows of ``parts``, for scans to prune by; false if there are no parts.

    Neighbouring ranges are joined. Tables of ``on`` share the ranges: the predicate only has to let all wanted rows pass.
    """
    wanted = bounds.join(parts.select(*on, "part"), [*on, "part"]).select("lo", "hi").distinct()
    joined: list[list] = []
    for lo, hi in sorted(((r["lo"], r["hi"]) for r in wanted.collect()), key=lambda r: r[0]):  # at most one row per partition
        if joined and (joined[-1][1] is None or lo <= joined[-1][1]):
            joined[-1][1] = None if hi is None or joined[-1][1] is None else max(hi, joined[-1][1])
        else:
            joined.append([lo, hi])
    if len(joined) > RANGES:
        joined = [[joined[0][0], None if any(hi is None for _, hi in joined) else max(hi for _, hi in joined)]]
    out = F.lit(False)
    for k, (lo, hi) in enumerate(joined):
        out = in_partition(key, lo, hi) if k == 0 else out | in_partition(key, lo, hi)
    return out


def copy_new_rows(
    src: DataFrame, dest: DataFrame, bounds: DataFrame, pk: list[str], key: str = "ts_min",
    on: list[str] = (), fill_holes: bool = False, unique_source: bool = False, pk_fixes_range: bool | None = None,
) -> DataFrame:
    """Source rows whose primary key the destination lacks.

    By default only partitions whose source high-water mark is ahead are looked
    at, so holes below the mark stay; ``fill_holes`` checks every closed
    partition. ``unique_source`` skips removing duplicate keys of the source.

    The ranges of the partitions looked at are literals of the source's scan, and of the destination's too where equal
    primary keys have equal range keys (``pk_fixes_range``; it is so if the range key is part of the primary key). The
    marks decide on a partition as a whole, since rows below a mark may be missing there as well.
    """
    if pk_fixes_range is None:
        pk_fixes_range = key in pk
    if fill_holes:
        parts = bounds.filter(F.col("part") != OPEN_PART).select(*on, "part")
    else:
        # Stored, so that its size is known and the source need not be shuffled to meet a short list.
        parts = materialize(parts_to_copy(copy_report(src, dest, bounds, key, on)).select(*on, "part"), "ahead")
    near = literal_ranges(parts, bounds, key, on)
    wanted = assign_partition(src.filter(near), bounds, key, on).join(parts, [*on, "part"], "left_semi")
    rows = wanted.select(*src.columns)
    rows = rows if unique_source else first_per_key(rows, pk)
    return rows.join((dest.filter(near) if pk_fixes_range else dest).select(*pk), pk, "left_anti")


def in_key_order(df: DataFrame, pk: list[str], partitions: int | None = None) -> DataFrame:
    """Range-partitioned and sorted by the new key, ready to write."""
    ranged = df.repartitionByRange(partitions, *pk) if partitions else df.repartitionByRange(*pk)
    return ranged.sortWithinPartitions(*pk)


def partition_diff(src_catalog: DataFrame, dest_catalog: DataFrame, on: list[str] = ()) -> DataFrame:
    """Partitions to drop from and to add to the destination, adds with their limit."""
    s = src_catalog.select(*on, "part", "limit").distinct()
    d = dest_catalog.select(*on, "part", "limit").distinct()
    key = [*on, "part"]
    drop = d.join(s, key, "left_anti").select(
        *key, F.lit("drop").alias("action"), F.lit(None).cast("bigint").alias("limit"))
    add = s.join(d, key, "left_anti").select(*key, F.lit("add").alias("action"), F.col("limit").cast("bigint"))
    return drop.unionByName(add)


def bound_mismatches(src_bounds: DataFrame, dest_bounds: DataFrame, on: list[str] = ()) -> DataFrame:
    """Partitions of both sides whose numeric ranges differ."""
    d = dest_bounds.select(*on, "part", F.col("lo").alias("dest_lo"), F.col("hi").alias("dest_hi"))
    return (
        src_bounds.select(*on, "part", "lo", "hi").join(d, [*on, "part"])
        .filter(~F.col("lo").eqNullSafe(F.col("dest_lo")) | ~F.col("hi").eqNullSafe(F.col("dest_hi")))
    )


def relayout_status(report: DataFrame, tables: DataFrame) -> DataFrame:
    """Progress line per table.

    ``report`` has (table, part, src_max, dest_max); ``tables`` has (table,
    key_is_new, dest_exists, old_exists). ``done`` counts partitions with equal marks.
    """
    counts = report.groupBy("table").agg(
        F.count_if(F.col("src_max") == F.col("dest_max")).alias("done"), F.count("*").alias("total")
    )
    status = (
        F.when(F.col("key_is_new") & F.col("old_exists"), F.lit("done old exists"))
        .when(F.col("key_is_new"), F.lit("done"))
        .when(F.col("dest_exists"), F.format_string("working %d of %d", "done", "total"))
        .otherwise(F.format_string("original %d partitions", "total"))
    )
    return tables.join(counts, "table").select("table", status.alias("status"), "done", "total")


def key_columns(catalog: DataFrame, by: list[str] = ("table",)) -> DataFrame:
    """Key columns of each table in key order, quoted and comma-joined."""
    pairs = catalog.select(*by, F.struct("ordinal", "column").alias("c")).distinct()
    ordered = F.transform(F.sort_array(F.collect_list("c")), lambda x: F.concat(F.lit("`"), x["column"], F.lit("`")))
    return pairs.groupBy(*by).agg(F.array_join(ordered, ",").alias("key"))


def partition_names(catalog: DataFrame, by: list[str] = ("table",)) -> DataFrame:
    """Distinct partition names of each table as one list string."""
    names = F.transform(F.sort_array(F.collect_set("part")), lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return catalog.groupBy(*by).agg(F.concat(F.lit("("), F.array_join(names, ","), F.lit(")")).alias("parts"))


def interleaved(units: DataFrame, table: str, order: list[str], slice_expr: Column) -> DataFrame:
    """Work list that takes one unit of each table in turn: ``turn``, then name."""
    from .ordered import row_numbers

    return row_numbers(units, [table], slice_expr, order, "turn").orderBy("turn", table, *order)


def pending_batch(units: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The next ``n`` units to work on."""
    return units.orderBy(*order).limit(n)


def metadata_tables(tables: DataFrame, partitioned: DataFrame, ignore: DataFrame) -> DataFrame:
    """All tables that are neither partitioned nor ignored."""
    return tables.select("table").distinct().join(
        partitioned.select("table").unionByName(ignore.select("table")).distinct(), "table", "left_anti"
    )


def export_metadata_tables(spark: SparkSession, tables: DataFrame, source: str, path: str) -> list[str]:
    """Copy each of ``tables`` (see ``metadata_tables``) from below ``source`` to below ``path``; returns their names.

    The list is a catalog's table names. Each copy replaces an earlier one, so the export may be run again.
    """
    names = sorted(r["table"] for r in tables.select("table").distinct().collect())
    for name in names:
        spark.read.parquet(f"{source}/{name}").write.mode("overwrite").parquet(f"{path}/{name}")
    return names


def last_match(df: DataFrame, keys: list[str], order: list[str], matches: Column) -> DataFrame:
    """The last row of each key that matches, by order; keys without one have none. Combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.filter(matches).groupBy(*keys).agg(last).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def export_by_partition(df: DataFrame, bounds: DataFrame, key: str, pk: list[str], path: str, on: list[str] = ()) -> None:
    """Write each partition as its own folder, sorted by primary key; rows in no range are kept apart, see ``outside_ranges``.

    The rebalance hint lets AQE split a partition that outgrew the others into
    several files and merge small ones.
    """
    placed = assign_partition(df, bounds, key, on, outside=True).hint("rebalance", "part")
    placed.sortWithinPartitions("part", *pk).write.partitionBy("part").mode("overwrite").parquet(path)


def exported(spark: SparkSession, path: str) -> DataFrame:
    """The exported rows that lie in a partition."""
    return spark.read.parquet(path).filter(F.col("part").isNotNull())


def outside_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The exported rows whose key is null or lies in no partition's range: rejects of the export."""
    return spark.read.parquet(path).filter(F.col("part").isNull()).drop("part")


def import_partitions(df: DataFrame, path: str) -> None:
    """Replace exactly the partitions present in ``df`` (column ``part``); others stay. Safe to rerun."""
    df.hint("rebalance", "part").write.partitionBy("part").mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(path)


def swap_table(spark: SparkSession, table: str) -> None:
    """Publish ``fast_<table>`` under the table's name and keep the former one as ``old_<table>``."""
    spark.sql(f"ALTER TABLE {table} RENAME TO old_{table}")
    spark.sql(f"ALTER TABLE fast_{table} RENAME TO {table}")


def reclaim(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS old_{table}")
