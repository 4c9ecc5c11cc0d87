"""Running streams over landed files, windowed streams, and streams that add to a stored table.

Streams that depend on the order of a key's rows are in ``eventtime``. A micro-batch is as large as the source's
``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` lets it be.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, scratch_path
from .eventtime import END, clocked


def read_landed(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
    max_files: int | None = None, max_bytes: str | None = None, glob: str | None = None, below: bool = False,
) -> DataFrame:
    """Files landing in a folder; each is read once, progress lives in the query's checkpoint.

    ``max_files`` or ``max_bytes`` pace the reading; with ``below``, files in folders below count as well.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if below:
        reader = reader.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


class Counted(NamedTuple):
    """A stream's stored result, the rows it dropped as late, the rows left in its state, and its micro-batches."""

    rows: DataFrame
    late: int
    state_rows: int
    batches: int


def run_counted(stream: DataFrame, label: str, mode: str = "append", timeout: int | None = None) -> Counted:
    """Process what has landed, stop, and return the result as a stored table, with what Spark counted.

    Result and checkpoint live in the shared folder. Append results go through the
    exactly-once file sink; complete results replace the table batch by batch. A run that
    does not end within ``timeout`` seconds is stopped and raises; no part of a result is returned.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(f"{base}/rows")
    else:
        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/rows")
        query = writer.outputMode(mode).foreachBatch(replace).start()
    seen: dict[int, dict] = {}  # Spark keeps the last hundred progress reports only
    waited = 0
    while True:
        ended = query.awaitTermination(1)
        seen |= {p["batchId"]: p for p in query.recentProgress}
        if ended:
            break
        waited += 1
        if timeout is not None and waited >= timeout:
            query.stop()
            raise TimeoutError(f"{label}: not everything that has landed was read within {timeout} seconds")
    states = [p["stateOperators"] for _, p in sorted(seen.items())]
    late = sum(o["numRowsDroppedByWatermark"] for own in states for o in own)
    left = sum(o["numRowsTotal"] for o in states[-1]) if states else 0
    return Counted(spark.read.schema(stream.schema).parquet(f"{base}/rows"), late, left, len(seen))


def run_available(stream: DataFrame, label: str, mode: str = "append", timeout: int | None = None) -> DataFrame:
    """``run_counted`` without the counts."""
    return run_counted(stream, label, mode, timeout).rows


def close(spark: SparkSession, path: str, schema: T.StructType, ts: str, fmt: str = "parquet") -> None:
    """Land a row that only moves the clock, so that everything before it leaves the streams' states.

    All its other columns are null: filter a stream before its watermark by nothing that such a row would fail.
    """
    end = F.lit(END).cast("timestamp") + F.expr("interval 1 day")
    only = [(end if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*only).coalesce(1).write.format(fmt).mode("append").save(path)


def land_batches(stream: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch to a folder of its own below ``path``; a batch that runs again replaces itself."""
    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(land).start()


def staged(stream: DataFrame, label: str, ts: str, max_files: int = 16) -> DataFrame:
    """What a first stateful step emits, as the stream that a second one reads: landed in a table between them, closed by a clock row.

    Its rows come in the order of the first step's watermark, but for the span of one of its micro-batches.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    land_batches(stream, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    close(spark, f"{path}/rows/end", stream.schema, ts)
    return read_landed(spark, f"{path}/rows", stream.schema, max_files=max_files, below=True)


def sampled_stream(
    df: DataFrame, ts: str, period: str, by: list[str], aggs: list[Column], lateness: str = "10 minutes",
) -> DataFrame:
    """Figures per clock-aligned sampling period, each once, when the watermark has passed it; its state is then released."""
    return clocked(df, ts, lateness).groupBy(F.window(ts, period), *by).agg(*aggs).select(
        F.col("window.start").alias("period_start"), *by, *[F.col(c) for c in _names(aggs, by, df)]
    )


def _names(aggs: list[Column], by: list[str], df: DataFrame) -> list[str]:
    static = df.sparkSession.createDataFrame([], df.schema)
    return [c for c in static.groupBy(*by).agg(*aggs).columns if c not in by]


def until(df: DataFrame, ts: str, deadline: Column) -> DataFrame:
    """Stop taking rows at the deadline."""
    return df.filter(F.col(ts) < deadline)


def _same(columns: list[str], a: DataFrame, b: DataFrame) -> Column:
    """Equality of rows of two frames in some columns, nulls being equal."""
    test = F.lit(True)
    for c in columns:
        test = test & a[c].eqNullSafe(b[c])
    return test


def distinct_lines(stream: DataFrame, keys: list[str], ts: str, path: str, checkpoint: str, keep_days: int | None = None):
    """Lines repeated by overlapping log chunks count once, however long after.

    Known lines are kept below ``path``/lines, a folder per day of ``ts``. A micro-batch is compared with the days it
    names only, as literals that prune the folders, and what is new is added; a batch that runs again finds its lines
    there. With ``keep_days``, days that far behind the newest may be deleted: lines of such days cannot be compared and
    go to ``path``/late instead, where they are counted and not lost. Rows without a time are a day of their own.
    """
    spark = stream.sparkSession
    lines, late, marks = f"{path}/lines", f"{path}/late", f"{path}/marks"

    def add(batch: DataFrame, number: int) -> None:
        rows = materialize(batch.dropDuplicates([*keys, ts]).withColumn("day", F.to_date(ts)), "lines")
        if keep_days is not None:
            newest = rows.agg(F.max("day").alias("day"))
            if _exists(spark, marks):
                newest = newest.union(spark.read.parquet(marks).select("day"))
            newest = newest.agg(F.max("day")).first()[0]
            spark.createDataFrame([(number, newest)], "batch bigint, day date").write.mode("append").parquet(marks)
            old = F.coalesce(F.col("day") < F.date_sub(F.lit(newest), keep_days), F.lit(False))
            rows.filter(old).drop("day").withColumn("batch", F.lit(number).cast("bigint")).write.partitionBy("batch").mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").parquet(late)
            rows = rows.filter(~old)
        if _exists(spark, lines):
            days = [r["day"] for r in rows.select("day").distinct().collect()]  # the days that one micro-batch spans
            known = spark.read.parquet(lines)
            named = F.col("day").isin([d for d in days if d is not None])
            known = known.filter(named | F.col("day").isNull() if None in days else named)
            rows = rows.join(known, _same([*keys, ts], rows, known), "left_anti")
        rows.write.partitionBy("day").mode("append").parquet(lines)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()


def copy_batches(stream: DataFrame, dest_path: str, pk: list[str], checkpoint: str):
    """Catch-up copy: each micro-batch appends the rows whose key the destination lacks.

    A replayed batch finds its rows already there, so the copy may be rerun freely. Of the destination only the batch's
    range of the first key column is read: smallest and largest value are literals of its scan, and it is stored in
    the order of the key.
    """
    spark = stream.sparkSession

    def append_new(batch: DataFrame, _: int) -> None:
        from ..operators.relayout import first_per_key, in_key_order

        fresh = first_per_key(batch, pk)
        if _exists(spark, dest_path):
            fresh = materialize(fresh, "copy-batch")
            span = fresh.agg(F.min(pk[0]).alias("lo"), F.max(pk[0]).alias("hi")).first()
            if span["lo"] is not None:
                held = spark.read.parquet(dest_path).filter(F.col(pk[0]).between(span["lo"], span["hi"]))
                fresh = fresh.join(held.select(*pk), pk, "left_anti")
        in_key_order(fresh, pk).write.mode("append").parquet(dest_path)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        append_new).start()


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return False
        raise
    return True
