"""Bounded training samples and held-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: str, folds: int) -> Column:
    """crc32 of an id written as text, modulo ``folds`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: Column, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` labelled rows of each class outside the held-out fold.

    The rows are those with the smallest hashes of their ids, so the sample does not depend on order or partitions; it
    is the whole training fold as long as that is small. A document with several labels counts with the largest.
    """
    rest = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    picked = None
    for y in (0, 1):
        some = rest.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.union(some)
    ids = picked.toPandas()
    small = docs.sparkSession.createDataFrame(ids.astype({"doc_id": "int64", "y": "int32"}) if len(ids) else [], "doc_id bigint, y int")
    return docs.select("doc_id", "text").where("doc_id IS NOT NULL").join(F.broadcast(small), "doc_id")
