"""Helpers shared by the operators: work folders, Arrow batches of texts, vectorised words and hashes.

Words and their 64-bit hashes are computed with numpy over the UTF-8 bytes of many texts at once, in slices of
bounded size, so that a task's memory does not depend on its row count. A single text is never cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``).

    A local session without the setting uses its warehouse folder, which it shares with itself.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir")
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Spark's setting that drops the shuffle files of a query when it ends, not when the driver's heap is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, and leaves no shuffle files."""
    spark = df.sparkSession
    path, before = work_dir(spark, label), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_table(*spans: tuple[int, int]) -> np.ndarray:
    """A boolean table over byte values, true inside the given inclusive spans."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in spans:
        out[lo : hi + 1] = True
    return out


#: Bytes of words cut at white space (0x20, 0x09 to 0x0D).
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words of letters and digits; everything outside ASCII counts as a letter.
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def texts_of(column: pa.Array) -> pa.Array:
    """Texts with nulls as empty ones."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a large_string array."""
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(offs) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Record batches cut so that the texts of a slice have about ``limit`` bytes (or are one long text)."""
    for batch in batches:
        texts = texts_of(batch.column(batch.schema.get_field_index(column)))
        _, offs = raw(texts)
        at, n = 0, len(texts)
        while at < n:
            to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to


_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + _C[0]
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


_BASE = 0x5851F42D4C957F2D
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            full = np.full(size, base, dtype=np.uint64)
            full[0] = 1
            _POWERS[k] = np.multiply.accumulate(full)
    return _POWERS[0][:n], _POWERS[1][:n]


class Words:
    """The words of a slice of texts: ``start`` and ``end`` (bytes), ``hash``, and ``lo``/``hi``, the word range of each text."""

    def __init__(self, texts: pa.Array, kept: np.ndarray, lower: bool = True, hashes: bool = True):
        data, offs = raw(texts)
        self.data = data = LOWER[data] if lower else data
        self.offs = offs
        inside = kept[data]
        edge = np.zeros(len(data) + 1, dtype=np.int8)
        edge[:-1] = inside
        edge[1:] -= inside
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cut = offs[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        cut = np.unique(cut[inside[cut] & inside[cut - 1]])
        if len(cut):
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        self.start, self.end = start, end
        bound = np.searchsorted(start, offs)
        self.lo, self.hi = bound[:-1], bound[1:]
        if hashes:
            powers, inverse = _powers(len(data) + 1)
            total = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data] * powers[:-1], out=total[1:])
            self.hash = mix((total[end] - total[start]) * inverse[start])
            self.total, self.inverse = total, inverse

    def prefix(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each longer word, 0 for others."""
        end = np.minimum(self.end, self.start + size)
        own = mix(((self.total[end] - self.total[self.start]) * self.inverse[self.start]) ^ np.uint64(size << 56))
        return np.where(self.end - self.start > size, own, np.uint64(0))

    def counts(self) -> np.ndarray:
        return self.hi - self.lo

    def doc_of(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.lo)), self.counts())


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes that ``Words`` gives to these words when each stands alone."""
    full = byte_table((0, 255))
    return np.array([Words(pa.array([w], pa.large_string()), full, lower=False).hash[0] if w else np.uint64(0) for w in words], dtype=np.uint64)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64))
    return mix(total)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)
