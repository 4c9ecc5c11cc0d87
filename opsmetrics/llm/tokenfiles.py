"""Operator 3, token-id files: raw id payloads in shards, keyed access through a minimal perfect hash index.

**Payload.** Documents are put in ascending order of their key by range partitions; each task encodes its texts with a
tokenizers file and appends to one shard file: ids only, little-endian, two bytes each if the vocabulary fits, else
four. A text of well-known characters is cut where the tokenizer cuts it before it merges bytes (``pretokens``); the
distinct parts of a slice go through the tokenizer, many at a time, and are remembered up to a bounded number. Other texts (special tokens, letters
whose kind depends on the version of Unicode, other kinds of tokenizer) are encoded whole. Every attempt of a task writes
a file of its own name; only the rows of the attempt that Spark commits name it, so lost executors leave at most
unused files.

**Catalogue.** One row per document, written as Parquet: key, shard, width, offset (ids before it in the shard),
n_tokens, and ``start``, the ids of all documents before it: shards are summed up with one row each.

**Index.** Keys are dealt by hash to buckets of about ``BUCKET_KEYS``. Within a bucket, keys hash to small groups;
groups, largest first, get the smallest seed that sends their keys to free slots (hash and displace). A bucket is one
row: seeds, and for each slot a 32-bit fingerprint of its key, shard, offset and length; there are as many slots as
distinct keys. Access computes the slot from two hashes, compares the fingerprint and reads the range: constant time.

Null and empty texts are encoded as the end id alone. Repeated keys are separate documents with separate ranges, in
order of their text; the index finds the first of them. A row with a null key sorts first and has no index entry. Extra
columns are ignored; an empty table gives an empty catalogue and index.
"""

from __future__ import annotations

import binascii
import json
import posixpath
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix, slices, table, work_dir
from .pretokens import Parts, gathered
from .registry import query

BUCKET_KEYS, GROUP_KEYS = 20_000, 4
PIECES = 400_000  # distinct parts of texts that a worker remembers; beyond, it starts anew
END_ID = 2



@lru_cache(maxsize=1)
def unsafe() -> np.ndarray:
    """True for code points whose kind (letter, number, space) may depend on the version of Unicode."""
    out = np.ones(0x110000, dtype=bool)
    for lo, hi in ((9, 10), (13, 13), (0x20, 0x7E), (0xA1, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC)):
        out[lo : hi + 1] = False
    return out


class Encoder:
    """Encodes texts to packed ids with one tokenizers file."""

    def __init__(self, path: str, end: int | None = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 and (end or 0) < 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.end = b"" if end is None else np.array([end], self.kind).tobytes()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {}
        kind = json.loads(self.tokenizer.to_str())
        cutter = kind["pre_tokenizer"] or {}
        self.cuts = kind["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        self.break_id = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def pack_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts, many in one text: a line break always stands alone between them."""
        out: list[bytes] = [b""] * len(parts)
        plain = [k for k, p in enumerate(parts) if not p.isspace()]
        space = [k for k, p in enumerate(parts) if p.isspace()]
        for at in range(0, len(plain), 2048):
            some = plain[at : at + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(parts[k] for k in some)], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(ids == self.break_id[0]) if len(self.break_id) == 1 else []
            if len(cuts) != len(some) - 1:  # the vocabulary has no line break of its own
                space += some
                continue
            packed, w = ids.tobytes(), self.width
            edges = [-1, *cuts.tolist(), len(ids)]
            for k, x, y in zip(some, edges, edges[1:]):
                out[k] = packed[(x + 1) * w : y * w]
        for k, ids in zip(space, self.pack([parts[k] for k in space])):
            out[k] = ids
        return out

    def pack(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of each text, with the end id."""
        if not self.cuts:
            return [ids + self.end for ids in self.pack(texts.to_pylist())]
        parts = Parts(texts)
        whole = parts.holds(unsafe())
        for special in self.special:
            whole |= np.asarray(pa.compute.match_substring(texts, special))
        asked = np.ones(len(parts.distinct), dtype=bool)
        if whole.any():
            asked[:] = False
            asked[parts.of[np.repeat(~whole, parts.hi - parts.lo)]] = True
        wanted = np.flatnonzero(asked)
        names = parts.distinct if len(wanted) == len(parts.distinct) else [parts.distinct[k] for k in wanted.tolist()]
        if len(self.parts) > PIECES:
            self.parts.clear()
        packed = list(map(self.parts.get, names))
        new = [k for k, ids in enumerate(packed) if ids is None]
        fresh = [names[k] for k in new]
        for k, name, ids in zip(new, fresh, self.pack_parts(fresh)):
            packed[k] = self.parts[name] = ids
        size = np.zeros(len(parts.distinct), dtype=np.int64)
        size[wanted] = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        held, start = np.frombuffer(b"".join(packed), self.kind), np.zeros(len(size), dtype=np.int64)
        start[wanted] = np.cumsum(size[wanted]) - size[wanted]
        ids = gathered(held, start[parts.of], size[parts.of]).tobytes()
        upto = np.zeros(len(parts.of) + 1, dtype=np.int64)
        np.cumsum(size[parts.of] * self.width, out=upto[1:])
        out = [ids[x:y] + self.end for x, y in zip(upto[parts.lo].tolist(), upto[parts.hi].tolist())]
        rest = np.flatnonzero(whole).tolist()
        for k, own in zip(rest, self.pack([texts[k].as_py() for k in rest])):
            out[k] = own + self.end
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str, end: int | None) -> Encoder:
    """One encoder per worker process, so that its pieces outlive a task."""
    return Encoder(path, end)


CATALOGUE = "doc_id bigint, shard string, width int, offset bigint, n_tokens bigint"


def write(docs: DataFrame, tokenizer: str, path: str, end: int | None = END_ID) -> DataFrame:
    """Write ``docs (doc_id, text)`` as shards and a catalogue below ``path``; returns the catalogue, read back."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        encoder, files, folder = encoder_of(tokenizer, end), *pafs.FileSystem.from_uri(f"{path}/shards" if "://" in path else f"file://{path}/shards")
        files.create_dir(folder, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.ids", 0, None
        for part, texts in slices(batches):
            if out is None:
                out = files.open_output_stream(posixpath.join(folder, name))
            payload = encoder.encode(texts)
            sizes = np.array([len(p) // encoder.width for p in payload], dtype=np.int64)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            out.write(b"".join(payload))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([name] * len(sizes)), pa.array(np.full(len(sizes), encoder.width, np.int32)), pa.array(starts), pa.array(sizes)],
                names=["doc_id", "shard", "width", "offset", "n_tokens"])
        if out is not None:
            out.close()

    ordered.mapInArrow(run, CATALOGUE).write.parquet(f"{path}/ranges")
    ranges = spark.read.schema(CATALOGUE).parquet(f"{path}/ranges")
    # one row per shard: its first key and its ids; equal first keys cannot be in two shards of a range partitioning
    shards = ranges.groupBy("shard").agg(F.min("doc_id").alias("low"), F.sum("n_tokens").alias("ids"), F.count("doc_id").alias("keys"))
    before = W.orderBy(F.col("keys") > 0, "low", "shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    ranges.join(shards, "shard").select("doc_id", "shard", "width", "offset", "n_tokens", (F.col("base") + F.col("offset")).alias("start")).write.parquet(f"{path}/catalogue")
    return catalogue(spark, path)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOGUE + ", start bigint").parquet(f"{path}/catalogue")


def _hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = mix(keys.astype(np.int64).view(np.uint64))
    return a, mix(a ^ np.uint64(0x6C62272E07BB0142))


def _slot(b: np.ndarray, seed, n: int) -> np.ndarray:
    return (mix(b + np.uint64(0x9E3779B97F4A7C15) * np.asarray(seed, dtype=np.uint64)) % np.uint64(n)).astype(np.int64)


def displace(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed of each group, slot of each key) of a minimal perfect hash of distinct keys."""
    n = len(keys)
    groups = max(1, n // GROUP_KEYS)
    a, b = _hashes(keys)
    group = (a % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    edge = np.searchsorted(group[order], np.arange(groups + 1))
    seeds, slots, free = np.zeros(groups, np.int32), np.zeros(n, np.int64), np.ones(n, bool)
    tries = np.arange(64, dtype=np.uint64)
    for g in np.argsort(np.diff(edge), kind="stable")[::-1]:
        own = order[edge[g] : edge[g + 1]]
        if len(own) == 0:
            break
        base = 0
        while True:
            at = _slot(b[own][:, None], tries[None, :] + np.uint64(base), n)
            fit = free[at].all(axis=0)
            if len(own) > 1:
                fit &= (np.diff(np.sort(at, axis=0), axis=0) != 0).all(axis=0)
            if fit.any():
                k = int(fit.argmax())
                seeds[g], slots[own] = base + k, at[:, k]
                free[at[:, k]] = False
                break
            base += len(tries)
    return seeds, slots


INDEX = "bucket bigint, n bigint, seeds array<int>, prints array<bigint>, shards array<string>, width int, shard array<int>, offset array<bigint>, n_tokens array<bigint>"


def bucket_of(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def build_index(ranges: DataFrame, path: str) -> int:
    """Write the index of a catalogue; returns the number of buckets, which access needs to know."""
    buckets = max(1, -(-ranges.count() // BUCKET_KEYS))
    first = (
        ranges.where("doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.min(F.struct("start", "shard", "width", "offset", "n_tokens")).alias("r")).select("doc_id", "r.*")
        .withColumn("bucket", bucket_of("doc_id", buckets)))

    def run(key, rows):
        keys = rows["doc_id"].to_numpy()
        seeds, slots = displace(keys)
        at = np.argsort(slots)
        names, shard = np.unique(rows["shard"].to_numpy().astype(str), return_inverse=True)
        prints = (_hashes(keys)[1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        values = [[int(key[0])], [len(keys)], [seeds.tolist()], [prints[at].tolist()], [names.tolist()], [int(rows["width"].iloc[0])], [shard[at].tolist()],
                  [rows["offset"].to_numpy()[at].tolist()], [rows["n_tokens"].to_numpy()[at].tolist()]]
        import pandas as pd

        return pd.DataFrame(dict(zip(("bucket", "n", "seeds", "prints", "shards", "width", "shard", "offset", "n_tokens"), values)))

    first.groupBy("bucket").applyInPandas(run, INDEX).write.parquet(f"{path}/index")
    return buckets


def lookup(keys: DataFrame, path: str, buckets: int) -> DataFrame:
    """(doc_id, shard, width, offset, n_tokens) of the keys found in the index; unknown and null keys give no row."""
    spark = keys.sparkSession
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    asked = keys.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("bucket", bucket_of("doc_id", buckets))

    def run(key, asked, held):
        import pandas as pd

        ids = asked["doc_id"].to_numpy()
        if len(held) == 0 or len(ids) == 0:
            return pd.DataFrame({"doc_id": [], "shard": [], "width": [], "offset": [], "n_tokens": []})
        row = held.iloc[0]
        a, b = _hashes(ids)
        seeds = np.asarray(row["seeds"])
        at = _slot(b, seeds[(a % np.uint64(len(seeds))).astype(np.int64)], int(row["n"]))
        good = np.asarray(row["prints"])[at] == (b & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = at[good]
        return pd.DataFrame({
            "doc_id": ids[good], "shard": np.asarray(row["shards"], dtype=object)[np.asarray(row["shard"])[at]], "width": int(row["width"]),
            "offset": np.asarray(row["offset"])[at], "n_tokens": np.asarray(row["n_tokens"])[at]})

    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(run, CATALOGUE)


def read(ranges: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """``ranges`` with the payload: ``ids`` (if asked for) and ``ids_crc32``, the crc32 of all ids as unsigned 32-bit integers."""
    near = ranges.repartition("shard", F.floor(F.col("offset") / (1 << 22))).sortWithinPartitions("shard", "offset")
    names = near.columns
    kinds = [*(f"{n} {t}" for n, t in near.dtypes), *(["ids array<int>"] if ids else []), "ids_crc32 bigint"]

    def run(batches):
        files, folder = pafs.FileSystem.from_uri(f"{path}/shards" if "://" in path else f"file://{path}/shards")
        name, held = None, None
        for batch in batches:
            rows, crcs = [], []
            column = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("shard", "width", "offset", "n_tokens")}
            for shard, width, offset, n in zip(*column.values()):
                if shard != name:
                    if held is not None:
                        held.close()
                    name, held = shard, files.open_input_file(posixpath.join(folder, shard))
                got = np.frombuffer(held.read_at(n * width, offset * width), dtype=f"<u{width}")
                if len(got) != n:
                    raise OSError(f"{shard} ends before {offset + n} ids")
                crcs.append(binascii.crc32(got.astype("<u4").tobytes()))
                rows.append(got.astype(np.int32) if ids else None)
            more = [pa.array(rows, pa.list_(pa.int32()))] if ids else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, pa.array(crcs, pa.int64())], names=[*names, *(["ids"] if ids else []), "ids_crc32"])
        if held is not None:
            held.close()

    return near.mapInArrow(run, ", ".join(kinds))


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, write, index; then look every key up in the index and read its ids where the index says. Rows the index does not hold (repeats, null ids) are read by catalogue; a key that it should hold and does not is an error."""
    import public_tokenizers

    path = work_dir(spark, "token-files")
    ranges = write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    buckets = build_index(ranges, path)
    found = lookup(ranges.select("doc_id"), path, buckets)
    first = ranges.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("start").alias("start"))
    lost = F.raise_error(F.concat(F.lit("the index does not hold key "), F.col("doc_id").cast("string")))
    keyed = first.join(found, "doc_id", "left").select(
        "doc_id", "start", F.when(F.col("shard").isNull(), lost.cast("string")).otherwise(F.col("shard")).alias("shard"), "width", "offset", "n_tokens", F.lit(True).alias("keyed"))
    # each row has at least the end id, so no two rows start at the same place
    rest = ranges.join(first.select("start"), "start", "left_anti").select("doc_id", "start", "shard", "width", "offset", "n_tokens", F.lit(False).alias("keyed"))
    return read(keyed.union(rest), path, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32", "keyed")
