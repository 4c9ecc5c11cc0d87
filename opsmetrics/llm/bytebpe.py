"""Operator 11, byte-level BPE encoding and decoding through a queue of merge ranks.

Texts are cut into parts (``pretokens``). A part that is a token of its own is that token. All other different parts of
a slice are laid out as one linked list of bytes, with gaps between parts, and merged together: each pair of neighbours
whose joined bytes are a token waits in the **bucket of its rank**; a **hierarchical bitmap** (each bit says whether one
of 64 below it is set) marks the buckets in use, and find-first-set steps down it to the lowest rank. A bucket's
positions are taken from left to right; an entry whose pair has changed since is stale and skipped. A merge renews the
two pairs beside it. If one of them has a lower rank, it goes first and the rest of the bucket waits. So merging costs a
constant number of steps for each byte of a part, however long it is, and gives what the library gives: always the lowest
rank, leftmost first.

Decoding gathers the bytes of all ids of a slice at once. Work is per row: no shuffle, and memory is that of a slice (about
one megabyte of text, or one long text). A worker remembers up to ``PARTS`` short parts, then starts anew.

Null and empty texts have no ids (an empty array) and decode to empty bytes. Repeated rows are encoded like others; an
empty table gives no rows. Extra columns are kept as they are; one that has the name of a result column is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table
from .pretokens import Parts, gathered
from .registry import query

PARTS = 400_000
LONG = 64  # characters of a part that is not remembered


class Ranks:
    """Buckets of positions by rank under a hierarchical bitmap."""

    def __init__(self, size: int):
        self.buckets: list[list[int] | None] = [None] * size
        self.levels: list[list[int]] = []
        while True:
            size = -(-size // 64)
            self.levels.append([0] * size)
            if size == 1:
                break

    def mark(self, rank: int) -> None:
        for level in self.levels:
            word, rank = rank >> 6, rank & 63
            held = level[word]
            level[word] = held | (1 << rank)
            if held:
                return
            rank = word

    def push(self, rank: int, position: int) -> None:
        held = self.buckets[rank]
        if held is None:
            self.buckets[rank] = [position]
            self.mark(rank)
        else:
            held.append(position)

    def first(self) -> int:
        """The lowest rank in use, -1 if there is none."""
        if not self.levels[-1][0]:
            return -1
        word = 0
        for level in reversed(self.levels):
            held = level[word]
            word = (word << 6) + (held & -held).bit_length() - 1
        return word

    def take(self, rank: int) -> list[int]:
        held = self.buckets[rank]
        self.buckets[rank] = None
        for level in self.levels:
            word = rank >> 6
            level[word] &= ~(1 << (rank & 63))
            if level[word]:
                break
            rank = word
        held.sort()
        return held


class Vocabulary:
    """Encodes and decodes by a file of base64 tokens and ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = max(self.rank.values()) + 1
        self.width = size.bit_length()
        #: rank of the token that two neighbouring tokens make together
        self.pair = {
            left << self.width | right: whole
            for token, whole in self.rank.items() for k in range(1, len(token))
            if (left := self.rank.get(token[:k])) is not None and (right := self.rank.get(token[k:])) is not None}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        codes = (self.single[:, None] << self.width | self.single[None, :]).ravel()
        self.first_pair = np.array([self.pair.get(c, -1) for c in codes.tolist()], dtype=np.int64)
        by_id = [b""] * size
        for token, rank in self.rank.items():
            by_id[rank] = token
        self.token_bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.token_size = np.array([len(t) for t in by_id], dtype=np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.queue = Ranks(size)
        self.known: dict[str, bytes] = {}

    def merged(self, parts: list[bytes]) -> list[bytes]:
        """Packed ids (unsigned 32-bit) of each part, merged from its bytes; empty parts have none."""
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(size)
        n = len(data)
        out = self.single[data]
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends[size > 0] - 1] = -1
        before[(ends - size)[size > 0]] = -1
        due = np.full(n, -1, dtype=np.int64)
        joined = following >= 0
        due[joined] = self.first_pair[data[joined].astype(np.int64) << 8 | data[following[joined]]]
        queue, buckets = self.queue, self.queue.buckets
        waiting = np.flatnonzero(due >= 0)
        waiting = waiting[np.argsort(due[waiting], kind="stable")]
        ranks, at = np.unique(due[waiting], return_index=True)
        places = waiting.tolist()
        for rank, lo, hi in zip(ranks.tolist(), at.tolist(), [*at[1:].tolist(), len(places)]):
            buckets[rank] = places[lo:hi]
            queue.mark(rank)

        ids, nxt, prv, due = out.tolist(), following.tolist(), before.tolist(), due.tolist()
        pair, width, push = self.pair.get, self.width, queue.push
        while (rank := queue.first()) >= 0:
            held = queue.take(rank)
            for k, i in enumerate(held):
                if due[i] != rank:
                    continue
                j = nxt[i]
                ids[i], ids[j], due[j] = rank, -1, -1
                right, left, lower = nxt[j], prv[i], False
                nxt[i] = right
                due[i] = -1
                if right >= 0:
                    prv[right] = i
                    new = pair(rank << width | ids[right], -1)
                    due[i] = new
                    if new >= 0:
                        push(new, i)
                        lower = new < rank
                if left >= 0:
                    new = pair(ids[left] << width | rank, -1)
                    due[left] = new
                    if new >= 0:
                        push(new, left)
                        lower = lower or new < rank
                if lower and k + 1 < len(held):
                    buckets[rank] = held[k + 1 :]
                    queue.mark(rank)
                    break
        done = np.array(ids, dtype=np.int64)
        alive = done >= 0
        upto = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(alive, out=upto[1:])
        packed = done[alive].astype("<u4").tobytes()
        return [packed[4 * x : 4 * y] for x, y in zip(upto[ends - size].tolist(), upto[ends].tolist())]

    def pack(self, parts: list[str]) -> list[bytes]:
        """Packed ids of parts of texts."""
        known, rank = self.known, self.rank
        if len(known) > PARTS:
            known.clear()
        out: list[bytes | None] = [known.get(p) for p in parts]
        new = [k for k, ids in enumerate(out) if ids is None]
        plain = [parts[k].encode() for k in new]
        alone = [rank.get(p) for p in plain]
        rest = iter(self.merged([p for p, a in zip(plain, alone) if a is None]))
        for k, a in zip(new, alone):
            ids = next(rest) if a is None else a.to_bytes(4, "little")
            out[k] = ids
            if len(parts[k]) <= LONG:
                known[parts[k]] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's ids)."""
        parts = Parts(texts)
        packed = self.pack(parts.distinct)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
        held = np.frombuffer(b"".join(packed), dtype="<u4")
        start = np.cumsum(size) - size
        ids = gathered(held, start[parts.of], size[parts.of])
        upto = np.zeros(len(parts.of) + 1, dtype=np.int64)
        np.cumsum(size[parts.of], out=upto[1:])
        return ids, np.append(upto[parts.lo], upto[parts.hi[-1:]])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all ids, bounds of each text's bytes)."""
        size = self.token_size[ids]
        upto = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(size, out=upto[1:])
        return gathered(self.token_bytes, self.token_start[ids], size).tobytes(), upto[bounds]


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process, so that its parts outlive a task."""
    return Vocabulary(path)


def _with(docs: DataFrame, column: str, added: dict[str, str], run) -> DataFrame:
    """``docs`` and the added columns, which ``run`` computes from batches; a column of an added name gives way."""
    taken = {n.lower() for n in added}
    if column.lower() in taken:
        raise ValueError(f"{column} is the name of a result")
    kept = docs.select(*(docs[n] for n in docs.columns if n.lower() not in taken))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"{n} {t}" for n, t in added.items())])
    names = [*kept.columns, *added]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, arrays in run(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    return kept.mapInArrow(rows, schema)


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>), the tokens of ``column`` by the ranks in ``path``."""
    def run(batches):
        for batch, texts in slices(batches, column):
            ids, bounds = vocabulary(path).encode(texts)
            yield batch, [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))]

    return _with(docs, column, {"ids": "array<int>"}, run)


def decode(rows: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``rows`` with ``decoded`` (binary), the bytes of the ids in ``column``; a null array counts as empty."""
    def run(batches):
        for batch in batches:
            for k in range(len(batch)):  # one text at a time: arrays of ids may be long
                row = batch.slice(k, 1)
                ids = row.column(row.schema.get_field_index(column)).flatten().to_numpy().astype(np.int64)
                data, _ = vocabulary(path).decode(ids, np.array([0, len(ids)]))
                yield row, [pa.array([data], pa.binary())]

    return _with(rows, column, {"decoded": "binary"}, run)


DIGESTS = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def digests(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """``docs`` encoded, decoded again, and both summed up: number of ids, their digest, the digest of the decoded bytes.

    The ids do not leave the task, so that a row stays small.
    """
    def run(batches):
        for batch, texts in slices(batches, column):
            ids, bounds = vocabulary(path).encode(texts)
            data, ends = vocabulary(path).decode(ids, bounds)
            packed = ids.astype("<u4").tobytes()
            of_ids = [hashlib.sha256(packed[4 * x : 4 * y]).hexdigest() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            of_data = [hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield batch, [pa.array(np.diff(bounds)), pa.array(of_ids, pa.string()), pa.array(of_data, pa.string())]

    return _with(docs, column, DIGESTS, run)


@query("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by the multilingual ranks and decoded again."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).drop("text")
