"""Operator 1, SentencePiece encoding and decoding by a relational lattice.

A text is normalised as the model file says (spaces become the space mark, one in front) and cut into words before each
space mark that follows another character; no piece of the vocabulary crosses such a cut (checked when the file is
read), so words can be encoded on their own. **Lattice:** each word's substrings of up to the longest piece's length are
rows, an equi-join with the piece table keeps the edges (a single character without a piece is an edge of its bytes),
and edges are grouped by word. The piece table has a fixed size (the vocabulary) and is broadcast. **Fold:** by the kind
that the model file states. In a file of merges (BPE), a word starts as its characters, and the adjacent pair whose
piece has the best score is merged, the leftmost of equals, until no pair has a piece. In a unigram file, ``aggregate``
folds the edges in order of their ends: the best score of each position and the edge that gives it; ties go to the edge
that starts earlier; a second fold walks back. ``encode`` can be asked for either fold; the query and the pipeline take
the file's own.

The ``FREQUENT`` most frequent words of all texts are encoded once and sent to the tasks as a table of bounded size.
Other words are encoded where they are met, from the same pieces and by the same folds, whose edges are then looked up in
the piece table: a document is neither shuffled nor are its edges rows. The different words of a slice of texts are merged
together, as rows of a matrix of up to ``AT_ONCE`` words of up to ``SHORT`` characters; longer ones, and those with
characters that are no pieces, alone. No word or document is left out, and all ways give the same ids. Alone, a word of
n characters takes n log n steps to merge and n for the best path, and memory in proportion; only the best-path fold of
frequent words, which copies their positions per step, grows with the square of the length.

Scores are those of the file. Merges give the library's ids (the tests compare with it, unpatched). A maximum of their
sum is what the library computes from a unigram model with the same pieces, but in double precision: beside a run of spaces or an unknown character, which score -1e9, the library's
32-bit sums round other scores away. Null and empty texts have no ids. Repeated rows are encoded like others; a null id
stays null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import binascii
import heapq
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, raw, slices, stored, table
from .registry import query

MARK = "▁"
FREQUENT = 200_000
LOCAL = 400_000  # distinct words a task counts before it passes on those it met again
SHORT, AT_ONCE = 64, 16_384  # characters of a word that is merged together with others, and words merged together
NEVER = np.iinfo(np.int32).max
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6
UNIGRAM, BPE = 1, 2


_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[i]
        i += 1
        n |= (x & 127) << shift
        shift += 7
        if x < 128:
            return n, i


def _fields(b: bytes):
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            value, i = _varint(b, i)
        else:
            size, i = (_varint(b, i) if tag & 7 == 2 else (4 if tag & 7 == 5 else 8, i))
            value, i = b[i : i + size], i + size
        yield tag >> 3, value


class _Parts(dict):
    """Score, its sign changed, and ids of each piece; a character that is none has the ids of its bytes."""

    def __init__(self, model: Model):
        super().__init__((p, (-s, [k])) for p, k, s in model.table)
        self.model = model

    def __missing__(self, part: str) -> tuple[float, list[int]]:
        return -self.model.unknown, [self.model.bytes + x for x in part.encode()]


class Model:
    """Pieces, scores and kinds of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        self.prefix, kind = True, UNIGRAM
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif field == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                own = dict(_fields(value))
                if own.get(2) or own.get(4, 1):
                    raise ValueError("only models without a character map that keep white space are read")
                self.prefix = bool(own.get(3, 1))
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are read")
        self.merges = kind == BPE
        if self.merges and any(k in (USER_DEFINED, UNUSED) for _, _, k in self.pieces):
            raise ValueError("user-defined and unused pieces are merged by rules of their own, which are not built")
        self.table = [(p, k, s) for k, (p, s, kind) in enumerate(self.pieces) if kind == NORMAL]
        self.longest = max(len(p) for p, _, _ in self.table)
        self.unknown = min(s for _, _, s in self.table) - UNKNOWN_PENALTY
        self.bytes = next(k for k, (_, _, kind) in enumerate(self.pieces) if kind == BYTE)
        if any(MARK in p.lstrip(MARK) for p, _, _ in self.table):
            raise ValueError("a piece holds a space mark after another character")
        self.parts = _Parts(self)
        self.spelled = pa.array([bytes([k - self.bytes]) if kind == BYTE else p.encode() for k, (p, _, kind) in enumerate(self.pieces)], pa.large_binary())

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        # every mark belongs to the word behind it, runs of marks stay together
        return _WORD.findall(((" " if self.prefix else "") + text).replace(" ", MARK))

    def decode(self, ids) -> str:
        return next(self.texts(pa.array([ids], pa.list_(pa.int32()))))[0].as_py()

    def texts(self, rows: pa.Array) -> Iterator[pa.Array]:
        """The texts of lists of ids, null for null, a slice of about ``SLICE_BYTES`` ids (or one long list) at a time."""
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy()
        ids, ends, at = rows.flatten(), np.concatenate([[0], np.cumsum(sizes)]), 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
            data, offs = raw(self.spelled.take(ids.slice(ends[at], ends[to] - ends[at])))
            cuts = offs[ends[at : to + 1] - ends[at]].tolist()
            texts = [data[a:b].tobytes().decode(errors="replace").replace(MARK, " ") for a, b in zip(cuts, cuts[1:])]
            if self.prefix:
                texts = [t.removeprefix(" ") for t in texts]
            yield pa.array(texts, pa.string(), mask=rows.slice(at, to - at).is_null().to_numpy(False))
            at = to

@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def _best(edges: Column) -> Column:
    """Ids of the best path over edges (end, start, score, ids), sorted by end and start."""
    node = "struct<score:double,start:int,ids:array<int>>"
    zero = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("start"), F.array().cast("array<int>").alias("ids"))).cast(f"array<{node}>")

    def add(best: Column, e: Column) -> Column:
        mine = F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), e["start"].alias("start"), e["ids"].alias("ids"))
        return (
            F.when(F.size(best) <= e["end"], F.concat(best, F.array(mine)))
            .when(mine["score"] > F.element_at(best, -1)["score"], F.concat(F.slice(best, F.lit(1), F.size(best) - 1), F.array(mine)))
            .otherwise(best))

    best = F.aggregate(edges, zero, add)
    start = F.struct((F.size(best) - 1).alias("at"), F.array().cast("array<int>").alias("ids"))

    def back(held: Column, k: Column) -> Column:
        own = F.get(best, k)
        return F.when(k == held["at"], F.struct(own["start"].alias("at"), F.concat(own["ids"], held["ids"]).alias("ids"))).otherwise(held)

    return F.aggregate(F.sequence(F.size(best) - 1, F.lit(1), F.lit(-1)), start, back, lambda held: held["ids"])


def merged(word: str, held: Mapping[str, tuple[float, list[int]]]) -> list[int]:
    """Ids of a word by merge order: the best adjacent pair first, the leftmost of equals; ``held`` has the score with its sign changed and the ids of each part."""
    n, edge = len(word), held.get
    after, before = list(range(1, n + 1)), list(range(-1, n))  # the symbol at a place ends there; the symbol that ends at a place starts there
    pairs = [(found[0], s, s + 1, s + 2) for s in range(n - 1) if (found := edge(word[s : s + 2]))]
    heapq.heapify(pairs)
    while pairs:
        _, s, middle, e = heapq.heappop(pairs)
        if after[s] != middle or after[middle] != e:
            continue
        after[s], after[middle], before[e] = e, -1, s
        if s > 0 and (found := edge(word[before[s] : e])):
            heapq.heappush(pairs, (found[0], before[s], s, e))
        if e < n and (found := edge(word[s : after[e]])):
            heapq.heappush(pairs, (found[0], s, e, after[e]))
    out, at = [], 0
    while at < n:
        out += held[word[at : after[at]]][1]
        at = after[at]
    return out


def best_path(word: str, held: Mapping[str, tuple[float, list[int]]], longest: int) -> list[int]:
    """What ``_best`` gives for the edges of a word, from the table that ``merged`` reads."""
    scores, starts, edge = [0.0], [0], held.get
    for end in range(1, len(word) + 1):
        best = None
        for start in range(max(0, end - longest), end):
            found = edge(word[start:end]) or (held[word[start:end]] if end - start == 1 else None)
            if found and (best is None or scores[start] - found[0] > best[0]):
                best = scores[start] - found[0], start
        scores.append(best[0])
        starts.append(best[1])
    parts, at = [], len(word)
    while at:
        parts.append(held[word[starts[at] : at]][1])
        at = starts[at]
    return [k for ids in reversed(parts) for k in ids]


def _merged_column(words: pa.Array, edges: pa.Array) -> pa.Array:
    """``merged`` of each word and its list of edges (end, start, score, ids)."""
    offs = edges.offsets.to_numpy() - edges.offsets[0].as_py()
    flat = edges.flatten()
    ids = flat.field(3)
    at, own = ids.offsets.to_numpy().tolist(), ids.values.to_numpy().tolist()
    columns = [flat.field(k).to_numpy().tolist() for k in range(3)]
    rows = []
    for word, a, b in zip(words.to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
        parts = zip(*(c[a:b] for c in columns), at[a:b], at[a + 1 : b + 1])
        rows.append(merged(word, {word[start:end]: (-score, own[i:j]) for end, start, score, i, j in parts}))
    return pa.array(rows, pa.list_(pa.int32()))


class Merger:
    """``merged`` of many words at once: words are the rows of a matrix of symbols, and a step merges each row's best pair."""

    def __init__(self, model: Model):
        ids = {p: k for p, k, _ in model.table}
        self.model, self.none, self.width = model, len(model.pieces), len(model.pieces).bit_length()
        self.of = np.full(0x110000, -1, np.int32)
        for p, k in ids.items():
            if len(p) == 1:
                self.of[ord(p)] = k
        ranks = np.unique([-s for _, _, s in model.table], return_inverse=True)[1]
        self.rank = np.full(self.none + 1, NEVER, np.int32)  # the last one, for no pair, is found as -1 too
        self.rank[[k for _, k, _ in model.table]] = ranks
        # pairs of symbols that are a piece together, in a hash table
        pairs = {ids[p[:k]] << self.width | ids[p[k:]]: whole for p, whole in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        codes, wholes = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(1, len(pairs)).bit_length() + 2
        self.codes, self.wholes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slots, left = self._slots(codes), np.arange(len(codes))
        while len(left):
            free = left[self.codes[slots[left]] < 0]
            self.codes[slots[free]], self.wholes[slots[free]] = codes[free], wholes[free]
            left = left[self.codes[slots[left]] != codes[left]]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make together, -1 for none."""
        codes = left.astype(np.int64) << self.width | right
        slots = self._slots(codes)
        found = self.codes[slots]
        out = np.where(found == codes, self.wholes[slots], np.int32(-1))
        left = np.flatnonzero((found != codes) & (found >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            found = self.codes[slots[left]]
            same = found == codes[left]
            out[left[same]] = self.wholes[slots[left[same]]]
            left = left[~same & (found >= 0)]
        return out

    def merged(self, words: list[str], kind: str) -> list[bytes]:
        """Packed ids of each word."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        lo = 0
        for most in (6, 9, 12, 18, SHORT):
            group = np.flatnonzero((size > lo) & (size <= most))
            for k in range(0, len(group), AT_ONCE):
                self._rows(words, group[k : k + AT_ONCE], size, kind, out)
            lo = most
        for k in np.flatnonzero(size > lo).tolist():
            out[k] = self.alone(words[k], kind)
        return out

    def alone(self, word: str, kind: str) -> bytes:
        return np.array(merged(word, self.model.parts), kind).tobytes()

    def _rows(self, words: list[str], places: np.ndarray, size: np.ndarray, kind: str, out: list[bytes]) -> None:
        size = size[places]
        points = np.frombuffer("".join([words[k] for k in places.tolist()]).encode("utf-32-le"), np.uint32)
        row = np.full((len(places), int(size.max())), self.none, np.int32)
        row[np.arange(row.shape[1]) < size[:, None]] = self.of[points]
        known = (row >= 0).all(1)
        for k in places[~known].tolist():  # a character without a piece may be part of one
            out[k] = self.alone(words[k], kind)
        row, places, size = row[known], places[known], size[known]
        whole = self.pairs(row[:, :-1].ravel(), row[:, 1:].ravel()).reshape(len(row), row.shape[1] - 1)
        while len(row):
            n, wide = row.shape
            if wide > 1:
                at = self.rank[whole].argmin(1)
                new = whole[np.arange(n), at]
                ends = new < 0
            else:
                ends = np.ones(n, bool)
            # a row that has no pair left is done
            rest = size[ends]
            packed, bounds = row[ends][np.arange(wide) < rest[:, None]].astype(kind).tobytes(), np.concatenate([[0], np.cumsum(rest)]) * np.dtype(kind).itemsize
            bounds = bounds.tolist()
            for k, a, b in zip(places[ends].tolist(), bounds, bounds[1:]):
                out[k] = packed[a:b]
            if ends.all():
                return
            row, whole, places, size, at, new = (x[~ends] for x in (row, whole, places, size, at, new))
            each, columns = np.arange(len(row)), np.arange(wide - 1)
            row = np.where(columns > at[:, None], row[:, 1:], row[:, :-1])
            row[each, at] = new
            whole = np.where(columns[:-1] > at[:, None], whole[:, 1:], whole[:, :-1])
            for side in (-1, 0):
                has = np.flatnonzero((at + side >= 0) & (at + side < wide - 2))
                x = at[has] + side
                whole[has, x] = self.pairs(row[has, x], row[has, x + 1])
            size = size - 1


class _Known(dict):
    """Packed ids of the frequent words, and of all others of the slice at hand."""

    def __init__(self, frequent: Iterable[tuple[str, bytes]], model: Model, merges: bool, kind: str):
        super().__init__(frequent)
        self.met: dict[str, bytes] = {}
        merger = Merger(model) if merges else None
        self.fold = lambda words: merger.merged(words, kind) if merges else [np.array(best_path(w, model.parts, model.longest), kind).tobytes() for w in words]

    def meet(self, texts: list[list[str]]) -> None:
        words = [w for w in set().union(*texts) if w not in self]
        self.met = dict(zip(words, self.fold(words)))

    def __missing__(self, word: str) -> bytes:
        return self.met[word]


def lattice(words: DataFrame, keys: list[str], model: Model, merges: bool = False) -> DataFrame:
    """(keys, ids) for rows (keys, word): substrings, equi-join with the piece table, grouping by word, fold; with ``merges`` (keys, edges), not folded."""
    table_ = words.sparkSession.createDataFrame(model.table, "piece string, id int, score double")
    places = words.select(*keys, "word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    parts = places.select(
        *keys, "start", F.posexplode(F.transform(
            F.sequence(F.lit(1), F.least(F.lit(model.longest), F.length("word") - F.col("start"))), lambda n: F.substring("word", F.col("start") + 1, n))).alias("n", "piece"))
    hexed = F.hex(F.encode("piece", "utf-8"))
    spelled = F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("int") + model.bytes)
    edges = parts.join(F.broadcast(table_), "piece", "left").where("id IS NOT NULL OR n = 0").select(*keys, F.struct(
        (F.col("start") + F.col("n") + 1).alias("end"), "start", F.coalesce("score", F.lit(model.unknown)).alias("score"),
        F.when(F.col("id").isNotNull(), F.array("id")).otherwise(spelled).alias("ids")).alias("edge"))
    if merges:
        return edges.groupBy(*keys).agg(F.collect_list("edge").alias("edges"))
    grouped = edges.groupBy(*keys).agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    return grouped.select(*keys, _best(F.col("edges")).alias("ids"))


def _frequent(docs: DataFrame, path: str, most: int) -> DataFrame:
    """The most frequent words of all texts. Which words are taken for frequent changes no result, so a task passes on those only that its table met again."""
    def run(batches):
        model, held = load(path), Counter()

        def out():
            again = [(w, n) for w, n in held.items() if n > 1]
            rows = pa.RecordBatch.from_arrays([pa.array([w for w, _ in again], pa.string()), pa.array([n for _, n in again], pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for _, texts in slices(batches):
            for text in texts.to_pylist():
                held.update(model.words(text))
            if len(held) > LOCAL:
                yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def encode(docs: DataFrame, path: str, frequent: int = FREQUENT, merges: bool = False, decoded: str | None = None) -> DataFrame:
    """(doc_id, ids, text_crc32) of each row of ``docs (doc_id, text)``: by the best path, or by merge order.

    With ``decoded`` the same worker decodes the ids again, into a column of that name: a second one beside it would take
    as much of the executor's memory once more.
    """
    spark, model = docs.sparkSession, load(path)
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def fold(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _merged_column(batch.column(0), batch.column(1))], names=["word", "ids"])

    words = stored(_frequent(given, path, frequent).select("word"), "pieces")
    # dealt by word before the lattice, so that edges need no shuffle; into few files
    words = words.repartition(2 * spark.sparkContext.defaultParallelism, "word")
    solved = lattice(words, ["word"], model, merges)
    if merges:
        solved = solved.mapInArrow(fold, "word string, ids array<int>")
    known = stored(solved, "pieces").toArrow()  # at most ``frequent`` words
    kind = "<u2" if len(model.pieces) <= 1 << 16 else "<u4"
    names = known["word"].to_pylist()
    flat = known["ids"].combine_chunks() if known.num_rows else []
    sent = spark.sparkContext.broadcast((names, [v.values.to_numpy().astype(kind).tobytes() for v in flat]))

    def run(batches):
        own = load(path)
        held = _Known(zip(*sent.value), own, merges, kind)
        for part, texts in slices(batches):
            rows = texts.to_pylist()
            words = [own.words(text) for text in rows]
            held.meet(words)
            packed = [b"".join(map(held.__getitem__, row)) for row in words]
            offs = np.cumsum([0, *map(len, packed)]) // np.dtype(kind).itemsize
            ids = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.frombuffer(b"".join(packed), kind).astype(np.int32)))
            crcs = pa.array([binascii.crc32(text.encode()) for text in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), ids, crcs], names=["doc_id", "ids", "text_crc32"])

    schema, back = "doc_id bigint, ids array<int>, text_crc32 bigint", decoder(path, decoded)
    return given.mapInArrow(lambda batches: back(run(batches)), f"{schema}, {decoded} string") if decoded else given.mapInArrow(run, schema)


def decoder(path: str, out: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the text of the column ``ids`` to batches."""
    def run(batches):
        model = load(path)
        for batch in batches:
            at = 0
            for texts in model.texts(batch.column(batch.schema.get_field_index("ids"))):
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, out])
                at += len(texts)

    return run


def decode(rows: DataFrame, path: str, out: str = "text") -> DataFrame:
    """``rows`` with the text of their ``ids``."""
    return rows.mapInArrow(decoder(path, out), ", ".join([*(f"{n} {t}" for n, t in rows.dtypes), f"{out} string"]))


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text, decode the ids again; ``round_trip``: the decoded text is the text."""
    import public_tokenizers

    return encoded_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    back = encode(docs, path, merges=load(path).merges, decoded="decoded")
    return back.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.crc32(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_crc32"),
        (F.crc32("decoded") == F.col("text_crc32")).alias("round_trip"))
