"""Operator 10, quality classifier: a factorisation machine.

Features of a text: its words (hashed, weighted by their share of the text), and structure statistics and the length
in code points, each in one of a few buckets, one feature per bucket. The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2))

so all pairwise interactions cost time linear in the number of words. Fitted by adaptive gradient steps on at most
``PER_CLASS`` documents of each class (weighted back to the classes' shares in the sample's source).

Null and empty texts get the score of a text without words: structure features alone. Without training rows of both
classes every text scores 1, so that a filter keeps everything. Repeated rows and null ids are scored like others;
extra columns are kept; labels, ids, lang and source are never features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_SPACE, Words, byte_table, slices, table
from .registry import query
from .sampling import remainder, training_rows

PER_CLASS = 3000
BITS, FACTORS, BUCKETS = 16, 6, 12
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.08, 1e-4

UPPER, LETTER = byte_table((65, 90)), byte_table((65, 90), (97, 122), (128, 255))
DIGIT, LINE = byte_table((48, 57)), byte_table((10, 10))
MARK = byte_table((33, 47), (58, 64), (91, 96), (123, 126))
STATISTICS = (
    "marks", "upper", "digits", "non_ascii", "word_length", "lone_marks", "marked_ends", "new_words", "repeats", "words", "line_words", "same_lines",
    "top_word", "characters")


def statistics(words: Words) -> np.ndarray:
    """One row per text, one column per statistic, all between 0 and 1."""
    data, offs = words.data, words.offs
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
    size = np.maximum(1, np.diff(offs))
    letters, n = np.maximum(1, total(LETTER[data])), words.counts()
    some = np.maximum(1, n)
    per_word = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([words.lo, words.hi[-1:]])])
    length = words.end - words.start
    last = data[words.end - 1] if len(length) else np.zeros(0, np.uint8)
    doc = words.doc_of()
    same = np.zeros(len(length), bool)
    if len(length) > 1:
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    new, top, lines_same = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    lines = line_hashes(words)
    for k, (a, b) in enumerate(zip(words.lo, words.hi)):
        if b > a:
            counts = np.unique(words.hash[a:b], return_counts=True)[1]
            new[k], top[k] = len(counts) / (b - a), counts.max() / (b - a)
        own = lines[k]
        lines_same[k] = 1 - len(np.unique(own)) / len(own) if len(own) else 0.0
    marked = (length > 1) & MARK[last] & MARK[data[np.maximum(words.end - 2, words.start)]] if len(length) else same
    lone = (length == 1) & MARK[last] if len(length) else same
    line_count = total(LINE[data]) + 1
    points = total((data & 0xC0) != 0x80)
    log = lambda x, top: np.minimum(1.0, np.log1p(x) / np.log(top))
    return np.stack([
        total(MARK[data]) / size, total(UPPER[data]) / letters, total(DIGIT[data]) / size, total(data >= 128) / size, np.minimum(1.0, per_word(length) / some / 20),
        per_word(lone) / some, per_word(marked) / some, new, per_word(same) / some, log(n, 20_000), log(n / line_count, 2_000), lines_same,
        top, log(points, 200_000)], axis=1)


def line_hashes(words: Words) -> list[np.ndarray]:
    """Per text, a hash of each line that has words: the sum of its word hashes times their place in the line."""
    if len(words.start) == 0:
        return [np.zeros(0, np.uint64)] * len(words.lo)
    breaks = np.concatenate([[0], np.cumsum(LINE[words.data])])
    line = breaks[words.start] + 0
    doc = words.doc_of()
    first = np.flatnonzero(np.concatenate([[True], (np.diff(line) != 0) | (np.diff(doc) != 0)]))
    place = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
    sums = np.add.reduceat(words.hash * (place * 2 + 1).astype(np.uint64), first)
    bound = np.searchsorted(doc[first], np.arange(len(words.lo) + 1))
    return [sums[a:b] for a, b in zip(bound[:-1], bound[1:])]


def buckets(stats: np.ndarray) -> np.ndarray:
    """Feature numbers of the statistics' buckets, above the hashed words; finer near 0."""
    at = np.minimum(BUCKETS - 1, np.floor(np.sqrt(np.clip(stats, 0, 1)) * BUCKETS)).astype(np.int64)
    return (1 << BITS) + np.arange(stats.shape[1]) * BUCKETS + at


@dataclass
class Machine:
    base: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, words: Words) -> np.ndarray:
        """Scores of all texts of a slice."""
        feature = (words.hash & np.uint64((1 << BITS) - 1)).astype(np.int64)
        n = np.maximum(1, words.counts())
        dense = buckets(statistics(words))
        per = lambda values: np.diff(np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])[np.concatenate([words.lo, words.hi[-1:]])], axis=0)
        # the square of a word's value needs its count in the text: equal words add up before they are squared
        doc = words.doc_of()
        pair, counts = np.unique(doc * (1 << BITS) + feature, return_counts=True)
        own, f = pair >> BITS, pair & ((1 << BITS) - 1)
        x = counts / n[own]
        bound = np.searchsorted(own, np.arange(len(n) + 1))
        add = lambda values: np.diff(np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])[bound], axis=0)
        v = self.factor[f] * x[:, None]
        linear = add((self.weight[f] * x)[:, None])[:, 0] + self.weight[dense].sum(axis=1)
        total, squares = add(v) + self.factor[dense].sum(axis=1), add(v * v) + (self.factor[dense] ** 2).sum(axis=1)
        z = self.base + linear + 0.5 * (total * total - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature, value) arrays of each text."""
    feature = (words.hash & np.uint64((1 << BITS) - 1)).astype(np.int64)
    dense = buckets(statistics(words))
    out = []
    for k, (a, b) in enumerate(zip(words.lo, words.hi)):
        f, c = np.unique(feature[a:b], return_counts=True)
        out.append((np.concatenate([f, dense[k]]), np.concatenate([c / max(1, b - a), np.ones(dense.shape[1])])))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, share: float | None = None) -> Machine:
    """Fit to sparse rows with 0/1 labels; ``share`` is the part of 1 among all labels that the sample stands for."""
    size = (1 << BITS) + len(STATISTICS) * BUCKETS
    rng = np.random.default_rng(7)
    machine = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)))
    if not ((y == 0).any() and (y == 1).any()):
        return Machine(30.0, np.zeros(size), np.zeros((size, FACTORS)))
    share = float(y.mean()) if share is None else share
    cost = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    sums = [1e-6, np.full(size, 1e-6), np.full((size, FACTORS), 1e-6)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            f = np.concatenate([rows[k][0] for k in some])
            x = np.concatenate([rows[k][1] for k in some])
            own = np.repeat(np.arange(len(some)), [len(rows[k][0]) for k in some])
            edge = np.searchsorted(own, np.arange(len(some)))
            v = machine.factor[f] * x[:, None]
            total, squares = np.add.reduceat(v, edge), np.add.reduceat(v * v, edge)
            z = machine.base + np.add.reduceat(machine.weight[f] * x, edge) + 0.5 * (total * total - squares).sum(axis=1)
            gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * cost[some] / len(some)
            each, at_feature = np.unique(f, return_inverse=True)
            g = gap[own] * x
            linear = np.bincount(at_feature, g, minlength=len(each)) + DECAY * machine.weight[each]
            inner = g[:, None] * (total[own] - v)
            cross = np.stack([np.bincount(at_feature, inner[:, k], minlength=len(each)) for k in range(FACTORS)], axis=1) + DECAY * machine.factor[each]
            sums[0] += gap.sum() ** 2
            sums[1][each] += linear**2
            sums[2][each] += cross**2
            machine.base -= RATE * gap.sum() / np.sqrt(sums[0])
            machine.weight[each] -= RATE * linear / np.sqrt(sums[1][each])
            machine.factor[each] -= RATE * cross / np.sqrt(sums[2][each])
    return machine


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, per_class: int = PER_CLASS) -> Machine:
    """Fit on a bounded sample of the labelled rows whose id is not in the held-out fold."""
    def run(batches):
        for part, texts in slices(batches):
            rows = features(Words(texts, NOT_SPACE, lower=False))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([f for f, _ in rows], pa.list_(pa.int64())), pa.array([x for _, x in rows], pa.list_(pa.float64()))],
                names=["doc_id", "y", "f", "x"])

    held_out = remainder("doc_id", folds) == held
    shares = labels.where(F.col(label).isin(0, 1) & ~held_out).agg(F.avg(label)).first()[0]
    sample = training_rows(docs, labels, label, folds, held_out, per_class)
    rows = sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id bigint, y int, f array<bigint>, x array<double>").toArrow()
    if rows.num_rows == 0:
        return fit([], np.zeros(0))
    f, x = rows["f"].combine_chunks(), rows["x"].combine_chunks()
    order = sorted(range(rows.num_rows), key=lambda k: rows["doc_id"][k].as_py())
    return fit([(f[k].values.to_numpy(), x[k].values.to_numpy()) for k in order], np.array([rows["y"][k].as_py() for k in order], dtype=np.int64), shares)


def scored(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column of scores between 0 and 1."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # a fixed number of weights

    def run(batches):
        for part, texts in slices(batches, text):
            score = model.value.score(Words(texts, NOT_SPACE, lower=False))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, table(spark, sf_dir, "labels"), "quality", 5, 0)
    return scored(docs, machine).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
