"""Operator 8, toxicity: a linear-chain conditional random field over words.

**Labelled tokens.** Documents carry one label each. Features of a token are the word and its beginnings of ``BEGINNINGS``
bytes. A feature is a candidate if it is at least ``ODDS`` times as frequent among toxic as among other training
documents and in at least ``SUPPORT`` of them. Each toxic document shares one vote among its candidates, twice, the
second time in proportion to the first result, so that many rare words of a text that was copied count little;
features with enough votes are taken as toxic, and tokens that have one, in toxic documents, are the positive tokens.

**Field.** Two states, an emission weight per feature of the training texts, a bias, and transitions; fitted by adaptive
gradient ascent of the regularised likelihood, with exact forward-backward marginals, on at most ``PER_CLASS`` documents
of each class.

**Scores.** The marginals of each whole text: its score is the largest marginal of the toxic state, its offending
offsets are the words with a marginal of 0.5 or more. Forward and backward messages of all texts of a slice run as one
chain of 2 x 2 matrices; the first word of a text has a matrix of rank one, which cuts the chain there. The chain is
evaluated in blocks, all blocks at once.

Null and empty texts, and texts without words, score 0. Without training rows of both classes every score is 0.
Repeated rows and null ids are scored like others; extra columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, slices, table
from .registry import query
from .sampling import remainder, training_rows

PER_CLASS = 1500
BEGINNINGS = (4, 5, 6, 7)
ODDS, SUPPORT, LEAST_SHARE, SHARE = 50.0, 3, 0.5, 0.004
UPDATES, BATCH, RATE, DECAY, LEAST = 480, 50, 0.6, 1e-3, 0.05
BLOCK = 128


@dataclass
class Field:
    """``known`` feature hashes (sorted) with a ``weight`` each and one 0 more for all others, ``bias`` of the toxic state, ``step``
    (log potentials of state pairs), ``first`` (of a text's first state)."""

    known: np.ndarray
    weight: np.ndarray
    bias: float
    step: np.ndarray
    first: np.ndarray

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The weight's place of each feature."""
        if len(self.known) == 0:
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, len(self.known))

    def matrices(self, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A 2 x 2 matrix per word (a row of feature places each): transition times emission; rank one where a text starts."""
        toxic = np.exp(np.clip(self.bias + self.weight[buckets].sum(axis=1), -30, 30))
        step, first = np.exp(self.step), np.exp(self.first)
        m = np.empty((len(buckets), 2, 2))
        m[:, :, 0] = step[:, 0]
        m[:, :, 1] = step[:, 1] * toxic[:, None]
        m[starts, :, 0] = first[0]
        m[starts, :, 1] = (first[1] * toxic[starts])[:, None]
        return m


def messages(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised forward (row) and backward (column) messages of a chain of matrices."""
    n = len(m)
    rows = -(-n // BLOCK)
    full = np.broadcast_to(np.eye(2), (rows * BLOCK, 2, 2)).copy()
    full[:n] = m
    full = full.reshape(rows, BLOCK, 2, 2)
    whole = np.broadcast_to(np.eye(2), (rows, 2, 2)).copy()
    for k in range(BLOCK):
        whole = np.matmul(whole, full[:, k])
        whole /= whole.sum(axis=(1, 2), keepdims=True)
    into, out = np.empty((rows, 2)), np.empty((rows, 2))
    a = (0.5, 0.5)
    products = whole.tolist()
    for b in range(rows):
        into[b] = a
        w = products[b]
        x, y = a[0] * w[0][0] + a[1] * w[1][0], a[0] * w[0][1] + a[1] * w[1][1]
        a = (x / (x + y), y / (x + y))
    c = (0.5, 0.5)
    for b in range(rows - 1, -1, -1):
        out[b] = c
        w = products[b]
        x, y = w[0][0] * c[0] + w[0][1] * c[1], w[1][0] * c[0] + w[1][1] * c[1]
        c = (x / (x + y), y / (x + y))
    forward, backward = np.empty((rows, BLOCK, 2)), np.empty((rows, BLOCK, 2))
    for k in range(BLOCK):
        into = np.einsum("bi,bij->bj", into, full[:, k])
        into /= into.sum(axis=1, keepdims=True)
        forward[:, k] = into
    for k in range(BLOCK - 1, -1, -1):
        backward[:, k] = out
        out = np.einsum("bij,bj->bi", full[:, k], out)
        out /= out.sum(axis=1, keepdims=True)
    return forward.reshape(-1, 2)[:n], backward.reshape(-1, 2)[:n]


def marginals(m: np.ndarray) -> np.ndarray:
    """Probability of the toxic state of each word."""
    if len(m) == 0:
        return np.zeros(0)
    both = np.multiply(*messages(m))
    return both[:, 1] / both.sum(axis=1)


def toxic_words(hashes: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Hashes of the features that explain the toxic documents."""
    distinct = [np.unique(h[h != 0]) for h in hashes]
    words, at = np.unique(np.concatenate([*distinct, np.zeros(0, np.uint64)]), return_inverse=True)
    doc = np.repeat(np.arange(len(distinct)), [len(d) for d in distinct])
    toxic = y[doc] == 1
    pos, neg = np.bincount(at[toxic], minlength=len(words)), np.bincount(at[~toxic], minlength=len(words))
    odds = ((pos + 0.1) / (y == 1).sum()) / ((neg + 0.1) / (y == 0).sum())
    strong = (odds >= ODDS) & (pos >= SUPPORT)
    keep = toxic & strong[at]
    at, doc = at[keep], doc[keep]
    share = np.ones(len(words))
    for _ in range(2):
        share = np.bincount(at, share[at] / np.bincount(doc, share[at], minlength=len(distinct))[doc], minlength=len(words))
    return words[share >= max(LEAST_SHARE, SHARE * (y == 1).sum())]


def fit(hashes: list[np.ndarray], y: np.ndarray) -> Field:
    """Fit the field to documents given as feature hashes (a row per word), with a label each."""
    seen: dict[bytes, int] = {}
    for k, h in enumerate(hashes):
        if len(h):
            seen.setdefault(h.tobytes(), k)
    kept = sorted(seen.values())
    hashes, y = [hashes[k] for k in kept], y[kept]
    if not ((y == 0).any() and (y == 1).any()):  # known and weight hold a place for features that were never seen
        return Field(np.zeros(0, np.uint64), np.zeros(1), -30.0, np.zeros((2, 2)), np.zeros(2))
    known = np.unique(np.concatenate([np.unique(h) for h in hashes]))
    lexicon = toxic_words(hashes, y)
    field = Field(known, np.zeros(len(known) + 1), -4.0, np.zeros((2, 2)), np.zeros(2))
    sums = [np.full(len(known) + 1, 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    rng = np.random.default_rng(11)
    for _ in range(-(-UPDATES * BATCH // len(hashes))):
        order = rng.permutation(len(hashes))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            sizes = np.array([len(hashes[k]) for k in some])
            flat = np.concatenate([hashes[k] for k in some])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            label = (np.isin(flat, lexicon).any(axis=1) & np.repeat(y[some] == 1, sizes)).astype(np.int64)
            own = field.places(flat)
            m = field.matrices(own, starts)
            forward, backward = messages(m)
            both = forward * backward
            gap = label - both[:, 1] / both.sum(axis=1)
            inner = np.ones(len(flat), bool)
            inner[starts] = False
            inner = np.flatnonzero(inner)
            pair = forward[inner - 1][:, :, None] * m[inner] * backward[inner][:, None, :]
            pair = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            seen_pairs = np.bincount(label[inner - 1] * 2 + label[inner], minlength=4).reshape(2, 2)
            each, back = np.unique(own, return_inverse=True)
            grad = np.bincount(back.ravel(), np.repeat(gap, own.shape[1]), minlength=len(each)) - DECAY * field.weight[each]
            sums[0][each] += grad * grad
            sums[1] += gap.sum() ** 2
            sums[2] += (seen_pairs - pair) ** 2
            field.weight[each] += RATE * grad / np.sqrt(sums[0][each])
            field.weight[-1] = 0.0
            field.bias += RATE * gap.sum() / np.sqrt(sums[1])
            field.step += 0.2 * RATE * (seen_pairs - pair) / np.sqrt(sums[2])
    keep = np.abs(field.weight[:-1]) >= LEAST
    return Field(known[keep], np.append(field.weight[:-1][keep], 0.0), float(field.bias), field.step, field.first)


def features(words: Words) -> np.ndarray:
    """A row of feature hashes per word; 0 stands for none."""
    return np.stack([words.hash, *(words.prefix(k) for k in BEGINNINGS)], axis=1)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, per_class: int = PER_CLASS) -> Field:
    """Fit on a bounded sample of the labelled rows whose id is not in the held-out fold."""
    def run(batches):
        for part, texts in slices(batches):
            words = Words(texts, ALNUM)
            found = features(words)
            rows = [found[a:b].ravel().view(np.int64) for a, b in zip(words.lo, words.hi)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "y", "words"])

    sample = training_rows(docs, labels, label, folds, remainder("doc_id", folds) == held, per_class)
    rows = sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id bigint, y int, words array<bigint>").toArrow()
    order = sorted(range(rows.num_rows), key=lambda k: rows["doc_id"][k].as_py())
    column = rows["words"].combine_chunks() if rows.num_rows else None
    hashes = [column[k].values.to_numpy().view(np.uint64).reshape(-1, 1 + len(BEGINNINGS)) for k in order] if rows.num_rows else []
    return fit(hashes, np.array([rows["y"][k].as_py() for k in order], dtype=np.int64))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
RESULT = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])))])


def tag(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``spans`` (start, end in code points, p) of the offending words."""
    model = docs.sparkSession.sparkContext.broadcast(field)  # a weight per word of the bounded sample

    def run(batches):
        own = model.value
        for part, texts in slices(batches, text):
            words = Words(texts, ALNUM)
            filled = np.flatnonzero(words.counts() > 0)
            p = marginals(own.matrices(own.places(features(words)), words.lo[filled]))
            score, spans = np.zeros(len(texts)), [[] for _ in range(len(texts))]
            if len(filled):
                score[filled] = np.maximum.reduceat(p, words.lo[filled])
            lead = np.flatnonzero(p >= 0.5)
            for k, r in zip(lead, np.searchsorted(words.hi, lead, "right")):
                begin = int(words.offs[r])
                points = [int(np.count_nonzero((words.data[begin:x] & 0xC0) != 0x80)) for x in (words.start[k], words.end[k])]
                spans[r].append({"start": points[0], "end": points[1], "p": float(p[k])})
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array(spans, _SPANS)], names=[*part.schema.names, "score", "spans"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *RESULT.fields]))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = train(docs, table(spark, sf_dir, "labels"), "toxic", 3, 1)
    return tag(docs, field).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))
