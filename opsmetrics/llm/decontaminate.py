"""Operator 6, benchmark decontamination: pigeonhole edit matching over words.

A test item of n words occurs in a text if some stretch of the text is within ``k = n * PERCENT // 100`` word edits
(insertions, deletions, replacements) of it. The item is split into k + 1 pieces; with at most k edits one piece stands
unchanged, so every occurrence holds an exact piece. Pieces are found by the hashes of their first ``HEAD`` words (all
of them, if shorter) over all positions of the text, then compared whole; around each hit the stretch that can hold the
item is checked with Myers' bit-parallel edit distance, one bit per word of the item.

Words are letters and digits, lower-cased (ASCII), so case, punctuation and line breaks make no difference. Items with
fewer than ``SHORTEST`` words are found where they stand unchanged: they have no budget and are one piece.

The test items are the stated query set: they are taken in blocks of at most ``BLOCK_ITEMS`` rows, and each block goes
through all texts; a block, not the benchmark, is what is sent to the tasks. Null and empty texts or items match
nothing; equal items each match; repeated rows and null ids are kept as they are; extra columns are kept.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, slices, table, windows
from .registry import query

PERCENT, HEAD, SHORTEST = 15, 3, 8
BLOCK_ITEMS = 20_000


def myers(pattern: dict[int, int], size: int, text: list[int]) -> tuple[int, int]:
    """(least edit distance of the whole pattern to any stretch of ``text``, end of the first such stretch).

    ``pattern`` maps a word hash to the bit set of its places in the pattern of ``size`` words.
    """
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best, at = size, 0
    for k, word in enumerate(text):
        eq = pattern.get(word, 0)
        x = eq | down
        y = (((eq & up) + up) ^ up) | eq
        h_up, h_down = (down | ~(y | up)) & full, up & y
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up, h_down = (h_up << 1) & full, (h_down << 1) & full
        up, down = (h_down | ~(x | h_up)) & full, h_up & x
        if score < best:
            best, at = score, k + 1
    return best, at


class Items:
    """Pieces of a block of test items, by the hash of their heads."""

    def __init__(self, ids: list[int], texts: list[str | None], percent: int = PERCENT):
        words = Words(pa.array([t or "" for t in texts], pa.large_string()), ALNUM)
        self.ids, self.words, self.bits, self.budget = [], [], [], []
        heads: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
        for i, a, b in zip(ids, words.lo, words.hi):
            h, n = words.hash[a:b], int(b - a)
            if n == 0:
                continue
            at, k = len(self.ids), n * percent // 100 if n >= SHORTEST else 0
            bits: dict[int, int] = {}
            for j, w in enumerate(h.tolist()):
                bits[w] = bits.get(w, 0) | 1 << j
            self.ids.append(i)
            self.words.append(h)
            self.bits.append(bits)
            self.budget.append(k)
            cuts = [n * j // (k + 1) for j in range(k + 2)]
            for start, end in zip(cuts, cuts[1:]):
                width = min(HEAD, end - start)
                heads.setdefault(width, {}).setdefault(int(windows(h[start : start + width], width)[0]), []).append((at, start, end))
        self.heads = [(width, np.sort(np.array(list(some), dtype=np.uint64)), some) for width, some in heads.items()]
        self.masks = []
        for _, known, _ in self.heads:
            mask = np.zeros(1 << 16, bool)
            mask[known & np.uint64(0xFFFF)] = True
            self.masks.append(mask)

    def matches(self, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, first word, end, edits) of each item's best occurrence in a text of word hashes ``h``."""
        found: dict[int, tuple[int, int, int]] = {}
        for (width, known, pieces), mask in zip(self.heads, self.masks):
            runs = windows(h, width)
            at = np.flatnonzero(mask[runs & np.uint64(0xFFFF)])
            if len(at) == 0:
                continue
            at = at[known[np.minimum(np.searchsorted(known, runs[at]), len(known) - 1)] == runs[at]]
            tried: set[tuple[int, int]] = set()
            for p in at.tolist():
                for item, start, end in pieces[int(runs[p])]:
                    own, k = self.words[item], self.budget[item]
                    if (k == 0 and item in found) or (item, p - start) in tried or not np.array_equal(own[start:end], h[p : p + end - start]):
                        continue
                    tried.add((item, p - start))
                    n = len(own)
                    if k == 0:  # the piece is the item; positions ascend
                        found.setdefault(item, (0, p + n, p))
                        continue
                    lo, hi = max(0, p - start - k), min(len(h), p - start + n + k)
                    edits, stop = myers(self.bits[item], n, h[lo:hi].tolist())
                    if edits <= k and (item not in found or (edits, lo + stop) < (found[item][0], found[item][1])):
                        found[item] = (edits, lo + stop, max(0, lo + stop - n))
        return [(self.ids[item], first, stop, edits) for item, (edits, stop, first) in sorted(found.items())]


MATCH = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.LongType())]))
_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "first", "end", "edits")]))


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, text: str = "text", out: str = "matches") -> DataFrame:
    """``docs`` with a column ``out``: per test item found, its best occurrence (item_id, first word, end, edits)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).where("text IS NOT NULL")
    frame, columns, block = docs, [], []

    def add(frame: DataFrame, rows: list) -> DataFrame:
        name = f"{out}{len(columns)}"
        columns.append(name)
        sent = spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))  # at most BLOCK_ITEMS rows

        def run(batches):
            held = Items(*sent.value, percent)
            for part, texts in slices(batches, text):
                words = Words(texts, ALNUM)
                rows = [[dict(zip(("item_id", "first", "end", "edits"), m)) for m in held.matches(words.hash[a:b])] for a, b in zip(words.lo, words.hi)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, _ARROW)], names=[*part.schema.names, name])

        return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(name, MATCH)]))

    for row in items.toLocalIterator():
        block.append(row)
        if len(block) == BLOCK_ITEMS:
            frame, block = add(frame, block), []
    if block or not columns:
        frame = add(frame, block)
    joined = reduce(lambda a, b: F.concat(a, b), [F.col(c) for c in columns])
    return frame.select(*[frame[c] for c in docs.columns], joined.alias(out))


@query("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the items found in it; ``clean`` if there is none."""
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.size("matches").cast("bigint").alias("n_items"), (F.size("matches") == 0).alias("clean"),
        F.array_join(F.array_sort(F.transform("matches", lambda m: m["item_id"])).cast("array<string>"), ",").alias("item_ids"),
        F.array_min(F.transform("matches", lambda m: m["edits"])).alias("least_edits"))
