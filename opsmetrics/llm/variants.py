"""Operator 13, spelling variants of words by permuterm rotations.

**Words** are the maximal runs of letters of whole texts, A to Z made small, of at least ``SHORTEST`` code points, that
occur at least ``LEAST`` times. Tasks count them in a bounded table, which they hand on whenever it is full.

**Rotations.** A word w is marked by a terminator, w$, and written in all its rotations. A rotation that ends in the
character c is y$xc for w = xcy: without its last character it is the prefix y$x of every word that has another
character in c's place, and it is the whole rotation of xy, the word without c. So the rotations are dealt and sorted by
prefix; a group of one prefix holds at most one word for each character of the alphabet, and the word that lacks the
character. Two words of a group are near, and two near words meet: once, if a character is replaced; if one is left out
of a run of equal characters, they meet at each of them, and the first alone counts.

**Groups are scanned**, not paired: a row needs its group's size and its first two words by number of occurrences. Each
row gives its word a count and a best neighbour, and these are summed up by word. Work grows with the words' lengths.

A word's **form** is its near word of the largest n (ties: the smallest in code-point order) if that is at least
``FACTOR`` times its own n. Forms grow in n, so they have no cycles; **roots** follow by doubling the steps taken.

Null texts have no words; a null id counts as empty text in the digest that decides on deletions. Repeated rows count
again. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, byte_table, raw, slices, stored, table
from .pretokens import distinct_spans
from .registry import query

SHORTEST, LEAST, FACTOR = 6, 5, 5
HELD = 400_000  # different words a task counts before it hands them on
END = "$"

# U+00C0 to U+00FF are the byte 0xC3 and one more.
_ASCII = byte_table((0x61, 0x7A))
_LEAD = 0xC3


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(small bytes, start, end, code points, row) of the runs of letters of a slice of texts."""
    data, offs = raw(texts)
    data = LOWER[data]
    lead = data == _LEAD
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    at = offs[:-1][(offs[:-1] < len(data))]
    edge[at] = inside[at]
    start = np.flatnonzero(edge)
    stop = np.zeros(len(data) + 1, dtype=bool)
    stop[1:] = inside
    stop[1:-1] &= ~inside[1:]
    ends = offs[1:]
    stop[ends] = stop[ends] | np.append(False, inside)[ends]
    stop[0] = False
    end = np.flatnonzero(stop)
    wide = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(lead, out=wide[1:])
    return data, start, end, end - start - (wide[end] - wide[start]), np.searchsorted(offs, start, "right") - 1


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    return np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)


def crcs(seed: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each span of ``data``, continued from ``seed`` (crc32 of what stands before it)."""
    step = _crc_table()
    out = np.empty(len(start), dtype=np.uint32)
    size = end - start
    order = np.argsort(-size, kind="stable")
    long = int((size > 64).sum())
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[start[k] : end[k]].tobytes(), int(seed[k]))
    order = order[long:]
    state, at, size = ~seed[order], start[order], size[order]
    for k in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -k, "left"))  # spans longer than k stand first
        state[:m] = step[(state[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ (state[:m] >> np.uint32(8))
    out[order] = ~state
    return out


def word_counts(docs: DataFrame, shortest: int = SHORTEST, dropped: int | None = 199) -> DataFrame:
    """(word, n) of ``docs (doc_id, text)``.

    A run whose crc32 with its document's id is divisible by ``dropped`` loses the code point at that number modulo its
    length before it is counted (None: no run does).
    """
    def run(batches):
        held: dict[bytes, int] = {}

        def out():
            words, n = pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

        for part, texts in slices(batches):
            data, start, end, size, row = runs(texts)
            some = size >= shortest
            start, end, row = start[some], end[some], row[some]
            if dropped:
                seed = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in part.column(0).to_pylist()], dtype=np.uint32)
                crc = crcs(seed[row], data, start, end)
                hit = crc % np.uint32(dropped) == 0
                for x, y, h in zip(start[hit].tolist(), end[hit].tolist(), crc[hit].tolist()):
                    word = data[x:y].tobytes().decode()
                    at = h % len(word)
                    if len(word) > shortest:
                        word = (word[:at] + word[at + 1 :]).encode()
                        held[word] = held.get(word, 0) + 1
                start, end = start[~hit], end[~hit]
            first, of = distinct_spans(data, start, end)
            whole = data.tobytes()
            for x, y, n in zip(start[first].tolist(), end[first].tolist(), np.bincount(of, minlength=len(first)).tolist()):
                word = whole[x:y]
                held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    parts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, last, n): each rotation by its prefix and last character, and whole, with an empty last one."""
    size = F.length("word")
    # the end of the word, the terminator, and its beginning up to character k
    around = lambda k, skip: F.concat(F.substr("word", k + 1 + skip, size), F.lit(END), F.substr("word", F.lit(1), k))
    holes = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.struct(around(k, 1).alias("prefix"), F.substr("word", k + 1, F.lit(1)).alias("last")))
    whole = F.transform(F.sequence(F.lit(0), size), lambda k: F.struct(around(k, 0).alias("prefix"), F.lit("").alias("last")))
    return words.select("n", F.inline(F.concat(holes, whole))).select("prefix", "last", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best), best the near word of the largest n as (-n, word); words without near ones are absent."""
    before, after = F.substring_index("prefix", END, -1), F.substring_index("prefix", END, 1)
    dealt = rotations(words).repartition("prefix").select(
        "prefix", (F.col("last") == "").alias("whole"), (~F.endswith(before, F.col("last"))).alias("once"),
        F.struct((-F.col("n")).alias("minus"), F.concat(before, F.col("last"), after).alias("word")).alias("own"))
    sorted_ = W.partitionBy("prefix").orderBy("whole", "own")
    group = sorted_.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    def lowest(*wanted: Column) -> Column:
        test = ~F.col("whole")
        for w in wanted:
            test = test & w
        return F.min(F.when(test, F.col("own"))).over(group)

    scanned = dealt.select(
        "whole", "once", "own", F.row_number().over(sorted_).alias("place"),
        F.sum((~F.col("whole")).cast("long")).over(group).alias("holes"), F.sum((~F.col("whole") & F.col("once")).cast("long")).over(group).alias("once_holes"),
        lowest().alias("first"), lowest(F.col("once")).alias("first_once"), F.nth_value("own", 2).over(group).alias("second"),
        F.min(F.when(F.col("whole"), F.col("own"))).over(group).alias("without"))
    shorter = F.col("once") & F.col("without").isNotNull()
    other = F.when(F.col("place") > 1, F.col("first")).when(F.col("holes") > 1, F.col("second"))
    met = scanned.select(
        F.col("own.word").alias("word"),
        F.when(F.col("whole"), F.col("once_holes")).otherwise(F.col("holes") - 1 + shorter.cast("long")).alias("met"),
        F.when(F.col("whole"), F.col("first_once")).otherwise(F.least(other, F.when(shorter, F.col("without")))).alias("best")).where("met > 0")
    return met.groupBy("word").agg(F.sum("met").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where the forms lead; each round doubles the steps taken."""
    links = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if not joined.where("moved").limit(1).count():
            return joined.select("word", "root")
        links = joined.select("word", "root")


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of different ``words (word, n)``."""
    words = words.select("word", "n")
    near = neighbours(words)
    formed = F.col("best.minus") <= -factor * F.col("n")
    rows = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.minus")).alias("form_n")),
        "variant-forms")
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


SQL = r"""
WITH runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
hexed AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM runs),
summed AS (
  SELECT w, n, xor(4294967295, list_reduce(flatten(list_transform(range(0, len(x) // 2), lambda k: [('0x' || x[2 * k + 1:2 * k + 2])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::BIGINT)) AS h
  FROM hexed),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM summed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT DISTINCT word, n, k, substr(word, 1, k) AS x, substr(word, k + 2) AS y FROM words, LATERAL (SELECT unnest(range(0, length(word)))::INT AS k)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.x = b.x AND a.y = b.y AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.x || a.y = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.x || a.y = b.word),
near AS (SELECT word, count(*) AS n_near, min({'minus': -m, 'word': other}) AS best FROM pairs GROUP BY word),
formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.minus >= 5 * n THEN best.word END AS form, CASE WHEN -best.minus >= 5 * n THEN -best.minus END AS form_n
  FROM words LEFT JOIN near USING (word)),
steps AS (
  WITH RECURSIVE s AS (SELECT word, word AS root, 0 AS k FROM formed UNION ALL SELECT s.word, formed.form, k + 1 FROM s JOIN formed ON formed.word = s.root WHERE formed.form IS NOT NULL)
  SELECT word, max_by(root, k) AS root FROM s GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN steps USING (word)
"""


@query("op13_spelling_variants", SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of all documents."""
    words = stored(word_counts(table(spark, sf_dir, "documents")).where(F.col("n") >= LEAST), "variant-words")
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")
