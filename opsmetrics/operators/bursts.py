"""Burst numbering and gap suppression: greedy, sequential rules run slice by slice.

Both rules jump from row to row: from a group's first row to the next group's, from a pick to the next pick. Where a jump
leads is known for every row at once; which rows are reached from a slice's first jump is found by doubling the jumps
(one step, two, four, ..) in arrays, without walking the rows. A slice is reduced to "state in -> state out", the slices
of a key are chained over those small records, and every slice gets its known state. A window clusters and sorts each
slice; the arrays are those of an Arrow batch, so a task never holds one key's history.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialize
from .ordered import KEY, SLICE, key_of, time_slice, with_slice

Batches = Iterator[pd.DataFrame]


def doubled(jump: np.ndarray) -> list[np.ndarray]:
    """Where 1, 2, 4, .. jumps lead; ``jump`` leads forwards, or to its length, which is nowhere."""
    steps = [np.append(jump, len(jump))]
    while (steps[-1] < len(jump)).any():
        steps.append(steps[-1][steps[-1]])
    return steps


def reached(steps: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Flags of all rows that jumps from ``first`` reach, these included."""
    seen = np.zeros(len(steps[0]), dtype=bool)
    seen[first] = True
    for step in steps:
        seen[step[np.flatnonzero(seen)]] = True
    return seen[:-1]


def last_reached(steps: list[np.ndarray]) -> np.ndarray:
    """The last row that jumps from each row reach, itself if it jumps nowhere."""
    n = len(steps[0]) - 1
    at = np.arange(n)
    for step in reversed(steps):
        onward = step[at]
        at = np.where(onward < n, onward, at)
    return at


class Pieces:
    """The slices within a batch: ``lo``/``hi`` of each, and the piece ``of`` each row; the first may go on from the batch before."""

    def __init__(self, new: np.ndarray):
        starts = np.flatnonzero(new)
        self.goes_on = len(new) > 0 and not new[0]
        self.lo = np.append(0, starts) if self.goes_on else starts
        self.hi = np.append(self.lo[1:], len(new))
        self.of = np.repeat(np.arange(len(self.lo)), self.hi - self.lo)


def _fields(df: DataFrame, names: list[str], **more: T.DataType) -> T.StructType:
    return T.StructType([df.schema[n] for n in names] + [T.StructField(n, t) for n, t in more.items()])


def _at_end(keys: list[str]) -> list:
    """The key on the last row of each slice, null elsewhere: the walks carry it no further."""
    return [F.when(F.col("__end"), F.col(k)).alias(k) for k in key_of(keys)]


def _by_slice(df: DataFrame, keys: list[str]) -> DataFrame:
    """Slice summaries in order per key, the first of each key flagged."""
    w = Window.partitionBy(*key_of(keys)).orderBy(SLICE)
    return df.withColumn("__new", F.row_number().over(w) == 1)


def burst_numbers(
    df: DataFrame, keys: list[str], epoch: str, ties: list[str], out: str = "buffer",
    max_gap: int = 15, max_group: int = 4, slice_seconds: int = 3600,
) -> DataFrame:
    """Number rows 1.. within groups of up to ``max_group`` rows lying within
    ``max_gap`` seconds of the group's first row.

    Rows are taken per key in (``epoch``, ``ties``) order. How many rows a group
    would hold if it began at a row shows in the next ``max_group`` - 1 rows, so
    rows early in a slice are also shown to the slice before. Between slices
    travels the open group: how many rows it still takes (fewer than
    ``max_group``) and how many it has.
    """
    if slice_seconds <= max_gap:
        raise ValueError("slice_seconds must exceed max_gap")
    order, key = [epoch, *ties], key_of(keys)
    base = with_slice(df, keys, time_slice(F.col(epoch), slice_seconds))
    near = F.col(epoch) - F.col(SLICE) * slice_seconds <= max_gap
    own = F.struct(F.col(SLICE).alias("s"), F.lit(False).alias("ahead"))
    copy = F.struct((F.col(SLICE) - 1).alias("s"), F.lit(True).alias("ahead"))
    shown = (
        base.withColumn("__at", F.explode(F.when(near, F.array(own, copy)).otherwise(F.array(own))))
        .withColumn(SLICE, F.col("__at.s")).withColumn("__ahead", F.col("__at.ahead")).drop("__at")
    )
    w = Window.partitionBy(*key_of(keys), SLICE).orderBy(*order)
    size = F.lit(max_group)
    for i in range(max_group - 1, 0, -1):
        later = F.lead(epoch, i).over(w)
        size = F.when(later.isNull() | (later - F.col(epoch) > max_gap), F.lit(i)).otherwise(size)
    sized = (
        shown.withColumn("__size", size)
        .withColumn("__new", F.row_number().over(w) == 1)
        .withColumn("__end", F.coalesce(F.lead("__ahead").over(w), F.lit(True)))
        .filter(~F.col("__ahead")).drop("__ahead")
    )

    entries, columns = range(max_group), [c for c in sized.columns if c not in ("__new", "__size")]
    numbers = [f"__n{e}" for e in entries]

    def walk(batches: Batches) -> Batches:
        """Each row's number for every entry (rows the open group still takes), as minus its place while it is in that group; at a slice's end the state for every entry."""
        held = None  # per entry: rows still taken, rows in the group, whether it is the group that was open; rows so far
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            size, row = pdf["__size"].to_numpy(dtype=np.int64), np.arange(n)
            p = Pieces(pdf["__new"].to_numpy(dtype=bool))
            lo, hi, count = p.lo, p.hi, p.hi - p.lo
            steps = doubled(np.where(row + size < hi[p.of], row + size, n))
            final, place = last_reached(steps), row - lo[p.of]
            done = np.zeros(len(lo), dtype=np.int64)  # rows of the slice before this batch
            if p.goes_on:
                done[0] = held[3]
            out, states = {}, []
            for e in entries:
                left, taken, same = np.full(len(lo), e), np.zeros(len(lo), dtype=np.int64), np.ones(len(lo), dtype=bool)
                if p.goes_on:
                    left[0], taken[0], same[0] = held[0][e], held[1][e], held[2][e]
                first = lo + left
                inside = first < hi
                start = np.where(reached(steps, first[inside]), row, -1)
                np.maximum.accumulate(start, out=start)
                ahead = np.where(same[p.of], -(done[p.of] + place + 1), taken[p.of] + place + 1)
                out[numbers[e]] = np.where(start >= lo[p.of], row - start + 1, ahead)
                at = final[np.minimum(first, n - 1)]
                states.append((
                    np.where(inside, at + size[at] - hi, first - hi),
                    np.where(inside, hi - at, np.where(same, done + count, taken + count)), same & ~inside))
            held = ([s[0][-1] for s in states], [s[1][-1] for s in states], [s[2][-1] for s in states], done[-1] + count[-1])
            end = pdf["__end"].to_numpy(dtype=bool)
            for k, name in enumerate(("left", "taken", "whole")):
                per_piece = np.stack([s[k] for s in states], axis=1).tolist()
                out[name] = [per_piece[x] if e else None for x, e in zip(p.of.tolist(), end.tolist())]
            yield pdf[columns].assign(**out)

    def chain(batches: Batches) -> Batches:
        left = taken = 0
        for pdf in batches:
            states = []
            for new, lefts, takens, wholes in zip(pdf["__new"].tolist(), pdf["left"], pdf["taken"], pdf["whole"]):
                if new:
                    left = taken = 0
                states.append((left, taken))
                taken = int(takens[left]) + (taken if wholes[left] else 0)
                left = int(lefts[left])
            yield pdf[[*key, SLICE]].assign(__left=[s[0] for s in states], __taken=[s[1] for s in states])

    base_columns = [c for c in base.columns if c not in (KEY, SLICE)]
    longs, long = T.ArrayType(T.LongType()), T.LongType()
    # The rows are shuffled, sorted and walked once, and stored; choosing among their numbers needs the slices' states only.
    walked = materialize(sized.mapInPandas(walk, _fields(
        sized, columns, **dict.fromkeys(numbers, long), left=longs, taken=longs, whole=T.ArrayType(T.BooleanType()))), "walked")
    reduced = walked.filter("__end").select(*key, SLICE, "left", "taken", "whole")
    states = _by_slice(reduced, keys).mapInPandas(chain, _fields(walked, [*key, SLICE], __left=long, __taken=long))
    chosen = F.coalesce(*[F.when(F.col("__left") == e, F.col(c)) for e, c in enumerate(numbers)])
    numbered = walked.join(states, [*key, SLICE], "left").withColumn(out, chosen)
    return numbered.select(*base_columns, F.when(F.col(out) < 0, F.col("__taken") - F.col(out)).otherwise(F.col(out)).alias(out))


def spaced_picks(
    df: DataFrame, keys: list[str], epoch: str, ties: list[str], out: str = "picked",
    min_gap: int = 1800, slice_seconds: int = 86400,
) -> DataFrame:
    """Mark rows greedily: a row is picked when it lies more than ``min_gap``
    seconds after the last pick of its key; the first row always is.

    What an earlier slice leaves behind is the time of its last pick. It can only
    hold back rows in the first ``min_gap`` seconds of a slice, so a slice's
    summary is its distinct seconds up to there, each with the slice's last pick
    if the picking began at that second.
    """
    order, key = [epoch, *ties], key_of(keys)
    base = with_slice(df, keys, time_slice(F.col(epoch), slice_seconds))
    w = Window.partitionBy(*key_of(keys), SLICE).orderBy(*order)
    flagged = (
        base.withColumn("__t", F.col(epoch).cast("bigint"))
        .withColumn("__new", F.row_number().over(w) == 1)
        .withColumn("__end", F.lead(F.lit(1)).over(w).isNull())
    )

    def outcomes(t: np.ndarray) -> tuple[list[int], list[int]]:
        """The seconds of a slice in which its first pick may lie, and its last pick if it does."""
        following = np.searchsorted(t, t + min_gap, side="right")
        last = t[last_reached(doubled(following))]
        keep = int(np.searchsorted(t, t[0] - t[0] % slice_seconds + min_gap, side="left")) + 1
        return t[:keep].tolist(), last[:keep].tolist()

    def heads(batches: Batches) -> Batches:
        open_: list[np.ndarray] = []  # the different seconds of a slice that goes on, fewer than the slice is wide
        for pdf in batches:
            t, end = pdf["__t"].to_numpy(dtype=np.int64), pdf["__end"].to_numpy(dtype=bool)
            p, found = Pieces(pdf["__new"].to_numpy(dtype=bool)), []
            for k, (x, y) in enumerate(zip(p.lo.tolist(), p.hi.tolist())):
                own = np.unique(t[x:y])
                if k == 0 and p.goes_on:
                    own = np.unique(np.concatenate([*open_, own]))
                open_ = [own]
                if end[y - 1]:
                    found.append(outcomes(own))
            if not found:
                continue
            yield pdf.loc[pdf["__end"], [*key, SLICE]].assign(first=[x[0] for x in found], last=[x[1] for x in found])

    def chain(batches: Batches) -> Batches:
        held = None
        for pdf in batches:
            entries = []
            for new, first, last in zip(pdf["__new"].tolist(), pdf["first"], pdf["last"]):
                if new:
                    held = None
                entries.append(held)
                at = 0 if held is None else bisect_right(first, held + min_gap)
                if at < len(first):
                    held = int(last[at])
            yield pdf[[*key, SLICE]].assign(__held=pd.array(entries, dtype="Int64"))

    def pick(batches: Batches) -> Batches:
        free_after = None  # of the slice that goes on: no pick up to this second
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            t = pdf["__t"].to_numpy(dtype=np.int64)
            p = Pieces(pdf["__new"].to_numpy(dtype=bool))
            before = pdf["__held"].astype("Int64").iloc[p.lo]
            none = t.min() - min_gap - 1
            free = before.fillna(none).to_numpy(dtype=np.int64) + min_gap
            if p.goes_on:
                free[0] = none + min_gap if free_after is None else free_after
            # rows of a piece, then of the next one, on one ascending scale
            width = int(t.max() - t.min()) + min_gap + 2
            scale = t - t.min() + p.of * width
            following = np.minimum(np.searchsorted(scale, scale + min_gap, side="right"), n)
            following = np.where(following < p.hi[p.of], following, n)
            wanted = np.clip(free - t.min(), -1, width - 1) + np.arange(len(p.lo)) * width
            first = np.maximum(np.searchsorted(scale, wanted, side="right"), p.lo)
            picked = reached(doubled(following), first[first < p.hi])
            last = np.flatnonzero(picked[p.lo[-1] :])
            free_after = int(t[p.lo[-1] + last[-1]]) + min_gap if len(last) else int(free[-1])
            yield pdf[base_columns].assign(**{out: picked})

    base_columns = [c for c in base.columns if c != KEY]
    longs = T.ArrayType(T.LongType())
    reduced = flagged.select(*_at_end(keys), SLICE, "__new", "__end", "__t").mapInPandas(
        heads, _fields(flagged, [*key, SLICE], first=longs, last=longs))
    states = _by_slice(reduced, keys).mapInPandas(chain, _fields(flagged, [*key, SLICE], __held=T.LongType()))
    fed = flagged.join(states, [*key, SLICE], "left")
    ready = fed.select(*key, *base_columns, "__t", "__new", "__held").sortWithinPartitions(*key, SLICE, *order).drop(KEY)
    return ready.mapInPandas(pick, _fields(base, base_columns, **{out: T.BooleanType()})).drop(SLICE)
