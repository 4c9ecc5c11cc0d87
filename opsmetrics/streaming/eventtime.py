"""Keyed streams whose rows are worked on in the order of event time, whatever the order in which they arrive.

A key's rows wait in the state until the watermark has passed them; then they leave it in time order and move the key's
fold on. So several files may land in any order within ``lateness``: the result is that of the batch operators. Rows
behind the watermark are dropped by Spark, which counts them (``run_counted`` reports the number).

Keys share ``GROUPS`` state rows, by their hash: a micro-batch calls Python once for a group, not once for a key, so the
fixed cost of a call does not grow with the number of keys. Rows and folds within a group are kept apart by key. A stream
that goes on from a checkpoint needs the number of groups it began with, and this form of its state.

A few keys may own all rows. So waiting rows are compressed and lie in the order of time, in blocks: a call sorts what has
come in runs of ``RUN`` rows, merges these with what waits, and folds and returns what the watermark has passed block by
block. It thus holds ``RUN`` rows, and a few blocks, as rows; of the others, compressed bytes.

State is bounded: waiting rows span ``lateness``, the fold is a few numbers, and a key's fold is given up as soon as it
can no longer change a later row, or after ``ttl`` seconds of silence, which the folds treat as a new beginning.

Rows at or after ``END`` only move the clock: one of them, landing last, releases all that still waits. Rows without a
time have no place in the order and are left out.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupStateTimeout

END = "9000-01-01 00:00:00"
MS, KEY, GROUP, NULLS = "__ms", "__key", "__group", "__nulls"
GROUPS = 512
RUN, BLOCK = 1 << 20, 1 << 14  # rows that are sorted at once, and rows of a block

Fold = Callable[[Iterable[tuple], tuple], tuple[list[tuple], tuple]]


def clocked(df: DataFrame, ts: str, lateness: str) -> DataFrame:
    """``df`` with a watermark on ``ts``; rows that only move the clock have done so and are gone."""
    # the test is on the event time itself, so that it stays above the watermark
    return df.withWatermark(ts, lateness).filter(F.col(ts) < F.lit(END).cast("timestamp"))


def _packed(rows: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, rows.schema) as writer:
        writer.write_table(rows)
    return out.getvalue()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def _row_schema(fields: list[T.StructField]) -> pa.Schema:
    """Arrow types of rows that come as pandas frames, where times have no zone."""
    times = (T.TimestampType, T.TimestampNTZType)
    return pa.schema([(f.name, pa.timestamp("ns") if isinstance(f.dataType, times) else to_arrow_type(f.dataType)) for f in fields])


class _Run:
    """Compressed rows in the order of time, written and read block by block."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.out, self.first = schema, io.BytesIO(), None
        self.writer = None

    def add(self, rows: pa.Table) -> None:
        if self.writer is None:
            self.writer = pa.ipc.new_stream(self.out, self.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            self.first = rows[MS][0].as_py()
        self.writer.write_table(rows, max_chunksize=BLOCK)

    def data(self) -> bytes:
        if self.writer is None:
            return b""
        self.writer.close()
        return self.out.getvalue()


def _blocks(run: bytes) -> Iterator[pa.Table]:
    for batch in pa.ipc.open_stream(pa.py_buffer(run)):
        yield pa.Table.from_batches([batch])


def _in_time(rows: pa.Table) -> pa.Table:
    return rows.take(pa.array(np.argsort(rows[MS].to_numpy(), kind="stable")))


def _runs(chunks: Iterable[pd.DataFrame], schema: pa.Schema) -> Iterator[Iterator[pa.Table]]:
    """The rows as runs in the order of time, of about ``RUN`` rows; all but the last are compressed."""
    held, n = [], 0
    for chunk in chunks:
        if len(chunk):
            held.append(pa.Table.from_pandas(chunk[schema.names], schema=schema, preserve_index=False))
            n += len(chunk)
        if n >= RUN:
            full = _Run(schema)
            full.add(_in_time(pa.concat_tables(held)))
            held, n = [], 0
            yield _blocks(full.data())
    if held:
        last = _in_time(pa.concat_tables(held))
        yield (last.slice(k, BLOCK) for k in range(0, n, BLOCK))


def _merged(runs: list[Iterator[pa.Table]]) -> Iterator[pa.Table]:
    """The rows of all runs in blocks of ascending times; the rows of one time are in one block, in no order within it."""
    held: list[pa.Table | None] = [next(run, None) for run in runs]
    going = [rows is not None for rows in held]
    while any(going):
        for i, run in enumerate(runs):
            if going[i] and not len(held[i]):
                rows = next(run, None)
                held[i], going[i] = (rows, True) if rows is not None else (held[i], False)
        ends = [held[i][MS][-1].as_py() if on else None for i, on in enumerate(going)]
        if not any(going):
            break
        cut, parts = min(e for e in ends if e is not None), []
        for i, rows in enumerate(held):
            if rows is not None and len(rows):
                at = int(np.searchsorted(rows[MS].to_numpy(), cut))
                if at:
                    parts.append(rows.slice(0, at))
                    held[i] = rows.slice(at)
        if parts:
            yield pa.concat_tables(parts)
            continue
        for i, run in enumerate(runs):  # a time may go on in the next block
            if ends[i] == cut:
                rows = next(run, None)
                if rows is None:
                    going[i] = False
                else:
                    held[i] = pa.concat_tables([held[i], rows])
    rest = [rows for rows in held if rows is not None and len(rows)]
    if rest:
        yield pa.concat_tables(rest)


def _key_text(fields: list[T.StructField]) -> Column:
    """One text for the values of the key columns; null is a value like others."""
    return F.to_json(F.array(*[F.hex(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name).cast("string") for f in fields]))


def _sorted(rows: pd.DataFrame, order: list[str], bits: dict[str, int]) -> tuple[pd.DataFrame, list[int]]:
    """(``rows`` key by key, each in the order of time and ``order``, nulls last; where each key begins, and the end)."""
    by = []
    for c in reversed(order):
        values = rows[c]
        if values.dtype == object:
            rank = pd.factorize(values, sort=True)[0]
            by.append(np.where(rank < 0, len(rank), rank))
        else:
            by.append(values.to_numpy())
        if c in bits:
            by.append(rows[NULLS].to_numpy() & bits[c])
    codes = pd.factorize(rows[KEY])[0]
    at = np.lexsort([*by, rows[MS].to_numpy(), codes])
    return rows.iloc[at], [0, *(np.flatnonzero(np.diff(codes[at])) + 1).tolist(), len(at)]


def _values(rows: pd.DataFrame, column: str, bits: dict[str, int]) -> list:
    values = rows[column].tolist()
    if column in bits:
        for i in np.flatnonzero(rows[NULLS].to_numpy() & bits[column]).tolist():
            values[i] = None
    return values


def in_event_order(
    df: DataFrame, keys: list[str], ts: str, order: list[str], reads: list[str], out: dict[str, T.DataType], state: list[str],
    fold: Fold, start: tuple, expiry: Callable[[tuple, int], int | None], lateness: str = "10 minutes",
) -> DataFrame:
    """Run ``fold(rows in order, state)`` over each key's rows as the watermark passes them; rows are tuples of ``reads``.

    A fold returns a tuple of ``out`` for each row, and the state it leaves, whose parts ``state`` names. ``order`` breaks
    ties of ``ts``. ``expiry(state, time of the last row)`` is the time in milliseconds from which the state has no
    influence any more, None if it always has.
    """
    fields, names = df.schema.fields, df.columns
    # whole numbers stay whole beside nulls: a null travels as 0 and a bit
    bits = {f.name: 1 << i for i, f in enumerate(f for f in fields if isinstance(f.dataType, T.IntegralType))}
    nulls = F.lit(0).cast("bigint")
    for name, bit in bits.items():
        nulls = nulls + F.when(F.col(name).isNull(), F.lit(bit)).otherwise(F.lit(0))
    plain = [F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name) if f.name in bits else F.col(f.name) for f in fields]
    placed = clocked(df, ts, lateness).withColumn(KEY, _key_text([df.schema[k] for k in keys]))
    placed = placed.select(*plain, nulls.alias(NULLS), KEY, F.unix_millis(F.col(ts)).alias(MS), F.pmod(F.xxhash64(KEY), F.lit(GROUPS)).alias(GROUP))
    schema = _row_schema([f for f in placed.schema if f.name != GROUP])

    def step(_, chunks: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        waiting, kept = held.get if held.exists else (b"", b"")
        folds = {key: (last, tuple(own)) for key, last, *own in zip(*_unpacked(kept).to_pydict().values())} if kept else {}
        mark, rest = held.getCurrentWatermarkMs(), _Run(schema)
        for block in _merged([*([_blocks(waiting)] if waiting else []), *_runs(chunks, schema)]):
            passed = block[MS].to_numpy() <= mark
            if not passed.all():
                rest.add(_in_time(block.filter(pa.array(~passed))))
            if not passed.any():
                continue
            ready, begins = _sorted(block.filter(pa.array(passed)).to_pandas(), order, bits)
            wanted, times = list(zip(*(_values(ready, c, bits) for c in reads))), ready[MS].tolist()
            results = []
            for lo, hi in zip(begins, begins[1:]):
                key = ready[KEY].iat[lo]
                found, own = fold(wanted[lo:hi], folds[key][1] if key in folds else start)
                results.extend(found)
                folds[key] = times[hi - 1], own
            columns = {n: pd.Series(v, index=ready.index, dtype="float64" if isinstance(t, T.DoubleType) else None)
                       for (n, t), v in zip(out.items(), zip(*results))}
            yield ready[[*names, NULLS]].assign(**columns)
        ends = {key: expiry(own, last) for key, (last, own) in folds.items()}
        folds = {key: f for key, f in folds.items() if ends[key] is None or ends[key] > mark}
        wakes = [ends[key] for key in folds if ends[key] is not None]
        waiting = rest.data()
        if waiting:
            wakes.append(rest.first)
        if not waiting and not folds:
            if held.exists:
                held.remove()
            return
        parts = zip(*((key, last, *own) for key, (last, own) in folds.items()))
        held.update((waiting, _packed(pa.table(dict(zip((KEY, MS, *state), map(list, parts))))) if folds else b""))
        if wakes:
            held.setTimeoutTimestamp(min(wakes))

    result_schema = T.StructType([*fields, T.StructField(NULLS, T.LongType()), *(T.StructField(n, t) for n, t in out.items())])
    state_schema = T.StructType([T.StructField("waiting", T.BinaryType()), T.StructField("folds", T.BinaryType())])
    folded = placed.groupBy(GROUP).applyInPandasWithState(step, result_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
    back = [F.when(F.col(NULLS).bitwiseAND(F.lit(bits[n])) == 0, F.col(n)).alias(n) if n in bits else F.col(n) for n in names]
    return folded.select(*back, *out)


def _after(last: int, ttl: int | None) -> int | None:
    return None if ttl is None else last + ttl * 1000


def burst_numbers(
    df: DataFrame, keys: list[str], ts: str, epoch: str, ties: list[str], out: str = "buffer", max_gap: int = 15, max_group: int = 4,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Burst numbering; the state is the group's first second and its size, until a later row must open a new group.

    ``epoch`` are the seconds of ``ts``.
    """
    def fold(rows: Iterable[tuple], state: tuple):
        anchor, size = state
        numbers = []
        for t, in rows:
            if size and size < max_group and abs(t - anchor) <= max_gap:
                size += 1
            else:
                anchor, size = t, 1
            numbers.append((size,))
        return numbers, (anchor, size)

    return in_event_order(
        df, keys, ts, ties, [epoch], {out: T.LongType()}, ["anchor", "size"], fold, (0, 0),
        lambda state, last: (state[0] + max_gap + 1) * 1000, lateness)


def failure_fires(
    df: DataFrame, keys: list[str], ts: str, epoch: str, ties: list[str], failed: str, n: int = 5, suppress_secs: int = 1800,
    ttl: int | None = None, lateness: str = "10 minutes",
) -> DataFrame:
    """Health-check state machine: ``losecount`` (1..n, 0 after a success), ``fired`` and ``acted``.

    The state is the failure count and the time of the last action. Without failures it goes once an action no longer
    holds the next one back; with ``ttl``, a key silent for longer begins anew.
    """
    def fold(rows: Iterable[tuple], state: tuple):
        count, acted_at, before = state
        found = []
        for t, bad in rows:
            if ttl is not None and before >= 0 and t - before > ttl:
                count, acted_at = 0, -1
            before = t
            count = count + 1 if bad else 0
            fire = count == n
            act = fire and (acted_at < 0 or t > acted_at + suppress_secs)
            found.append((count, fire, act))
            if act:
                acted_at = t
            if fire:
                count = 0
        return found, (count, acted_at, before)

    def expiry(state: tuple, last: int) -> int | None:
        count, acted_at, _ = state
        idle = 0 if acted_at < 0 else (acted_at + suppress_secs + 1) * 1000
        silent = None if ttl is None else last + (ttl + 1) * 1000
        if count == 0:
            return idle if silent is None else min(idle, silent)
        return silent

    long, flag = T.LongType(), T.BooleanType()
    return in_event_order(
        df, keys, ts, ties, [epoch, failed], {"losecount": long, "fired": flag, "acted": flag}, ["count", "acted_at", "before"],
        fold, (0, -1, -1), expiry, lateness)


def rates(
    df: DataFrame, keys: list[str], ts: str, epoch: str, ties: list[str], counter: str, ttl: int | None = None, lateness: str = "10 minutes",
) -> DataFrame:
    """Counter to rate per second since the key's previous sample; none for a first sample, nor after more than ``ttl`` seconds."""
    def fold(rows: Iterable[tuple], state: tuple):
        last_t, last_c, seen = state
        found = []
        for t, c in rows:
            gap = t - last_t
            known = seen and c is not None and last_c is not None
            found.append(((c - last_c) / gap if known and gap > 0 and (ttl is None or gap <= ttl) else None,))
            last_t, last_c, seen = t, c, True
        return found, (last_t, last_c, seen)

    return in_event_order(
        df, keys, ts, ties, [epoch, counter], {"rate": T.DoubleType()}, ["t", "c", "seen"], fold, (0, 0, False),
        lambda state, last: None if ttl is None else last + (ttl + 1) * 1000, lateness)


def minute_counts(df: DataFrame, keys: list[str], ts: str, lateness: str = "10 minutes") -> DataFrame:
    """Rows per key and minute: (keys, ts, ts_min, rate), each once, when the watermark has passed the minute."""
    counted = clocked(df, ts, lateness).groupBy(*keys, F.window(ts, "1 minute")).agg(F.count("*").alias("rate"))
    start = F.col("window.start")
    return counted.select(*keys, start.alias(ts), F.floor(F.unix_seconds(start) / 60).cast("bigint").alias("ts_min"), "rate")


def sampled_minutes(counts: DataFrame, every: int = 12, back: int = 8) -> DataFrame:
    """The minutes a watch looks at that samples every ``every`` minutes and looks ``back`` minutes behind."""
    return counts.filter(F.pmod(F.col("ts_min") + back, F.lit(every)) == 0)


def saturation(
    samples: DataFrame, keys: list[str], ts: str, every: int = 12, lateness: str = "10 minutes",
) -> DataFrame:
    """Three samples in a row without growth, over the sampled minutes of ``minute_counts``; a sample without rows counts 0.

    The state is the last two rates and their minute, until both have counted as 0.
    """
    def fold(rows: Iterable[tuple], state: tuple):
        minute, prev1, prev2 = state
        flags = []
        for m, rate in rows:
            missed = (m - minute) // every - 1 if minute >= 0 else 2
            if missed:
                prev1, prev2 = 0, prev1 if missed == 1 else 0
            flags.append((prev2 >= prev1 and prev2 >= rate,))
            minute, prev1, prev2 = m, rate, prev1
        return flags, (minute, prev1, prev2)

    return in_event_order(
        samples, keys, ts, [], ["ts_min", "rate"], {"saturated": T.BooleanType()}, ["minute", "prev1", "prev2"], fold, (-1, 0, 0),
        lambda state, last: (state[0] + 3 * every) * 60_000, lateness)
