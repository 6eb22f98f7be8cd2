"""Exact linear-interpolated quantiles of many columns without gathering a column in one place.

A pass counts the values of every column in equal ranges of their bit patterns, whose order is that of the
numbers. The range that holds a wanted rank is counted again in finer ranges, until it holds few enough
values to look at each, or a single value. What a task sends on is one counter per range, so a pass shuffles
as much as tasks and wanted ranks ask for, whatever the rows; only the ranges that hold a wanted rank
reach the driver. 10^8 rows take three passes, and no input more than seven. All columns and ranks
share each pass. Equal values are counted, so a value that makes up a third of a column costs nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import nan_to_null

GATHER_ROWS = 100_000
#: counters of a task, first over whole columns (most of them stay empty), then over the ranges of wanted ranks
_FIRST_COUNTERS, _COUNTERS = 1 << 22, 1 << 17
_BLOCK_ROWS = 1 << 17

Read = Callable[[pa.RecordBatch], Sequence[np.ndarray]]


@dataclass
class _Span:
    """Bit patterns of a column from ``lo`` to ``hi``, how many values are below, how many inside, and the wanted ranks inside."""

    column: int
    lo: int
    hi: int
    before: int
    rows: int
    ranks: list[int]
    shift: int = 0


def order_keys(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; both zeros are one, NaN must be left out."""
    bits = (x + 0.0).view(np.int64)
    return bits.view(np.uint64) ^ ((bits >> 63).view(np.uint64) | np.uint64(1 << 63))


def _value(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.uint64(bits).view(np.float64))


def ranked_values(df: DataFrame, read: Read, sizes: Sequence[int], ranks: Sequence[Sequence[int]], gather_rows: int = GATHER_ROWS) -> list[dict[int, float]]:
    """Per column the values at the wanted ranks (from 0) of its sorted values.

    ``read`` makes the columns, without regard to their lengths, from a batch of ``df``; null and NaN do not count.
    ``sizes`` is how many values they have in all. Ranges of at most ``gather_rows`` values are looked at value by value.
    """
    found: list[dict[int, float]] = [{} for _ in ranks]
    spans = [_Span(i, 0, (1 << 64) - 1, 0, sizes[i], sorted(set(wanted))) for i, wanted in enumerate(ranks) if wanted]
    counters = _FIRST_COUNTERS
    while spans:
        digits = min(16, max(1, (counters // len(spans)).bit_length() - 1))
        for s in spans:
            s.shift = 0 if s.rows <= gather_rows else max(0, (s.hi - s.lo).bit_length() - digits)
        again: list[_Span] = []
        for r in _hits(df, read, spans, gather_rows, digits):
            s, before = spans[r["slot"]], spans[r["slot"]].before + r["before"]
            own = [k for k in s.ranks if before <= k < before + r["n"]]
            lo = s.lo + ((r["digit"] + (1 << 63)) << s.shift)
            if s.shift == 0:
                found[s.column].update(dict.fromkeys(own, _value(lo)))
            else:
                again.append(_Span(s.column, lo, min(lo + (1 << s.shift) - 1, s.hi), before, r["n"], own))
        spans, counters = sorted(again, key=lambda s: (s.column, s.lo)), _COUNTERS
    return found


def _hits(df: DataFrame, read: Read, spans: Sequence[_Span], gather_rows: int, digits: int) -> list:
    """The ranges of every span that hold a wanted rank: their number (less 2^63), the values of the span below them and their own."""
    lows, highs, shifts = (np.array([getattr(s, name) for s in spans], np.uint64) for name in ("lo", "hi", "shift"))
    few = np.array([s.rows <= gather_rows for s in spans])
    slots = {i: [k for k, s in enumerate(spans) if s.column == i] for i in {s.column for s in spans}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {i: np.zeros(len(own) << digits, np.int64) for i, own in slots.items() if not few[own].all()}
        held: dict[int, list[np.ndarray]] = {k: [] for k in np.flatnonzero(few).tolist()}
        for block in blocks(batches):
            for i, x in enumerate(read(block)):
                if i not in slots:
                    continue
                first, last = slots[i][0], slots[i][-1] + 1
                keys = order_keys(x[~np.isnan(x)])
                place = np.zeros(len(keys), np.int64)
                if last - first > 1 or lows[first] or highs[first] != np.iinfo(np.uint64).max:
                    place = np.searchsorted(lows[first:last], keys, "right") - 1
                    own = (place >= 0) & (keys <= highs[first + place])
                    keys, place = keys[own], place[own]
                keys = (keys - lows[first + place]) >> shifts[first + place]
                sparse = few[first + place]
                for k in range(first, last):
                    if few[k] and (taken := keys[place == k - first]).size:
                        held[k].append(taken)
                if i in counts:
                    at = (place[~sparse] << digits) + keys[~sparse].astype(np.int64)
                    counts[i] += np.bincount(at, minlength=len(counts[i]))
        for i, c in counts.items():
            at = np.flatnonzero(c)
            yield _counted(slots[i][0] + (at >> digits), (at & ((1 << digits) - 1)).astype(np.uint64), c[at])
        for k, parts in held.items():
            if parts:
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield _counted(np.full(len(keys), k), keys, n)

    order = Window.partitionBy("slot").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    counted = df.mapInArrow(run, "slot long, digit long, n long").groupBy("slot", "digit").agg(F.sum("n").alias("n"))
    ranged = counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    wanted = F.get(F.array(*[F.array(*[F.lit(k - s.before).cast("bigint") for k in s.ranks]) for s in spans]), F.col("slot").cast("int"))
    return ranged.where(F.exists(wanted, lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))).collect()


def _counted(slot: np.ndarray, digit: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    signed = (digit ^ np.uint64(1 << 63)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(signed), pa.array(n.astype(np.int64))], ["slot", "digit", "n"])


def blocks(batches: Iterator[pa.RecordBatch], rows: int = _BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``rows`` rows, so that array operations have some length."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(map(len, kept)) >= rows:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept = []
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def wanted_ranks(size: int, probs: Sequence[float]) -> list[int]:
    """The neighbouring ranks of every quantile of ``size`` values."""
    return [k for p in probs for k in (math.floor(p * (size - 1)), math.ceil(p * (size - 1)))] if size else []


def interpolated(size: int, p: float, at: Callable[[int], float]) -> float | None:
    """The quantile from the values at its ranks; None without values."""
    if not size:
        return None
    place = p * (size - 1)
    k = math.floor(place)
    below, above = at(k), at(math.ceil(place))
    return below if place == k or below == above else below + (above - below) * (place - k)


def doubles(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Columns of doubles, null as nan."""
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], gather_rows: int = GATHER_ROWS
) -> Mapping[str, list[float | None]]:
    """Column name to its quantiles, nulls and NaN ignored; all None for a column without values."""
    if not columns:
        return {}
    df = df.select(*[nan_to_null(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    values = ranked_values(df, doubles, list(counts), [wanted_ranks(n, probs) for n in counts], gather_rows)
    return {c: [interpolated(n, p, v.__getitem__) for p in probs] for c, n, v in zip(columns, counts, values)}
