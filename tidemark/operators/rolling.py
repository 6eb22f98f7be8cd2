"""Counts over trailing stretches of time, on keys of any size.

The rows inside ``(t - window, t]`` are the rows up to ``t`` less those up to ``t - window``. Rows are first counted per
key and instant, so a burst is one row; running totals over the instants are cut for hot keys; and the two totals are
looked up by as-of joins. The work is linear in rows and instants, however many rows a window holds, and no row
is sent to the neighbours of its segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join
from .segments import ROWS_PER_SEGMENT, SEG, assign_segments

_N, _TOTAL, _START = "__n", "__total", "__start"


def running_totals(
    rows: DataFrame, on: Sequence[str], ts: str, value: str, name: str, rows_per_segment: int | None = ROWS_PER_SEGMENT, hot_rows: int | None = None
) -> DataFrame:
    """Keys, time and the running sum of ``value``; rows are one per key and time."""
    order = lambda *parts: Window.partitionBy(*on, *parts).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    if rows_per_segment is None:
        return rows.select(*on, ts, F.sum(value).over(order()).alias(name))
    split = assign_segments(rows.select(*on, ts, value), on, [F.col(ts)], rows_per_segment, hot_rows)
    earlier = Window.partitionBy(*on).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    # one row per segment
    before = split.where(F.col(SEG).isNotNull()).groupBy(*on, SEG).agg(F.sum(value).alias("s")).withColumn("__before", F.sum("s").over(earlier)).select(*on, SEG, "__before")
    inside = split.withColumn(_TOTAL, F.sum(value).over(order(SEG)))
    joined = inside.join(before, [*on, SEG], "left")
    return joined.select(*on, ts, (F.col(_TOTAL) + F.coalesce("__before", F.lit(0))).alias(name))


def trailing_counts(
    left: DataFrame,
    events: DataFrame,
    on: Sequence[str],
    left_ts: str,
    event_ts: str,
    days: float,
    name: str,
    rows_per_segment: int | None = ROWS_PER_SEGMENT,
    hot_rows: int | None = None,
) -> DataFrame:
    """``left`` with the number of events of its key in the ``days`` up to and including its time.

    An event exactly ``days`` earlier is not counted. Both times are dates, or both timestamps. Events without key or time do not
    count; a left row without key or time has a null count. ``rows_per_segment=None`` states that instants per key are
    bounded by the calendar, as with dates.
    """
    if name in left.columns:
        raise ValueError(f"column in the way: {name}")
    per_time = events.dropna(subset=[*on, event_ts]).groupBy(*on, F.col(event_ts).alias("__t")).agg(F.count(F.lit(1)).alias(_N))
    totals = running_totals(per_time, on, "__t", _N, _TOTAL, rows_per_segment, hot_rows)
    how = dict(right_columns=[_TOTAL], rows_per_segment=rows_per_segment, hot_rows=hot_rows)
    start = _back(F.col(left_ts), dict(left.dtypes)[left_ts], days)
    now = asof_join(left.withColumn(_START, start), totals, on, left_ts, "__t", prefix="now", **how)
    both = asof_join(now, totals, on, _START, "__t", prefix="then", **how)
    count = F.coalesce(f"now{_TOTAL}", F.lit(0)) - F.coalesce(f"then{_TOTAL}", F.lit(0))
    known = F.col(left_ts).isNotNull()
    for key in on:
        known = known & F.col(key).isNotNull()
    return both.select(*left.columns, F.when(known, count).alias(name))


def _back(ts: Column, kind: str, days: float) -> Column:
    if kind == "date":
        if days != int(days):
            raise ValueError("dates are counted in whole days")
        return F.date_sub(ts, int(days))
    return ts - F.make_dt_interval(secs=F.lit(days * 86_400).cast("decimal(18,6)"))
