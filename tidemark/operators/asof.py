"""Backward as-of join: for each left row the last right row of the same key at or before its time.

Both sides are stacked and sorted once per key; a running ``last`` carries the newest right row
forward. One exchange, linear work, and no right row is ever repeated. Histories of hot keys are cut
into segments (:func:`tidemark.operators.segments.assign_segments`); the newest right row of each
segment is then handed on to later segments through a table with one row per segment. Of the right rows
of one key and time only the winner takes part, and left rows of one time are told apart by a hash, so
a segment stays small however many rows share an instant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import ROWS_PER_SEGMENT, SEG, assign_segments

_T, _SIDE, _LEFT, _RIGHT, _HIT = "__t", "__side", "__left", "__right", "__hit"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    ties: Sequence[str] = (),
    right_columns: Sequence[str] | None = None,
    prefix: str = "",
    rows_per_segment: int | None = ROWS_PER_SEGMENT,
    hot_rows: int | None = None,
) -> DataFrame:
    """Left-outer backward as-of join, equal times included.

    Of several right rows at one time the greatest in ``ties`` order wins, nulls counting as
    greatest. ``right_columns`` come back as ``prefix + name``; a clash with a left column is an
    error. Right rows without key or time are ignored; left rows always survive.
    ``rows_per_segment=None`` states that rows per key are bounded and skips the hot-key pass.
    """
    taken = list(right_columns) if right_columns is not None else [c for c in right.columns if c not in on]
    clash = [prefix + c for c in taken if prefix + c in left.columns]
    if clash:
        raise ValueError(f"columns on both sides, set a prefix: {', '.join(clash)}")

    left_time, right_time = dict(left.dtypes)[left_ts], dict(right.dtypes)[right_ts]
    if left_time != right_time:
        raise TypeError(f"{left_ts} is {left_time} but {right_ts} is {right_time}")

    tie_names = [f"__tie{i}" for i in range(len(ties))]
    payload = F.struct(*[F.col(c).alias(prefix + c) for c in taken])
    known = right.dropna(subset=[*on, right_ts]).select(
        *on,
        F.col(right_ts).alias(_T),
        F.lit(0).alias(_SIDE),
        *[F.col(c).alias(n) for c, n in zip(ties, tie_names)],
        payload.alias(_RIGHT),
    )
    rows = left.select(*on, F.col(left_ts).alias(_T), F.lit(1).alias(_SIDE), F.struct(*left.columns).alias(_LEFT))
    stacked = known.unionByName(rows, allowMissingColumns=True)

    arrival: list[Column] = [
        F.col(_T).asc_nulls_first(),
        F.col(_SIDE).asc(),
        *[F.col(n).asc_nulls_last() for n in tie_names],
    ]
    parts = list(on)
    if rows_per_segment is not None:
        # one winner per key and time: a group limit below the exchange
        latest = [F.col(n).desc_nulls_first() for n in tie_names]
        winner = Window.partitionBy(*on, _T).orderBy(*latest, F.xxhash64(_RIGHT))
        known = known.withColumn("__nth", F.row_number().over(winner)).where(F.col("__nth") == 1).drop("__nth")
        stacked = known.unionByName(rows, allowMissingColumns=True)
        stacked = assign_segments(stacked, on, [*arrival, F.xxhash64(_LEFT)], rows_per_segment, hot_rows)
        parts = [*on, SEG]

    running = Window.partitionBy(*parts).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, 0)
    matched = stacked.withColumn(_HIT, F.last(_RIGHT, ignorenulls=True).over(running)).where(F.col(_SIDE) == 1)

    if rows_per_segment is not None:
        newest = F.struct(
            F.col(_T).alias("t"),
            *[x for n in tie_names for x in (F.col(n).isNull().alias(n + "_null"), F.col(n).alias(n))],
        )
        earlier = Window.partitionBy(*on).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            stacked.where(F.col(SEG).isNotNull())
            .groupBy(*on, SEG)
            .agg(F.max_by(F.when(F.col(_SIDE) == 0, F.col(_RIGHT)), F.when(F.col(_SIDE) == 0, newest)).alias("r"))
            .withColumn("__carried", F.last("r", ignorenulls=True).over(earlier))
            .select(*on, SEG, "__carried")
        )
        matched = matched.join(carried, [*on, SEG], "left").withColumn(
            _HIT, F.when(F.col(_T).isNotNull(), F.coalesce(_HIT, "__carried"))
        )
    # keys as they were dealt, so that what follows per key needs no exchange
    kept = [F.col(c) if c in on else F.col(f"{_LEFT}.{c}") for c in left.columns]
    return matched.select(*kept, *[F.col(f"{_HIT}.{prefix + c}").alias(prefix + c) for c in taken])
