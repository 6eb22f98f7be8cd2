"""Two time axes: the period that a fact is about, and the day it was filed.

A version is what was known about a period after one filing day. On any later day the row to use is that of the newest
period among the versions filed by then, in its latest version: a late correction of an old period must not hide a newer
period, and a correction that is not filed yet must not be seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .reshape import facts_to_wide
from .segments import ROWS_PER_SEGMENT, SEG, assign_segments

_T, _SIDE, _LEFT, _BEST = "__t", "__side", "__left", "__best"


def versions(
    facts: DataFrame, keys: Sequence[str], filed: str, metadata: Sequence[str], concept: str, value: str, concepts: Sequence[str], ties: Sequence[str] = (),
    together: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key and filing day: the metadata of that day's filing and all values known by then.

    A concept that a day's filing does not report keeps its value from before; a null value replaces nothing. Of several facts of one
    concept on a day the greatest ``ties`` win. Filing days of a key are bounded by the calendar. Facts are
    dealt once, by ``together`` (some of the keys, all by default), for the rows of a day, the values before and later steps over these keys.
    """
    known = facts.where(F.col(value).isNotNull())
    wide = facts_to_wide(known, [*keys, filed], metadata, concept, value, concepts, latest=[], ties=ties, together=keys if together is None else together)
    so_far = Window.partitionBy(*keys).orderBy(filed).rowsBetween(Window.unboundedPreceding, 0)
    return wide.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in concepts})


def as_known_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    filed: str,
    newest: Sequence[str],
    right_columns: Sequence[str] | None = None,
    prefix: str = "",
    rows_per_segment: int | None = ROWS_PER_SEGMENT,
    hot_rows: int | None = None,
) -> DataFrame:
    """Left-outer join with the right row that is greatest in ``newest``, then ``filed``, of those filed by ``left_ts``.

    Nulls count as smallest in ``newest``. Right rows without key or filing day are ignored, left rows always
    survive. Both sides are stacked and sorted once per key, and a running maximum carries the best row so
    far; hot keys are cut into segments, whose best rows are handed on through a table of one row per segment.
    ``rows_per_segment=None`` states that rows per key are bounded and skips the hot-key pass.
    """
    taken = list(right_columns) if right_columns is not None else [c for c in right.columns if c not in on]
    clash = [prefix + c for c in taken if prefix + c in left.columns]
    if clash:
        raise ValueError(f"columns on both sides, set a prefix: {', '.join(clash)}")
    payload = F.struct(*[F.col(c).alias(prefix + c) for c in taken])
    rank = F.struct(*[F.col(c).alias(f"n{i}") for i, c in enumerate(newest)], F.col(filed).alias("filed"), payload.alias("row"))
    known = right.dropna(subset=[*on, filed]).select(*on, F.col(filed).alias(_T), F.lit(0).alias(_SIDE), rank.alias(_BEST))
    rows = left.select(*on, F.col(left_ts).alias(_T), F.lit(1).alias(_SIDE), F.struct(*left.columns).alias(_LEFT))
    parts = list(on)
    if rows_per_segment is not None:
        # of one filing time only the best row can ever win: aggregated ahead of the shuffle
        known = known.groupBy(*on, _T, _SIDE).agg(F.max(_BEST).alias(_BEST))
    stacked = known.unionByName(rows, allowMissingColumns=True)
    arrival = [F.col(_T).asc_nulls_first(), F.col(_SIDE).asc()]
    if rows_per_segment is not None:
        # counted, sampled and dealt: what made both sides is worked out once
        stacked = assign_segments(cut_lineage(stacked), on, [*arrival, F.xxhash64(_LEFT)], rows_per_segment, hot_rows)
        parts = [*on, SEG]
    running = Window.partitionBy(*parts).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, 0)
    matched = stacked.withColumn(_BEST, F.max(_BEST).over(running)).where(F.col(_SIDE) == 1)
    if rows_per_segment is not None:
        earlier = Window.partitionBy(*on).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            stacked.where(F.col(SEG).isNotNull()).groupBy(*on, SEG).agg(F.max(_BEST).alias("r")).withColumn("__carried", F.max("r").over(earlier)).select(*on, SEG, "__carried")
        )
        matched = matched.join(carried, [*on, SEG], "left").withColumn(_BEST, F.greatest(_BEST, "__carried"))
    # a left row without a time sorts first and has seen nothing, but it may follow right rows of another segment
    hit = F.when(F.col(_T).isNotNull(), F.col(_BEST))
    return matched.withColumn(_BEST, hit).select(f"{_LEFT}.*", *[F.col(f"{_BEST}.row.{prefix + c}").alias(prefix + c) for c in taken])
