"""Windows over time-ordered series in which one key may hold a large share of all rows.

A plain ``Window.partitionBy(key)`` sorts a key's whole history in one task. Where rows per key are
bounded (one row per key and calendar day) that is the cheapest plan. Where they are not, the rows of
*hot* keys are dealt by ranges of key and order, so that a long history is cut into segments of roughly
``rows_per_segment`` rows wherever its rows lie. Windows run per (key, segment), and each segment
receives the few neighbouring rows its frames reach into (a halo). Results equal those of the plain
window.

The ranges come from Spark's own sample of the complete order, all its columns included: bursts, outliers
and long common prefixes of texts do not matter. A null key is a key like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import cut_lineage

ROWS_PER_SEGMENT = 4_000_000
SEG = "__seg"
_HALO = "__halo"


def assign_segments(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows_per_segment: int = ROWS_PER_SEGMENT, hot_rows: int | None = None
) -> DataFrame:
    """Add ``__seg``: null for keys that are not hot, else a number that never falls in ``order``.

    A key is hot with more than ``hot_rows`` rows (default: ``rows_per_segment``). Rows that agree in the
    whole order stay together, so ``order`` should tell rows apart.

    ``df`` is read once for the counts and once more if there are hot keys, whose rows are written to the
    checkpoint folder with their segments. Write an expensive input to a table first.
    """
    limit = rows_per_segment if hot_rows is None else hot_rows
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    heavy = sizes.where(F.col("__n") > limit)
    found = sizes.agg(F.sum("__n").alias("rows"), F.sum(F.when(F.col("__n") > limit, F.col("__n"))).alias("hot")).first()
    total = found["hot"]
    if not total:
        return df.withColumn(SEG, F.lit(None).cast("bigint"))

    def cut(rows: DataFrame) -> DataFrame:
        dealt = rows.repartitionByRange(math.ceil(total / rows_per_segment), *keys, *order)
        return cut_lineage(dealt.withColumn(SEG, F.spark_partition_id().cast("bigint")))

    if total == found["rows"]:  # no cold key to tell apart, so no join and no second reading
        return cut(df)
    names = {k: f"__key{i}" for i, k in enumerate(keys)}
    known = heavy.select(*[F.col(k).alias(n) for k, n in names.items()], F.lit(True).alias("__hot"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    flagged = df.join(known, same, "left").drop(*names.values())
    cold = flagged.where(F.col("__hot").isNull()).withColumn(SEG, F.lit(None).cast("bigint"))
    return cold.unionByName(cut(flagged.where(F.col("__hot")))).drop("__hot")


def _halo_rows(
    hot: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, ahead: bool
) -> DataFrame:
    """For each segment of a hot key: the ``rows`` rows before it (after it when ``ahead``)."""
    if ahead:
        edge_order = [F.col(c).asc_nulls_first() for c in order]
        reach = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(1, rows)
    else:
        edge_order = [F.col(c).desc_nulls_last() for c in order]
        reach = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(-rows, -1)
    nth = Window.partitionBy(*keys, SEG).orderBy(*edge_order)
    payload = [c for c in hot.columns if c not in (*keys, SEG)]
    edge = (
        hot.withColumn("__nth", F.row_number().over(nth))
        .where(F.col("__nth") <= rows)  # becomes a group limit ahead of the shuffle
        .groupBy(*keys, SEG)
        .agg(F.sort_array(F.collect_list(F.struct("__nth", F.struct(*payload).alias("row")))).alias("edge"))
    )
    if not ahead:
        edge = edge.withColumn("edge", F.reverse("edge"))
    near = F.flatten(F.collect_list("edge").over(reach))
    kept = F.slice("near", 1, rows) if ahead else F.slice(
        "near", F.greatest(F.size("near") - rows, F.lit(0)) + 1, rows
    )
    return (
        edge.withColumn("near", near)
        .select(*keys, SEG, F.explode(kept).alias("item"))
        .select(*keys, SEG, "item.row.*")
    )


def over_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int = 0,
    ahead: int = 0,
    rows_per_segment: int | None = ROWS_PER_SEGMENT,
    hot_rows: int | None = None,
) -> DataFrame:
    """Run ``compute(df, window)`` on each key's ordered series.

    ``back`` and ``ahead`` are the most rows any expression reaches from the current row, over all
    chained steps. ``order`` must identify a row within its key; its first column is the time axis,
    the others decide within one instant.
    ``rows_per_segment=None`` states that rows per key are bounded, and uses plain windows.
    ``compute`` must keep the key and order columns and must not drop rows.
    """
    if rows_per_segment is None:
        return compute(df, Window.partitionBy(*keys).orderBy(*order))
    split = assign_segments(df, keys, [F.col(c) for c in order], rows_per_segment, hot_rows)
    hot = split.where(F.col(SEG).isNotNull())
    rows = split.withColumn(_HALO, F.lit(False))
    for reach, is_ahead in ((back, False), (ahead, True)):
        if reach:
            halo = _halo_rows(hot, keys, order, reach, is_ahead).withColumn(_HALO, F.lit(True))
            rows = rows.unionByName(halo)
    done = compute(rows, Window.partitionBy(*keys, SEG).orderBy(*order))
    return done.where(~F.col(_HALO)).drop(_HALO, SEG)
