"""Keep-one dedup with an explicit total order, exact dedup, resume by key, and removal counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keep(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    # the rank filter is pushed below the shuffle as a group limit: a hot key leaves each map task as one row
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") == 1).drop("__rank")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the greatest ``order`` per key; nulls sort last, so a null counts as greatest."""
    return _keep(df, keys, [F.col(c).desc_nulls_first() for c in order])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the least ``order`` per key."""
    return _keep(df, keys, [F.col(c).asc_nulls_last() for c in order])


def keep_earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Row with the least ``order`` per key, nulls last; of equal ones the one with the greatest ``ties``."""
    return _keep(df, keys, [*[F.col(c).asc_nulls_last() for c in order], *[F.col(c).desc_nulls_first() for c in ties]])


def drop_exact_duplicates(df: DataFrame, lineage: str | None = None) -> DataFrame:
    """One of each distinct row. ``lineage`` is left out of the comparison and keeps its least value."""
    if lineage is None:
        return df.dropDuplicates()
    columns = [c for c in df.columns if c != lineage]
    return df.groupBy(*columns).agg(F.min(lineage).alias(lineage))


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: total rows, distinct keys, rows a keep-one dedup on ``keys`` would remove."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
            F.count(F.lit(1)).alias("kept_rows"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed_rows"),
        )
    )


def new_only(candidates: DataFrame, existing: DataFrame, keys: Sequence[str], rescore: bool = False) -> DataFrame:
    """Candidates whose key is not in ``existing`` yet; all of them with ``rescore``."""
    if rescore:
        return candidates
    return candidates.join(existing.select(*keys).dropna().distinct(), list(keys), "left_anti")


def append_new(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Existing rows plus new ones; on a shared key the existing row stays."""
    both = existing.withColumn("__origin", F.lit(0)).unionByName(
        new.withColumn("__origin", F.lit(1)), allowMissingColumns=True
    )
    return keep_first(both, keys, ["__origin", *order]).drop("__origin")
