"""Long facts to one wide row per period, and wide price columns to long bars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import keep_earliest, keep_last


def _latest(columns: Sequence[str]) -> Column:
    """Sort key under which nulls count as greatest, as in an ascending sort with nulls last."""
    return F.struct(*[x for c in columns for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))])


def facts_to_wide(
    facts: DataFrame,
    keys: Sequence[str],
    metadata: Sequence[str],
    concept: str,
    value: str,
    concepts: Sequence[str],
    latest: Sequence[str],
    ties: Sequence[str] = (),
    owner: str | None = None,
    keep: str = "last",
    together: Sequence[str] = (),
) -> DataFrame:
    """One row per key: the newest metadata row and, per concept, the newest value.

    "Newest" is the greatest ``latest + ties`` within the concept, and ``latest`` then concept for
    the metadata. Superseded facts are dropped first, largely before the shuffle; the metadata
    choice, the pivot and the join between them are then one grouped aggregation over what is left.
    When ``owner`` is given, a value counts only if its row names the same owner as the metadata row.

    With ``keep="first"`` everything is as first reported: the value of the least ``latest``, the greatest
    ``ties`` deciding, and the metadata row of the least ``latest``, then concept.

    ``together`` names keys by which the result is partitioned, so that later steps over them need no exchange.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep is first or last, not {keep}")
    carried = [c for c in metadata if c not in keys]
    if keep == "last":
        newest = keep_last(facts, [*keys, concept], [*latest, *ties])
        meta = F.max_by(F.struct(*carried), _latest([*latest, concept])).alias("__meta")
    else:
        newest = keep_earliest(facts, [*keys, concept], latest, ties)
        meta = F.min_by(F.struct(*carried), _latest([*latest, concept])).alias("__meta")

    def of(name: str, held: str) -> Column:
        return F.max(F.when(F.col(concept) == name, F.col(held)))

    wide = (newest.repartition(*together) if together else newest).groupBy(*keys).agg(
        meta,
        *[of(c, value).alias(f"__v{i}") for i, c in enumerate(concepts)],
        *([of(c, owner).alias(f"__o{i}") for i, c in enumerate(concepts)] if owner else []),
    )

    def cell(i: int) -> Column:
        v = F.col(f"__v{i}")
        return F.when(F.col(f"__o{i}") == F.col(f"__meta.{owner}"), v) if owner else v

    ordered = [F.col(c) if c in keys else F.col(f"__meta.{c}").alias(c) for c in metadata]
    extra_keys = [F.col(k) for k in keys if k not in metadata]
    return wide.select(*extra_keys, *ordered, *[cell(i).alias(c) for i, c in enumerate(concepts)])


def pivot_concepts(facts: DataFrame, keys: Sequence[str], concept: str, value: str, concepts: Sequence[str]) -> DataFrame:
    """Pivot of facts that are already unique per key and concept; the names are given, never scanned for."""
    return facts.groupBy(*keys).pivot(concept, list(concepts)).agg(F.max(value))


def wide_prices_to_long(
    wide: DataFrame,
    fields: Mapping[str, str],
    date_column: str = "Date",
    separator: str = "|",
    single_ticker: str | None = None,
) -> DataFrame:
    """Columns named ``field|ticker`` become rows (ticker, date, one column per field).

    ``fields`` maps source field names to output names. The tickers are read from the column names,
    so each wide row is expanded in place, without a shuffle. A table of plain field columns takes
    ``single_ticker``. Rows without ``adj_close`` are dropped.
    """
    pairs = [c.split(separator, 1) for c in wide.columns if separator in c]
    tickers = sorted({t for f, t in pairs if f in fields})
    day = F.col(f"`{date_column}`").try_cast("date").alias("date")

    def number(name: str) -> Column:
        present = name in wide.columns
        c = F.col(f"`{name}`").try_cast("double") if present else F.lit(None).cast("double")
        return F.when(~F.isnan(c), c)

    if tickers:
        boxes = [
            F.struct(
                F.lit(t).alias("ticker"), *[number(f"{f}{separator}{t}").alias(o) for f, o in fields.items()]
            )
            for t in tickers
        ]
        long = wide.select(day, F.inline(F.array(*boxes)))
    elif single_ticker is not None:
        long = wide.select(day, F.lit(single_ticker).alias("ticker"), *[number(f).alias(o) for f, o in fields.items()])
    else:
        raise ValueError("no field|ticker columns and no single_ticker")
    return long.select("ticker", "date", *fields.values()).dropna(subset=["ticker", "date", "adj_close"])


def columns_to_rows(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)
