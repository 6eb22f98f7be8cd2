"""Folds over time: walk-forward and expanding splits, gaps, purged label horizons, a final holdout.

A fold is a pair of date ranges. Edges are places in the calendar of distinct dates, which is all that
reaches the driver; rows learn their folds from their own date, so no window runs over the panel and no
fold reads it again. A training row whose label looks into the test range of its fold is purged.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import series
from .metrics import classification_metrics
from .segments import over_series


@dataclass(frozen=True)
class Fold:
    """Date ranges of training and test rows; the ends are not part of them, None is open."""

    number: int
    train_from: dt.date
    train_until: dt.date
    test_from: dt.date
    test_until: dt.date | None


def calendar(df: DataFrame, date: str = "date") -> list[dt.date]:
    """The distinct dates in order; as many as the calendar has days, however many rows there are."""
    days = df.select(F.col(date).cast("date").alias("day")).where("day IS NOT NULL").distinct()
    return sorted(r["day"] for r in days.collect())


def _fold(number: int, days: Sequence[dt.date], train: tuple[int, int], test: tuple[int, int]) -> Fold:
    until = days[test[1]] if test[1] < len(days) else None
    return Fold(number, days[train[0]], days[train[1]], days[test[0]], until)


def walk_forward(
    days: Sequence[dt.date], first: int, span: int, window: int | None = None, gap: int = 0
) -> list[Fold]:
    """Folds that step through the calendar by ``span`` test dates, from date number ``first`` on.

    A fold trains on all earlier dates, or on the last ``window`` of them, less the ``gap`` dates
    before its test range. The last test range may be shorter. Folds without training dates are left out.
    """
    if span < 1 or gap < 0 or first < 1:
        raise ValueError("first and span count dates from 1, a gap is not negative")
    out: list[Fold] = []
    for start in range(first, len(days), span):
        end = start - gap
        begin = 0 if window is None else max(0, end - window)
        if end > begin:
            out.append(_fold(len(out) + 1, days, (begin, end), (start, start + span)))
    return out


def expanding_folds(days: Sequence[dt.date], splits: int = 5, gap: int = 0) -> list[Fold]:
    """``splits`` equal test ranges at the end of the calendar, each after all dates it trains on.

    The calendar is cut into ``splits + 1`` ranges of equally many dates, the first one larger by the rest.
    """
    size = len(days) // (splits + 1)
    first = len(days) - splits * size
    if size < 1 or first <= gap:
        raise ValueError(f"too few dates for {splits} folds with a gap of {gap}: {len(days)}")
    return walk_forward(days, first, size, gap=gap)


def holdout_start(days: Sequence[dt.date], months: int = 6) -> dt.date:
    """The first date of the last ``months`` months of the calendar."""
    last = days[-1]
    back = last.year * 12 + last.month - 1 - months
    year, month = divmod(back, 12)
    last_of_month = (dt.date(year + (month == 11), (month + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    edge = dt.date(year, month + 1, min(last.day, last_of_month))
    return next(d for d in days if d > edge)


def folds_and_holdout(
    days: Sequence[dt.date], splits: int = 5, gap: int = 5, months: int = 6
) -> tuple[list[Fold], Fold]:
    """Expanding folds over the dates before the last ``months`` months, and a fold that tests on those."""
    edge = holdout_start(days, months)
    known = [d for d in days if d < edge]
    folds = expanding_folds(known, splits, gap)
    # the last fold ends where the holdout begins
    folds[-1] = Fold(folds[-1].number, folds[-1].train_from, folds[-1].train_until, folds[-1].test_from, edge)
    return folds, Fold(splits + 1, known[0], known[len(known) - gap], edge, None) if gap else Fold(splits + 1, known[0], edge, edge, None)


def embargo_start(days: Sequence[dt.date], split: dt.date, gap: int) -> dt.date:
    """The ``gap``-th date before ``split``: training rows from it on are left out."""
    before = [d for d in days if d < split]
    if gap >= len(before):
        raise ValueError(f"a gap of {gap} dates leaves no training dates")
    return before[-gap] if gap else split


def gapped_split(df: DataFrame, split: dt.date, gap: int = 0, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """Training rows before the ``gap`` last dates ahead of ``split``, and test rows from ``split`` on."""
    edge = F.lit(embargo_start(calendar(df, date), split, gap) if gap else split)
    return df.where(F.col(date) < edge), df.where(F.col(date) >= F.lit(split))


def label_ends(bars: DataFrame, rows: int = 5, key: str = "ticker", date: str = "date", name: str = "label_end", rows_per_segment: int | None = None) -> DataFrame:
    """Adds the date that a label of ``rows`` bars ahead looks at; null where the series ends before."""

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn(name, series.shift(date, -rows, w))

    return over_series(bars, [key], [date], compute, ahead=rows, rows_per_segment=rows_per_segment)


def memberships(folds: Sequence[Fold], date: str = "date", label_end: str | None = None) -> Column:
    """Array of (fold, part) of a row, part being train, purged or test.

    A row trains in a fold if its date lies in the training range and, with ``label_end``, its label ends before the
    test range begins; else it is purged there. A row without a label end has no label and trains nowhere.
    """
    every = [F.struct(F.lit(f.number).alias("fold"), p.alias("part")) for f, p in zip(folds, _parts(folds, date, label_end))]
    return F.filter(F.array(*every), lambda m: m["part"].isNotNull())


def _parts(folds: Sequence[Fold], date: str, label_end: str | None) -> list[Column]:
    """A row's part in each fold, null for none: comparisons of dates with constants, which cost next to nothing."""
    day, end = F.col(date).cast("date"), F.col(label_end).cast("date") if label_end else None

    def part(f: Fold) -> Column:
        trains = (day >= F.lit(f.train_from)) & (day < F.lit(f.train_until))
        tests = day >= F.lit(f.test_from)
        if f.test_until is not None:
            tests = tests & (day < F.lit(f.test_until))
        if end is None:
            return F.when(trains, "train").when(tests, "test")
        return F.when(trains & (end < F.lit(f.test_from)), "train").when(trains, "purged").when(tests, "test")

    return [part(f) for f in folds]


def numbers_of(folds: Sequence[Fold], which: str, date: str = "date", label_end: str | None = None) -> Column:
    """Numbers of the folds that a row has this part in, as an array."""
    numbers = [F.when(p == which, F.lit(f.number)).otherwise(F.lit(None).cast("int")) for f, p in zip(folds, _parts(folds, date, label_end))]
    return F.array_compact(F.array(*numbers)) if folds else F.array().cast("array<int>")


def assign_folds(df: DataFrame, folds: Sequence[Fold], date: str = "date", label_end: str | None = None) -> DataFrame:
    """Rows once per fold they take part in, with the columns ``fold`` and ``part``; see :func:`memberships`."""
    clash = {"fold", "part"} & set(df.columns)
    if clash:
        raise ValueError(f"columns in the way: {', '.join(sorted(clash))}")
    if not folds:
        return df.limit(0).withColumns({"fold": F.lit(0), "part": F.lit("")})
    every = [F.struct(F.lit(f.number).alias("fold"), p.alias("part")) for f, p in zip(folds, _parts(folds, date, label_end))]
    return df.select("*", F.inline(F.array(*every))).where(F.col("part").isNotNull())


def fold_report(assigned: DataFrame, date: str = "date") -> DataFrame:
    """Per fold: rows of each part, and first and last dates of training and test rows."""
    is_part = {p: F.col("part") == p for p in ("train", "purged", "test")}
    day = F.col(date).cast("date")
    return assigned.groupBy("fold").agg(
        *[F.count_if(c).alias(f"{p}_rows") for p, c in is_part.items()],
        *[f(F.when(is_part[p], day)).alias(f"{name}_{p}") for p in ("train", "test") for name, f in (("first", F.min), ("last", F.max))],
    )


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """Classification metrics of the test predictions of every fold, in one pass over all folds."""
    return classification_metrics(predictions, ["fold"])


def overall_metrics(per_fold: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of every metric over the folds: metric, mean, deviation, folds."""
    values = [c for c in per_fold.columns if c != "fold"]
    tidy = per_fold.select("fold", *[F.col(c).cast("double").alias(c) for c in values]).unpivot(["fold"], values, "metric", "value")
    return tidy.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"), F.count("value").alias("folds"))
