"""Row-offset and trailing-window expressions over an ordered window.

Each function takes the window to work over, so the same formula serves a plain per-key window and
the split windows of :mod:`tidemark.operators.segments`. A trailing frame of ``n`` rows yields a
value only when it holds ``n`` non-null inputs.

Spark evaluates a window function once per mention, so formulas that use one several times bind it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from .scalars import as_col, bind, safe_divide


def shift(value: Column | str, rows: int, w: WindowSpec) -> Column:
    """Value ``rows`` earlier; a negative count looks ahead."""
    c = as_col(value)
    return F.lag(c, rows).over(w) if rows >= 0 else F.lead(c, -rows).over(w)


def diff(value: Column | str, w: WindowSpec) -> Column:
    return as_col(value) - shift(value, 1, w)


def pct_return(value: Column | str, rows: int, w: WindowSpec) -> Column:
    """Relative change against the value ``rows`` earlier."""
    c = as_col(value)
    return bind(shift(value, rows, w), lambda prior: safe_divide(c, prior)) - 1.0


def forward_return(value: Column | str, rows: int, w: WindowSpec) -> Column:
    """Return to the value ``rows`` ahead. A zero base gives a signed infinity, as plain doubles do."""
    c = as_col(value)
    return bind(
        shift(value, -rows, w),
        lambda ahead: F.when(c != 0, F.try_divide(ahead, c) - 1.0)
        .when(ahead > 0, F.lit(float("inf")))
        .when(ahead < 0, F.lit(float("-inf"))),
    )


def growth(value: Column | str, rows: int, w: WindowSpec) -> Column:
    c = as_col(value)
    return bind(shift(value, rows, w), lambda prior: growth_from(c, prior))


def growth_from(value: Column | str, prior: Column | str) -> Column:
    return safe_divide(as_col(value) - as_col(prior), prior)


def average_balance(value: Column | str, w: WindowSpec) -> Column:
    return (as_col(value) + shift(value, 1, w)) / 2.0


def trailing(value: Column | str, rows: int, w: WindowSpec, aggregate: Callable[[Column], Column]) -> Column:
    c = as_col(value)
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(c).over(frame) == rows, aggregate(c).over(frame))


def trailing_mean(value: Column | str, rows: int, w: WindowSpec) -> Column:
    return trailing(value, rows, w, F.avg)


def trailing_std(value: Column | str, rows: int, w: WindowSpec) -> Column:
    return trailing(value, rows, w, F.stddev_samp)


def ratio_to_trailing_mean(value: Column | str, rows: int, w: WindowSpec) -> Column:
    c = as_col(value)
    return bind(trailing_mean(value, rows, w), lambda mean: safe_divide(c, mean))


def trailing_zscore(value: Column | str, rows: int, w: WindowSpec) -> Column:
    c = as_col(value)
    moments = F.struct(trailing_mean(value, rows, w).alias("mean"), trailing_std(value, rows, w).alias("std"))
    return bind(moments, lambda m: safe_divide(c - m["mean"], m["std"]))


def gain(change: Column | str) -> Column:
    """Positive part of a change; null stays null."""
    c = as_col(change)
    return F.when(c > 0, c).when(c.isNotNull(), F.lit(0.0))


def loss(change: Column | str) -> Column:
    """Size of the negative part of a change; null stays null."""
    c = as_col(change)
    return F.when(c < 0, -c).when(c.isNotNull(), F.lit(0.0))


def rsi(change: Column | str, rows: int, w: WindowSpec) -> Column:
    """Relative strength index with simple means; null while there has been no loss in the frame."""
    means = F.struct(
        trailing_mean(gain(change), rows, w).alias("up"), trailing_mean(loss(change), rows, w).alias("down")
    )
    return bind(means, lambda m: rsi_from(m["up"], m["down"]))


def rsi_from(mean_gain: Column | str, mean_loss: Column | str) -> Column:
    return F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + safe_divide(mean_gain, mean_loss))
