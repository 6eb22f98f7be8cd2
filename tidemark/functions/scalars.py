"""Null-aware scalar expressions. Every function maps Columns to a Column and stays in the JVM.

All but :func:`bind`, whose lambda is evaluated by the interpreter, stay in generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")
# Unicode white space and the four information separators, as characters.
WS_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def nan_to_null(value: Column | str) -> Column:
    c = as_col(value)
    return F.when(~F.isnan(c), c)


def is_finite(value: Column | str) -> Column:
    c = as_col(value)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(_INF))


def safe_divide(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient, null when the denominator is null, zero, NaN or infinite."""
    n, d = as_col(numerator).cast("double"), as_col(denominator).cast("double")
    return F.when(is_finite(d) & (d != 0), F.try_divide(n, d))


def clip(value: Column | str, lower: Column | float | None = None, upper: Column | float | None = None) -> Column:
    """Clamp to bounds. Null stays null and a null bound does not clamp, unlike ``least``/``greatest``."""
    c = as_col(value)
    branch = None
    for bound, breaks in ((lower, lambda b: c < b), (upper, lambda b: c > b)):
        if bound is None:
            continue
        b = bound if isinstance(bound, Column) else F.lit(bound)
        branch = F.when(breaks(b), b) if branch is None else branch.when(breaks(b), b)
    return c if branch is None else branch.otherwise(c)


def indicator(condition: Column) -> Column:
    """0/1 as bigint; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("bigint")


def binary_label(forward_return: Column | str) -> Column:
    """1 for a positive forward return, 0 otherwise, null while the return is unknown."""
    r = as_col(forward_return)
    return F.when(r.isNotNull(), (r > 0).cast("int"))


def softmax(*logits: Column) -> list[Column]:
    """Softmax over columns, shifted by the largest logit for numeric stability."""
    top = F.greatest(*logits)
    powers = [F.exp(x - top) for x in logits]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def net_score(positive: Column | str, negative: Column | str) -> Column:
    return as_col(positive) - as_col(negative)


def dominant_class(positive: Column | str, negative: Column | str, neutral: Column | str) -> Column:
    """Class with the highest probability; ties go to positive, then negative."""
    p, n, u = as_col(positive), as_col(negative), as_col(neutral)
    return (
        F.when(p.isNull() | n.isNull() | u.isNull(), F.lit(None).cast("string"))
        .when((p >= n) & (p >= u), "positive")
        .when((n >= p) & (n >= u), "negative")
        .otherwise("neutral")
    )


def pad_id(value: Column | str, width: int = 10) -> Column:
    """Left-pad an identifier, without white space around it, with zeros; longer ones are kept whole."""
    c = F.btrim(as_col(value).cast("string"), F.lit(WS_CHARACTERS))
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def normalize_symbol(value: Column | str) -> Column:
    """Upper-case symbol without white space around it; blank becomes null."""
    c = F.upper(F.btrim(as_col(value).cast("string"), F.lit(WS_CHARACTERS)))
    return F.when(c != "", c)


def within(value: Column | str, start: str, end: str, null_ok: bool = False) -> Column:
    """Inclusive date range test. With ``null_ok`` an unknown date is not a reason to reject."""
    c = as_col(value)
    inside = F.coalesce(c.between(F.to_date(F.lit(start)), F.to_date(F.lit(end))), F.lit(False))
    return (c.isNull() | inside) if null_ok else inside


def to_number(value: Column | str, source_type: str = "string") -> Column:
    """Double or null. Spark reads a trailing ``d``/``f`` as a type suffix; such text is not a number here."""
    c = as_col(value)
    if source_type == "string":
        c = F.when(~c.rlike(r"^\s*[+-]?[0-9.]+([eE][+-]?[0-9]+)?[dDfF]\s*$"), c)
    return nan_to_null(c.try_cast("double"))


def to_date(value: Column | str) -> Column:
    return as_col(value).try_cast("date")
