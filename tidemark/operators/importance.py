"""Permutation importance: how far a score's area under the curve falls when one column is shuffled.

A column is shuffled by rank: rows are numbered once in a fixed order of their keys' hashes and, per column, in another
one, and the row at a place takes the column's value from the row that has this place in the other order. Ranks come
from range sorts, so no task sees more than its range and nothing is collected but the sizes of the ranges. The
areas of all columns are one aggregation over the stacked scores.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .metrics import auc


def hash_order(keys: Sequence[str], salt: str) -> Column:
    """A fixed order of rows that looks random: the md5 of salt and keys, as text."""
    return F.md5(F.concat_ws("|", F.lit(salt), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).cast("binary"))


def numbered(rows: DataFrame, order: Sequence[Column], name: str, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` of ``rows`` with their place in ``order``, from 0 on, by a range sort; equal rows of the order are told apart at will."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    written = cut_lineage(dealt.select(*keep, F.monotonically_increasing_id().alias("__at")))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"]) for r in written.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row per range
    before, starts = 0, []
    for number, n in sizes:
        starts.append((int(number), before))
        before += n
    table = rows.sparkSession.createDataFrame(starts, "__part long, __before long")
    joined = written.withColumn("__part", part).join(F.broadcast(table), "__part", "left")  # one row per range
    return joined.withColumn(name, F.col("__before") + place).drop("__part", "__before", "__at")


def shuffled_column(rows: DataFrame, column: str, keys: Sequence[str], seed: str, name: str) -> DataFrame:
    """Place and value: at every place the value of the row that has it in the column's own order."""
    mixed = rows.select(*keys, F.col(column).alias(name))
    return numbered(mixed, [hash_order(keys, f"{seed}:{column}"), *[F.col(k) for k in keys]], "__place", [name])


def permutation_importance(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str], label: str, score: Callable[[Callable[[str], Column]], Column], seed: str = "0"
) -> DataFrame:
    """column_name, auc_roc, shuffled_auc and importance (the fall) of every column.

    ``score`` builds the score from a function that gives a column's value, so that one of them can be another row's.
    Keys must identify a row. Areas are null where the rows have one class. ``rows`` is read once per column and once more:
    write an expensive input to a table first.
    """
    kept = list(dict.fromkeys([label, *columns]))
    joined = numbered(rows.select(*dict.fromkeys([*keys, *kept])), [hash_order(keys, seed), *[F.col(k) for k in keys]], "__place", kept)
    other = {c: f"__other{i}" for i, c in enumerate(columns)}
    for column, name in other.items():  # all joins are by place, so nothing is dealt twice
        joined = joined.join(shuffled_column(rows, column, keys, seed, name), "__place")
    # slot 0 is the score as it is, slot i that with column i shuffled
    every = [score(lambda c: F.col(c)), *[score(lambda c, own=column: F.col(other[c] if c == own else c)) for column in columns]]
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), s.cast("double").alias("predicted_probability")) for i, s in enumerate(every)])
    found = cut_lineage(auc(joined.select(F.col(label).alias("label"), F.inline(slots)), ["slot"]))  # one row per column
    whole = F.lit(next((r["auc_roc"] for r in found.where("slot = 0").collect()), None)).cast("double")  # a single row
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("slot"))
    return found.where("slot > 0").select(name.alias("column_name"), whole.alias("auc_roc"), F.col("auc_roc").alias("shuffled_auc"), (whole - F.col("auc_roc")).alias("importance"))
