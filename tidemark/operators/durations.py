"""Facts by the length of what they cover: single quarters told from year-to-date amounts, missing quarters derived.

Amounts of a quarter and of the year so far share their period end. Their first day tells them apart, and one can be
derived from the other: a quarter is the difference of two amounts that begin on the same day, and the fourth
quarter is what three reported quarters leave of the year.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import keep_last

#: days, first and last included; fiscal quarters have 12 to 14 weeks
LENGTHS = {"quarter": (80, 100), "half_year": (170, 195), "nine_months": (260, 285), "year": (350, 380)}


def days_between(start: Column, end: Column) -> Column:
    """Days from the first to the last one, both counted."""
    return F.datediff(end, start) + 1


def duration(days: Column) -> Column:
    """The name of a length; null days are an instant (balance-sheet amounts), other lengths are ``other``."""
    name = F.when(days.isNull(), F.lit("instant"))
    for kind, (least, most) in LENGTHS.items():
        name = name.when(days.between(least, most), F.lit(kind))
    return name.otherwise(F.lit("other"))


def with_duration(facts: DataFrame, start: str = "period_start", end: str = "period_end") -> DataFrame:
    return facts.withColumn("duration", duration(days_between(F.col(start), F.col(end))))


def quarterly(
    facts: DataFrame, keys: Sequence[str] = ("ticker", "concept_name"), start: str = "period_start", end: str = "period_end", value: str = "value", filed: str = "filing_date", ties: Sequence[str] = ()
) -> DataFrame:
    """One row per key and quarter: keys, start, end, value, filing day, and ``origin``.

    ``origin`` is reported, difference (of two amounts that begin on one day) or remainder (of a year less three
    quarters); the first that is there is taken. A derived amount is known when its last input is. Of several facts of
    one span the last filed counts. Facts of other lengths, instants and null values take no part.
    """
    spans = facts.where(F.col(start).isNotNull() & F.col(end).isNotNull() & F.col(value).isNotNull() & F.col(filed).isNotNull())
    latest = keep_last(spans.select(*keys, start, end, value, filed, *[c for c in ties if c != value]), [*keys, start, end], [filed, *ties]).select(*keys, start, end, value, filed)
    is_quarter = duration(days_between(F.col(start), F.col(end))) == "quarter"
    reported = latest.where(is_quarter).withColumn("origin", F.lit("reported"))

    # amounts of one first day: a year has few, so the window is over a handful of rows
    growing = Window.partitionBy(*keys, start).orderBy(end)
    before = F.lag(F.struct(F.col(end).alias("end"), F.col(value).alias("value"), F.col(filed).alias("filed"))).over(growing)
    steps = latest.withColumn("__before", before).where(F.col("__before").isNotNull())
    differences = steps.select(
        *keys, F.date_add("__before.end", 1).alias(start), end, (F.col(value) - F.col("__before.value")).alias(value), F.greatest(filed, "__before.filed").alias(filed), F.lit("difference").alias("origin")
    ).where(is_quarter)
    known = first_of(reported.unionByName(differences), [*keys, start, end])

    # quarters inside a year, met by key and calendar year of the quarter's end
    years = latest.where(duration(days_between(F.col(start), F.col(end))) == "year").select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col(start).alias("__start"), F.col(end).alias("__end"), F.col(value).alias("__value"), F.col(filed).alias("__filed"),
        F.explode(F.sequence(F.year(start), F.year(end))).alias("__year"),
    )
    same = [known[k] == F.col(f"__{k}") for k in keys]
    inside = known.join(years, [*same, F.year(known[end]) == F.col("__year"), known[start] >= F.col("__start"), known[end] < F.col("__end")])
    last_end = F.date_add(F.max(end), 1)
    summed = inside.groupBy(*[f"__{k}" for k in keys], "__start", "__end", "__value", "__filed").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.sum(days_between(F.col(start), F.col(end))).alias("covered"), F.min(start).alias("first"), last_end.alias("rest"), F.max(filed).alias("known"),
    )
    # three quarters in a row from the first day of the year on
    in_a_row = (F.col("n") == 3) & (F.col("first") == F.col("__start")) & (F.col("covered") == F.datediff("rest", "__start"))
    remainders = summed.where(in_a_row).select(
        *[F.col(f"__{k}").alias(k) for k in keys], F.col("rest").alias(start), F.col("__end").alias(end), (F.col("__value") - F.col("total")).alias(value), F.greatest("__filed", "known").alias(filed), F.lit("remainder").alias("origin")
    ).where(is_quarter)
    return first_of(known.unionByName(remainders), [*keys, start, end])


def first_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per span the row of the first origin: reported, difference, remainder."""
    place = F.array_position(F.array(F.lit("reported"), F.lit("difference"), F.lit("remainder")), F.col("origin"))
    carried = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*carried), place).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in carried])


def year_to_date(
    facts: DataFrame, keys: Sequence[str] = ("ticker", "concept_name"), start: str = "period_start", end: str = "period_end", value: str = "value", filed: str = "filing_date", ties: Sequence[str] = ()
) -> DataFrame:
    """Per key and period end the amount that covers the most days, a year at most; the last filed of equal spans."""
    longest = days_between(F.col(start), F.col(end))
    spans = facts.where(F.col(value).isNotNull() & longest.between(LENGTHS["quarter"][0], LENGTHS["year"][1])).withColumn("__days", longest)
    return keep_last(spans, [*keys, end], ["__days", filed, *ties]).drop("__days")
