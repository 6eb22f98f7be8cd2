"""Modelling steps: preparation, time split, column choice, winsorising, imputation, scaling, the baseline models.

Everything learnt from the training rows (split date, bounds, medians, means) is a handful of
numbers per column; those come to the driver, data never does.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..contracts import coerce, require
from ..functions.scalars import clip
from ..session import cut_lineage
from .packed import BalancedForest, HistogramBoosting, LogisticModel, RidgeLogistic, TreesModel, matrix, pack
from .quantiles import exact_quantiles

# Share of dates held out, sparsity limit in percent, winsorising quantiles, fewest dates.
TEST_SHARE = 0.20
MAX_MISSING_PCT = 20.0
CLIP_QUANTILES = (0.01, 0.99)
MIN_DATES = 10
SEED = 42
# the studied estimator stops early beyond this many rows
EARLY_STOPPING_ROWS = 10_000
#: rows of one partition of a bounded fitting sample: an iterative fit runs one task per partition and step
FIT_PARTITION_ROWS = 20_000

Bounds = Mapping[str, tuple[float | None, float | None]]


def prepare(
    df: DataFrame, features: Iterable[str], key: str = "ticker", date: str = "date", label: str = "label"
) -> DataFrame:
    """Typed columns, and only rows that have key, date and label."""
    types = dict(df.dtypes)
    wanted = {key: "string", date: "date", label: "int", **{f: "double" for f in features if f in types}}
    require(df, [key, date, label], "modelling panel")
    return df.select(
        *[coerce(F.col(c), t, wanted[c]).alias(c) if c in wanted else F.col(c) for c, t in df.dtypes]
    ).dropna(subset=[key, date, label])


def split_report(df: DataFrame, date: str = "date", test_share: float = TEST_SHARE) -> DataFrame:
    """One row: number of distinct dates and the first test date. The dates are bounded by the calendar."""
    days = F.array_sort(F.collect_set(F.col(date).cast("date")))
    n = F.size("days")
    at = F.least(F.greatest(F.floor(n * F.lit(1.0 - test_share)), F.lit(1)), n - 1)
    return df.agg(days.alias("days")).select(
        n.alias("date_count"), F.try_element_at("days", (at + 1).cast("int")).alias("split_date")
    )


def split_date(
    df: DataFrame, date: str = "date", test_share: float = TEST_SHARE, min_dates: int | None = MIN_DATES
) -> dt.date:
    """First test date. Fewer than ``min_dates`` dates are an error; None skips that check."""
    row = split_report(df, date, test_share).first()
    if row["split_date"] is None or (min_dates is not None and row["date_count"] < min_dates):
        raise ValueError(f"too few dates for a time split: {row['date_count']}")
    return row["split_date"]


def time_split(df: DataFrame, first_test_date: dt.date, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """Rows before, and rows from, the first test date."""
    edge = F.lit(first_test_date)
    return df.where(F.col(date) < edge), df.where(F.col(date) >= edge)


def require_rows(train: DataFrame, test: DataFrame) -> None:
    for name, part in (("train", train), ("test", test)):
        if part.isEmpty():
            raise ValueError(f"the {name} part of the split is empty")


def missing_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, float]]:
    """Column to (number of values, percent missing), in one pass."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)]
    ).first()
    n = row["n"]
    return {c: (row[f"c{i}"], (100.0 * (n - row[f"c{i}"]) / n) if n else 100.0) for i, c in enumerate(columns)}


def usable_features(
    train: DataFrame, candidates: Sequence[str], max_missing_pct: float = MAX_MISSING_PCT
) -> tuple[list[str], dict[str, float]]:
    """Candidates with any value and at most the given percent missing, and the percent of each."""
    shares = missing_shares(train, candidates)
    usable = [c for c in candidates if shares[c][0] > 0 and shares[c][1] <= max_missing_pct]
    if not usable:
        raise ValueError("no usable feature columns in the training rows")
    return usable, {c: pct for c, (_, pct) in shares.items()}


@dataclass(frozen=True)
class Fitted:
    """Numbers learnt per column on the training rows."""

    bounds: Bounds
    medians: Mapping[str, float | None]


def fit_columns(train: DataFrame, columns: Sequence[str], clip_at: tuple[float, float] = CLIP_QUANTILES) -> Fitted:
    """Winsorising bounds and medians together. A median lies between the bounds, so clipping leaves it."""
    quantiles = exact_quantiles(train, columns, [clip_at[0], 0.5, clip_at[1]])
    return Fitted(
        {c: (q[0], q[2]) for c, q in quantiles.items()}, {c: q[1] for c, q in quantiles.items()}
    )


def winsorize(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Clamp each column to its bounds; nulls stay, a column without bounds is left alone."""
    return df.withColumns(
        {c: clip(c, lo, hi) for c, (lo, hi) in bounds.items() if lo is not None and hi is not None}
    )


def impute(df: DataFrame, medians: Mapping[str, float | None]) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(m)) for c, m in medians.items() if m is not None})


def scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column; a constant column scales by 1."""
    row = df.agg(
        *[x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]
    ).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standardize(df: DataFrame, scales: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scales.items()})


def class_weights(df: DataFrame, label: str = "label") -> dict[int, float]:
    """Balanced weights: rows / (2 * rows of the class)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    return {k: total / (2.0 * n) for k, n in counts.items()}


def weight_column(weights: Mapping[int, float], label: str = "label") -> Column:
    c = F.lit(None).cast("double")
    for k, w in weights.items():
        c = F.when(F.col(label) == k, F.lit(w)).otherwise(c)
    return c


@dataclass(frozen=True)
class ModelSpec:
    """An estimator, whether its input is standardised and class-weighted, and whether it stops early."""

    estimator: RidgeLogistic | BalancedForest | HistogramBoosting
    scaled: bool
    weighted: bool
    early_stopping: bool = False


@dataclass(frozen=True)
class ModelSizes:
    """Ensemble sizes; the defaults are those of the studied baselines."""

    logistic_iterations: int = 1000
    forest_trees: int = 300
    forest_depth: int = 8
    boosting_rounds: int = 300
    boosting_depth: int = 6


def build_models(train_rows: int, sizes: ModelSizes = ModelSizes(), early_stopping: bool | None = None) -> dict[str, ModelSpec]:
    """The three baseline classifiers, in order of preference on ties.

    Boosting holds out a tenth of the training rows, by a hash of their keys, and stops when a round no
    longer improves on them: by default from ``EARLY_STOPPING_ROWS`` rows on, or as ``early_stopping`` says.

    The ridge penalty is ``1/n`` because the loss is averaged over rows where the usual
    ``C = 1`` form sums it. The forest balances the classes within each tree's own sample.
    """
    stops = train_rows > EARLY_STOPPING_ROWS if early_stopping is None else early_stopping
    return {
        "logistic_regression": ModelSpec(
            RidgeLogistic(1.0 / max(train_rows, 1), sizes.logistic_iterations), scaled=True, weighted=True
        ),
        "random_forest": ModelSpec(
            BalancedForest(sizes.forest_trees, sizes.forest_depth, least_rows=20, seed=SEED), scaled=False, weighted=False
        ),
        "gradient_boosting": ModelSpec(
            HistogramBoosting(sizes.boosting_rounds, sizes.boosting_depth, rate=0.05, least_rows=50, early_stopping=stops),
            scaled=False, weighted=False, early_stopping=stops,
        ),
    }


def fitting_rows(train: DataFrame, keys: Sequence[str], fit_rows: int | None) -> DataFrame:
    """All training rows, or about ``fit_rows`` of them, chosen by a hash of their keys."""
    if fit_rows is None or (n := train.count()) <= fit_rows:
        return train
    # the hash as a place between 0 and 1, so that any share can be taken however many rows there are
    place = F.xxhash64(F.lit("fit"), *keys) / F.lit(2.0**64) + 0.5
    return train.where(place < F.lit(fit_rows / n))


S, R = TypeVar("S"), TypeVar("R")


def side_by_side(work: Callable[[S], R], items: Sequence[S]) -> list[R]:
    """Results of ``work`` in order, its Spark jobs submitted from one thread per item.

    Iterative fits are long rows of short jobs; run one after the other they leave most of a cluster idle.
    """
    if len(items) < 2:
        return [work(x) for x in items]
    with ThreadPoolExecutor(len(items)) as pool:
        return list(pool.map(work, items))


def _few_partitions(rows: DataFrame, keys: Sequence[str], fit_rows: int) -> DataFrame:
    """A bounded sample written in few partitions, in an order that its keys fix.

    Only the chosen rows are moved: every task of the training table keeps its own scan.
    """
    parts = max(1, math.ceil(fit_rows / FIT_PARTITION_ROWS))
    place = F.xxhash64(F.lit("place"), *keys)
    dealt = rows.repartition(1) if parts == 1 else rows.repartition(parts, place)
    return cut_lineage(dealt.sortWithinPartitions(place, *keys))


def fit_and_predict(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    keep: Sequence[str],
    models: Mapping[str, ModelSpec],
    fit_rows: int | None = None,
) -> DataFrame:
    """Test predictions of every model: kept columns, label, model, predicted label and P(1).

    Keys travel with each prediction. Inputs must already be winsorised and imputed. With ``fit_rows``
    the models are fitted on about that many training rows, chosen by a hash of their keys and written once in
    few partitions; class weights and scales still cover all training rows, and all test rows are scored.
    """
    if not models:
        raise ValueError("no models given")
    weights = class_weights(train)
    scales = scaling(train, features)
    fit_on = fitting_rows(train, keep, fit_rows).withColumns({
        "weight": weight_column(weights), "held_out": F.pmod(F.xxhash64(*keep), F.lit(10)) == 0, "place": F.xxhash64(F.lit("draw"), *keep)
    })
    if fit_rows is not None:
        fit_on = _few_partitions(fit_on, keep, fit_rows).select("label", "weight", "held_out", "place", *features)

    def wide(df: DataFrame) -> DataFrame:
        return df.withColumn("features", F.array(*[F.col(c).cast("double") for c in features]))

    trees = [m for m in models if not models[m].scaled]
    packed = pack(wide(fit_on).select("features", "label", "held_out", "place")) if trees else None

    def fit(name: str) -> LogisticModel | TreesModel:
        spec = models[name]
        if name in trees:
            return spec.estimator.fit(packed)
        learn_from = wide(standardize(fit_on, scales) if spec.scaled else fit_on)
        return spec.estimator.fit(learn_from.select("features", "label", *["weight"] * spec.weighted))

    fitted = dict(zip(models, side_by_side(fit, list(models))))
    if packed:
        packed.remove()
    center, scale = (np.array([scales[c][k] for c in features], float) for k in (0, 1))
    return _scored(wide(test).select(*keep, "label", "features"), {m: (f, (center, scale) if models[m].scaled else None) for m, f in fitted.items()})


Scaling = tuple[np.ndarray, np.ndarray]


def _scored(rows: DataFrame, fitted: Mapping[str, tuple[LogisticModel | TreesModel, Scaling | None]]) -> DataFrame:
    """Every row once per model, with the model's name, its label and P(1) in place of ``features``; one pass scores all models."""
    kept = [f for f in rows.schema if f.name != "features"]
    made = [T.StructField("model_name", T.StringType()), T.StructField("predicted_label", T.IntegerType()), T.StructField("predicted_probability", T.DoubleType())]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in kept], *made])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(batch.num_columns - 1))
            carried = [batch.column(k).cast(arrow.field(k).type) for k in range(len(kept))]
            for name, (model, scaled) in fitted.items():
                p = model.probability(x if scaled is None else (x - scaled[0]) / scaled[1])
                yield pa.RecordBatch.from_arrays([*carried, pa.array([name] * len(p), pa.string()), pa.array((p > 0.5).astype(np.int32)), pa.array(p)], schema=arrow)

    return rows.mapInArrow(run, schema)
