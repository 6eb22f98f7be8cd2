"""Preparation and logistic regression of all folds at once.

Each fold clips, fills and scales its columns by numbers learnt on its own training rows. The quantiles of all
folds and columns share their passes, and every Newton step is one pass over the panel that sums the gradient
and curvature of all folds: what reaches the driver is one small matrix per fold. Rows are never repeated
per fold; they carry the numbers of the folds they train and test.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import nan_to_null
from ..session import cut_lineage
from .modeling import CLIP_QUANTILES
from .quantiles import GATHER_ROWS, Read, blocks, exact_quantiles, interpolated, ranked_values, wanted_ranks
from .validation import Fold, numbers_of

TRAINS, TESTS = "__trains", "__tests"


def _per_group(df: DataFrame, groups: Mapping[int, Column], columns: Sequence[str]) -> tuple[DataFrame, Read, dict[int, list[int]], dict[int, int]]:
    """Columns and group flags, a reader of each group's columns one after the other, and values per column and rows of every group."""
    width = len(columns)
    wide = df.select(*[nan_to_null(F.col(c).cast("double")).alias(f"c{k}") for k, c in enumerate(columns)], *[F.coalesce(on, F.lit(False)).alias(f"g{i}") for i, on in enumerate(groups.values())])
    sums = [F.count_if(F.col(f"g{i}")).alias(f"g{i}") for i in range(len(groups))]
    sums += [F.count_if(F.col(f"g{i}") & F.col(f"c{k}").isNotNull()).alias(f"n{i}_{k}") for i in range(len(groups)) for k in range(width)]
    row = wide.agg(*sums).first()

    def read(batch: pa.RecordBatch) -> list[np.ndarray]:
        x = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)]
        flags = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(width, batch.num_columns)]
        return [values[on] for on in flags for values in x]

    return wide, read, {g: [row[f"n{i}_{k}"] for k in range(width)] for i, g in enumerate(groups)}, {g: row[f"g{i}"] for i, g in enumerate(groups)}


def grouped_quantiles(
    df: DataFrame, groups: Mapping[int, Column], columns: Sequence[str], probs: Sequence[float], gather_rows: int = GATHER_ROWS
) -> dict[int, dict[str, list[float | None]]]:
    """Exact quantiles of each column over the rows of each group, all in shared passes.

    Groups are conditions and may overlap; a row belongs to every group whose condition holds. The groups
    are few (folds), as each adds its columns to the counters of a pass; a row is sent to it once.
    """
    wide, read, sizes, _ = _per_group(df, groups, columns)
    flat = [n for g in groups for n in sizes[g]]
    values = iter(zip(flat, ranked_values(wide, read, flat, [wanted_ranks(n, probs) for n in flat], gather_rows)))
    return {g: {c: [interpolated(n, p, v.__getitem__) for p in probs] for c, (n, v) in zip(columns, values)} for g in groups}


def robust_scaling(df: DataFrame, columns: Sequence[str], **how) -> dict[str, tuple[float, float]]:
    """Median and distance of the quartiles per column; 1 where the quartiles coincide, (0, 1) without values."""
    found = exact_quantiles(df, columns, [0.25, 0.5, 0.75], **how)
    return {c: _scale(q) for c, q in found.items()}


def _scale(q: Sequence[float | None]) -> tuple[float, float]:
    if q[0] is None:
        return 0.0, 1.0
    return q[1], (q[2] - q[0]) or 1.0


@dataclass(frozen=True)
class Prepared:
    """What a fold learnt per column: clipping bounds, fill value, center and scale."""

    low: np.ndarray
    high: np.ndarray
    fill: np.ndarray
    center: np.ndarray
    scale: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Rows x columns, null as nan, to clipped, filled and scaled values."""
        filled = np.where(np.isnan(x), self.fill, np.clip(x, self.low, self.high))
        return (filled - self.center) / self.scale

    def columns(self, names: Sequence[str]) -> list[Column]:
        """The same as column expressions."""
        out = []
        for k, c in enumerate(names):
            lo, hi, fill, center, scale = (float(a[k]) for a in (self.low, self.high, self.fill, self.center, self.scale))
            clipped = F.least(F.greatest(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(lo)), F.lit(hi))
            value = F.when(F.nanvl(F.col(c).cast("double"), F.lit(None)).isNull(), F.lit(fill)).otherwise(clipped)
            out.append((value - center) / scale)
        return out


def with_folds(df: DataFrame, folds: Sequence[Fold], date: str = "date", label_end: str | None = None) -> DataFrame:
    """Adds the folds that a row trains, and those that it tests, as arrays."""
    return df.withColumns({name: numbers_of(folds, part, date, label_end) for name, part in ((TRAINS, "train"), (TESTS, "test"))})


def prepare_folds(
    df: DataFrame, folds: Sequence[Fold], columns: Sequence[str], clip_at: tuple[float, float] = CLIP_QUANTILES, robust: bool = True
) -> dict[int, Prepared]:
    """Bounds, medians and scales of each fold's training rows; ``df`` comes from :func:`with_folds`.

    Scales are learnt on the clipped and filled values: median and quartile distance, or mean and population
    deviation where ``robust`` is off. A column without training values is filled with 0.
    """
    trains = {f.number: F.array_contains(TRAINS, f.number) for f in folds}
    if not trains:
        return {}
    wide, read, sizes, rows = _per_group(df, trains, columns)
    wanted, quartiles = [clip_at[0], 0.5, clip_at[1]], [0.25, 0.5, 0.75] if robust else []
    flat = [(n, size, rows[n] - size) for n in trains for size in sizes[n]]
    ranks = [wanted_ranks(size, wanted) + [k for r in (wanted_ranks(size + gaps, quartiles) if size else []) if (k := _known_rank(r, size, gaps)) is not None] for _, size, gaps in flat]
    at = iter(zip(flat, ranked_values(wide, read, [size for _, size, _ in flat], ranks)))
    bare, robust_scales = {}, {}
    for n in trains:
        edges, scales = [], []
        for _ in columns:
            (_, size, gaps), values = next(at)
            low, fill, high = [interpolated(size, p, values.__getitem__) for p in wanted] if size else (-np.inf, 0.0, np.inf)

            def filled(r: int, size=size, gaps=gaps, values=values, low=low, fill=fill, high=high) -> float:
                """The value at a rank of the clipped values and the gaps filled with their median."""
                k = _known_rank(r, size, gaps)
                return fill if k is None else min(max(values[k], low), high)

            edges.append((low, high, fill))
            scales.append(_scale([interpolated(size + gaps, p, filled) if size else 0.0 for p in quartiles] or [None]) if rows[n] else (0.0, 1.0))
        bare[n] = Prepared(*np.array(edges, dtype=float).reshape(-1, 3).T, np.zeros(len(columns)), np.ones(len(columns)))
        robust_scales[n] = np.array(scales, dtype=float).reshape(-1, 2).T
    if robust:
        return {n: Prepared(p.low, p.high, p.fill, *robust_scales[n]) for n, p in bare.items()}
    names = {(n, k): f"v{i}_{k}" for i, n in enumerate(trains) for k in range(len(columns))}
    spread = df.select(*[F.when(trains[n], x).alias(names[n, k]) for n in trains for k, x in enumerate(bare[n].columns(columns))])
    row = spread.agg(*[f(c).alias(f"{c}_{f.__name__}") for c in names.values() for f in (F.avg, F.stddev_pop)]).first()
    found = {c: (row[f"{c}_avg"] or 0.0, row[f"{c}_stddev_pop"] or 1.0) for c in names.values()}
    return {n: Prepared(p.low, p.high, p.fill, *(np.array([found[names[n, k]][side] for k in range(len(columns))]) for side in (0, 1))) for n, p in bare.items()}


def _known_rank(rank: int, size: int, gaps: int) -> int | None:
    """The rank among ``size`` values of what has ``rank`` when ``gaps`` copies of their median join them; None for such a copy, or what equals it."""
    low, high = wanted_ranks(size, [0.5])
    if rank <= low:
        return rank
    return rank - gaps if rank >= high + gaps else None


def _design(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.column_stack([batch.column(k).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for k in range(width)]) if width else np.zeros((len(batch), 0))


def _members(column: pa.Array, number: int) -> np.ndarray:
    rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return rows[column.flatten().to_numpy() == number]


@dataclass(frozen=True)
class Logistic:
    """Coefficients in prepared units, the intercept first, and what the fold prepares by."""

    prepared: Prepared
    beta: np.ndarray
    weights: tuple[float, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.beta[0] + self.prepared.apply(x) @ self.beta[1:]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(
    df: DataFrame, folds: Sequence[Fold], columns: Sequence[str], label: str = "label", ridge: float = 1.0, balanced: bool = True,
    robust: bool = True, steps: int = 50, tolerance: float = 1e-8,
) -> dict[int, Logistic]:
    """Ridge logistic regressions of all folds by Newton steps; ``df`` comes from :func:`with_folds`.

    The loss is the (class-weighted) sum over training rows plus ``ridge`` / 2 times the squared coefficients, the
    intercept left out. A step is halved for a fold whose loss it would raise. Folds with one class are left out.
    """
    width = len(columns)
    table = cut_lineage(df.where(F.size(TRAINS) > 0).where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)], F.col(label).cast("int").alias("y"), F.col(TRAINS).cast("array<int>").alias("trains")))
    named = [f"x{k}" for k in range(width)]
    prepared = prepare_folds(table.withColumnRenamed("trains", TRAINS), folds, named, robust=robust)
    counts = {(r["fold"], r["y"]): r["n"] for r in table.select("y", F.explode("trains").alias("fold")).groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    able = [f.number for f in folds if counts.get((f.number, 0)) and counts.get((f.number, 1))]
    total = {n: counts[n, 0] + counts[n, 1] for n in able}
    weights = {n: tuple(total[n] / (2.0 * counts[n, y]) if balanced else 1.0 for y in (0, 1)) for n in able}
    beta = {n: np.zeros(width + 1) for n in able}
    schema = T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("value", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def sums(current: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        """Loss, gradient and curvature of each fold at its coefficients."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = width + 1
            held = {n: np.zeros(1 + d + d * d) for n in current}
            for batch in blocks(batches):
                x, y = _design(batch, width), batch.column(width).to_numpy()
                for n, b in current.items():
                    rows = _members(batch.column(width + 1), n)
                    z = np.column_stack([np.ones(len(rows)), prepared[n].apply(x[rows])])
                    t, w = y[rows], np.where(y[rows] == 1, weights[n][1], weights[n][0])
                    s = z @ b
                    p = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
                    loss = np.sum(w * (np.logaddexp(0, s) - t * s))
                    held[n] += np.concatenate([[loss], z.T @ (w * (p - t)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()])
            for n, v in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(v), pa.int32()), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], schema=arrow)

        found = table.select(*named, "y", "trains").mapInArrow(run, schema).groupBy("fold", "at").agg(F.sum("value").alias("value")).collect()
        out = {n: np.zeros(1 + (width + 1) + (width + 1) ** 2) for n in current}
        for r in found:
            out[r["fold"]][r["at"]] = r["value"]
        penalty = np.full(width + 1, ridge)
        penalty[0] = 0.0
        result = {}
        for n, v in out.items():
            b = current[n]
            result[n] = (v[0] + (penalty * b * b).sum() / 2, v[1 : width + 2] + penalty * b, v[width + 2 :].reshape(width + 1, width + 1) + np.diag(penalty))
        return result

    at = sums(beta) if able else {}
    moving = dict.fromkeys(able, 1.0)
    for _ in range(steps):
        if not moving:
            break
        tried = {n: beta[n] - share * np.linalg.lstsq(at[n][2], at[n][1], rcond=None)[0] for n, share in moving.items()}
        new = sums(tried)
        for n in list(moving):
            if new[n][0] <= at[n][0] + 1e-12 * abs(at[n][0]):
                small = np.abs(new[n][1]).max() <= tolerance * total[n] or np.abs(tried[n] - beta[n]).max() < 1e-12
                beta[n], at[n], moving[n] = tried[n], new[n], 1.0
                if small:
                    del moving[n]
            else:
                moving[n] /= 2
                if moving[n] < 1e-6:
                    del moving[n]
    return {n: Logistic(prepared[n], beta[n], weights[n]) for n in able}


def predict_folds(df: DataFrame, models: Mapping[int, Logistic], columns: Sequence[str], keep: Sequence[str], label: str = "label", part: str = TESTS) -> DataFrame:
    """Predictions of the rows of a fold's part: kept columns, label, fold, predicted label and P(1)."""
    rows = df.where(F.size(part) > 0).where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(columns)], F.col(part).cast("array<int>").alias("__folds"), *keep, F.col(label).cast("int").alias("label"))
    width = len(columns)
    schema = T.StructType(
        [*(rows.schema[c] for c in (*keep, "label")), T.StructField("fold", T.IntegerType()), T.StructField("predicted_label", T.IntegerType()), T.StructField("predicted_probability", T.DoubleType())]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _design(batch, width)
            for n, model in models.items():
                own = _members(batch.column(width), n)
                if len(own):
                    p = model.probability(x[own])
                    carried = [batch.column(k).take(pa.array(own)) for k in range(width + 1, batch.num_columns)]
                    yield pa.RecordBatch.from_arrays([*carried, pa.array(np.full(len(own), n, np.int32)), pa.array((p > 0.5).astype(np.int32)), pa.array(p)], schema=arrow)

    return rows.mapInArrow(run, schema)
