"""Ridge and lasso regressions of a whole path of penalties from one pass over the rows.

The pass sums products of columns, which is all that linear least squares needs: what reaches the driver is one matrix as wide
as the model, however many rows there are. Every penalty is then solved on that matrix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """Row count, means, and mean products of the centered columns; the target is the last one."""

    rows: int
    means: np.ndarray
    products: np.ndarray


@dataclass(frozen=True)
class Linear:
    """Coefficients in units of standardised columns, and what standardises them."""

    penalty: float
    intercept: float
    coefficients: np.ndarray
    means: np.ndarray
    scales: np.ndarray

    def prediction(self, columns: Sequence[str]) -> Column:
        out = F.lit(float(self.intercept))
        for c, b, m, s in zip(columns, self.coefficients, self.means, self.scales):
            out = out + F.lit(float(b)) * (F.col(c) - F.lit(float(m))) / F.lit(float(s))
        return out


def moments(df: DataFrame, columns: Sequence[str], target: str) -> Moments:
    """Moments of the rows that have every column; products are taken around a first estimate of the means."""
    names = [*columns, target]
    rows = df.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(names)]).dropna()
    first = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{k}").alias(f"m{k}") for k in range(len(names))]).first()
    if not first["n"]:
        return Moments(0, np.zeros(len(names)), np.zeros((len(names), len(names))))
    means = np.array([first[f"m{k}"] for k in range(len(names))])
    centered = [F.col(f"x{k}") - F.lit(float(m)) for k, m in enumerate(means)]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    row = rows.agg(*[F.avg(centered[i] * centered[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    products = np.zeros((len(names), len(names)))
    for i, j in pairs:
        products[i, j] = products[j, i] = row[f"p{i}_{j}"]
    return Moments(first["n"], means, products)


def _standardised(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    scales = np.sqrt(np.diag(m.products)[:-1])
    scales = np.where(scales > 0, scales, 1.0)
    return m.products[:-1, :-1] / np.outer(scales, scales), m.products[:-1, -1] / scales, scales


def ridge_path(m: Moments, penalties: Sequence[float]) -> list[Linear]:
    """Minimises half the mean squared error plus ``penalty`` / 2 times the squared coefficients."""
    gram, cross, scales = _standardised(m)
    return [Linear(p, m.means[-1], np.linalg.lstsq(gram + p * np.eye(len(cross)), cross, rcond=None)[0], m.means[:-1], scales) for p in penalties]


def lasso_path(m: Moments, penalties: Sequence[float], rounds: int = 10_000, tolerance: float = 1e-12) -> list[Linear]:
    """Minimises half the mean squared error plus ``penalty`` times the absolute coefficients, by coordinate descent.

    Penalties are taken from the largest on, each starting from the one before; results come in the given order.
    """
    gram, cross, scales = _standardised(m)
    beta, found = np.zeros(len(cross)), {}
    for p in sorted(set(penalties), reverse=True):
        for _ in range(rounds):
            moved = 0.0
            for k in range(len(cross)):
                if gram[k, k] == 0:
                    continue
                rest = cross[k] - gram[k] @ beta + gram[k, k] * beta[k]
                new = np.sign(rest) * max(abs(rest) - p, 0.0) / gram[k, k]
                moved, beta[k] = max(moved, abs(new - beta[k])), new
            if moved < tolerance:
                break
        found[p] = beta.copy()
    return [Linear(p, m.means[-1], found[p], m.means[:-1], scales) for p in penalties]


def slopes(df: DataFrame, models: Sequence[Linear], columns: Sequence[str], target: str) -> DataFrame:
    """penalty, column_name, coefficient and slope: the mean product of residual and standardised column, over all rows.

    At a ridge solution the slope is penalty times coefficient; at a lasso solution it is the penalty with the sign of the
    coefficient, or not larger than the penalty where the coefficient is zero.
    """
    rows = df.dropna(subset=[*columns, target])
    aggregates = []
    for i, model in enumerate(models):
        miss = F.col(target) - model.prediction(columns)
        aggregates += [F.avg(miss * (F.col(c) - F.lit(float(m))) / F.lit(float(s))).alias(f"s{i}_{k}") for k, (c, m, s) in enumerate(zip(columns, model.means, model.scales))]
    one = rows.agg(*aggregates)
    entries = [
        F.struct(F.lit(float(m.penalty)).alias("penalty"), F.lit(c).alias("column_name"), F.lit(float(m.coefficients[k])).alias("coefficient"), F.col(f"s{i}_{k}").alias("slope"))
        for i, m in enumerate(models)
        for k, c in enumerate(columns)
    ]
    return one.select(F.inline(F.array(*entries)))
