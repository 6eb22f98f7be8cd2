import datetime as dt
import random

import numpy as np
import pytest
from helpers import day, values
from pyspark.sql import functions as F

from tidemark.operators import foldmodels, validation


def test_walk_forward_edges():
    days = [day(n) for n in range(10)]
    folds = validation.walk_forward(days, first=4, span=3, gap=1)
    assert folds == [validation.Fold(1, day(0), day(3), day(4), day(7)), validation.Fold(2, day(0), day(6), day(7), None)]
    assert validation.walk_forward(days, 4, 3, window=2)[1] == validation.Fold(2, day(5), day(7), day(7), None)
    assert validation.walk_forward(days, 10, 3) == []
    assert validation.walk_forward(days, 2, 4, gap=3)[0].test_from == day(6)  # the first one has nothing to train on
    with pytest.raises(ValueError):
        validation.walk_forward(days, 4, 0)


def test_expanding_folds_share_the_end_of_the_calendar():
    days = [day(n) for n in range(20)]
    folds = validation.expanding_folds(days, splits=3, gap=2)
    assert [(f.train_until, f.test_from, f.test_until) for f in folds] == [(day(3), day(5), day(10)), (day(8), day(10), day(15)), (day(13), day(15), None)]
    with pytest.raises(ValueError):
        validation.expanding_folds(days[:5], splits=5, gap=1)


def test_holdout_counts_months_back():
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=n) for n in range(366)]
    assert validation.holdout_start(days, 6) == dt.date(2020, 7, 1)
    assert validation.holdout_start([d for d in days if d <= dt.date(2020, 8, 31)], 6) == dt.date(2020, 3, 1)
    folds, holdout = validation.folds_and_holdout(days, splits=2, gap=5)
    assert folds[-1].test_until == holdout.test_from == dt.date(2020, 7, 1) and holdout.test_until is None
    assert holdout.train_until == dt.date(2020, 6, 26)


def test_embargo(spark):
    rows = spark.createDataFrame([(day(n), n) for n in range(10) for _ in range(2)], "date date, n int")
    train, test = validation.gapped_split(rows, day(8), 3)
    assert sorted(set(values(train, "n"))) == [0, 1, 2, 3, 4] and sorted(set(values(test, "n"))) == [8, 9]
    train, _ = validation.gapped_split(rows, day(8))
    assert max(values(train, "n")) == 7
    with pytest.raises(ValueError):
        validation.embargo_start([day(1), day(2)], day(2), 1)


def test_labels_that_reach_the_test_range_are_purged(spark):
    fold = validation.Fold(1, day(0), day(5), day(5), day(7))
    rows = spark.createDataFrame([(0, day(0), day(3)), (1, day(3), day(5)), (2, day(3), None), (3, day(4), day(4)), (4, day(5), day(9)), (5, day(7), day(8)), (6, None, None)], "n int, date date, label_end date")
    found = validation.assign_folds(rows, [fold], label_end="label_end")
    assert sorted(values(found, "n", "fold", "part")) == [(0, 1, "train"), (1, 1, "purged"), (2, 1, "purged"), (3, 1, "train"), (4, 1, "test")]
    assert sorted(values(validation.assign_folds(rows, [fold]), "n", "part")) == [(0, "train"), (1, "train"), (2, "train"), (3, "train"), (4, "test")]
    assert validation.assign_folds(rows, []).count() == 0
    with pytest.raises(ValueError):
        validation.assign_folds(rows.withColumn("part", F.lit(1)), [fold])


def test_assignment_needs_no_exchange(spark):
    rows = spark.createDataFrame([(day(0), day(1))], "date date, label_end date")
    folds = [validation.Fold(k, day(0), day(k), day(k), None) for k in range(1, 200)]
    plan = validation.assign_folds(rows, folds, label_end="label_end")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_label_ends(spark):
    bars = spark.createDataFrame([("a", day(n)) for n in (0, 2, 3, 7)] + [("b", day(1))], "ticker string, date date")
    for rows_per_segment in (None, 2):
        found = validation.label_ends(bars, 2, rows_per_segment=rows_per_segment)
        assert sorted(values(found, "ticker", "date", "label_end"), key=str) == [("a", day(0), day(3)), ("a", day(2), day(7)), ("a", day(3), None), ("a", day(7), None), ("b", day(1), None)]


def _panel(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(3, 2)
        label = int(rng.random() < 1 / (1 + np.exp(-(a - 0.5 * (b - 3)))))
        rows.append((day(k % 40), None if rng.random() < 0.1 else a, b if rng.random() < 0.98 else 1000.0, None, label if rng.random() < 0.98 else None))
    return rows, spark.createDataFrame(rows, "date date, a double, b double, nothing double, label int")


FOLDS = [validation.Fold(1, day(0), day(20), day(22), day(30)), validation.Fold(2, day(0), day(28), day(30), None)]


def _plain_prepared(column, robust):
    known = np.array([x for x in column if x is not None])
    if not len(known):
        return np.zeros(len(column)), lambda x: 0.0
    lo, mid, hi = np.quantile(known, [0.01, 0.5, 0.99])
    filled = np.array([mid if x is None else min(max(x, lo), hi) for x in column])
    center, scale = (np.median(filled), np.subtract(*np.quantile(filled, [0.75, 0.25]))) if robust else (filled.mean(), filled.std())
    of = lambda x: ((mid if x is None else min(max(x, lo), hi)) - center) / (scale or 1.0)
    return np.array([of(x) for x in column]), of


@pytest.mark.parametrize("robust", [True, False])
def test_fits_of_all_folds_against_plain_newton_steps(spark, robust):
    rows, frame = _panel(spark)
    columns = ["a", "b", "nothing"]
    member = foldmodels.with_folds(frame, FOLDS)
    models = foldmodels.fit_logistic(member, FOLDS, columns, robust=robust)
    predicted = {(r["fold"], r["date"], r["b"]): r["predicted_probability"] for r in foldmodels.predict_folds(member, models, columns, ["date", "b"]).collect()}
    for fold in FOLDS:
        train = [r for r in rows if fold.train_from <= r[0] < fold.train_until and r[4] is not None]
        prepared = [_plain_prepared([r[1 + k] for r in train], robust) for k in range(3)]
        z = np.column_stack([np.ones(len(train)), *(p[0] for p in prepared)])
        y = np.array([r[4] for r in train])
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        beta, penalty = np.zeros(4), np.array([0, 1, 1, 1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ beta))
            beta = beta - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (w * (p - y)) + penalty * beta)
        assert np.allclose(models[fold.number].beta, beta, atol=1e-6)
        tested = [r for r in rows if r[0] >= fold.test_from and (fold.test_until is None or r[0] < fold.test_until) and r[4] is not None]
        assert sum(k[0] == fold.number for k in predicted) == len({(r[0], r[2]) for r in tested})
        for r in tested:
            score = beta[0] + sum(b * p[1](r[1 + k]) for k, (b, p) in enumerate(zip(beta[1:], prepared)))
            assert abs(predicted[fold.number, r[0], r[2]] - 1 / (1 + np.exp(-score))) < 1e-6


def test_prepared_columns_equal_prepared_arrays(spark):
    rows, frame = _panel(spark, 60)
    member = foldmodels.with_folds(frame, FOLDS)
    prepared = foldmodels.prepare_folds(member, FOLDS, ["a", "b", "nothing"])[1]
    found = member.select(*[c.alias(f"c{k}") for k, c in enumerate(prepared.columns(["a", "b", "nothing"]))], "a", "b", "nothing").collect()
    for r in found:
        x = np.array([[np.nan if v is None else v for v in (r["a"], r["b"], r["nothing"])]])
        assert np.allclose(prepared.apply(x)[0], [r["c0"], r["c1"], r["c2"]])


def test_folds_with_one_class_are_left_out(spark):
    frame = spark.createDataFrame([(day(n), float(n), int(n > 24)) for n in range(40)], "date date, a double, label int")
    member = foldmodels.with_folds(frame, FOLDS)
    models = foldmodels.fit_logistic(member, FOLDS, ["a"])
    assert list(models) == [2]
    assert foldmodels.predict_folds(member, {}, ["a"], ["date"]).count() == 0
    assert foldmodels.fit_logistic(member.limit(0), FOLDS, ["a"]) == {}


def test_robust_scaling(spark):
    frame = spark.createDataFrame([(float(n), 5.0, None) for n in range(5)], "a double, b double, c double")
    assert foldmodels.robust_scaling(frame, ["a", "b", "c"]) == {"a": (2.0, 2.0), "b": (5.0, 1.0), "c": (0.0, 1.0)}
