import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import importance, penalized


def _rows(n=300, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a, b = rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0])
        out.append((f"k{k % 50}", k, int(a + 0.2 * b + rng.gauss(0, 0.5) > 0), a, b, 5.0))
    return out


def _auc(labels, scores):
    wins = [(x > y) + 0.5 * (x == y) for x, p in zip(scores, labels) for y, q in zip(scores, labels) if p == 1 and q == 0]
    return sum(wins) / len(wins)


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_plain_python(spark, partitions):
    rows = _rows()
    frame = spark.createDataFrame(rows, "key string, n int, label int, a double, b double, same double").repartition(partitions)
    found = importance.permutation_importance(frame, ["key", "n"], ["a", "b", "same"], "label", lambda v: v("a") + F.lit(0.5) * v("b") + v("same"), seed="x")
    place = lambda salt: sorted(rows, key=lambda r: hashlib.md5(f"{salt}|{r[0]}|{r[1]}".encode()).hexdigest())
    base = place("x")
    score = lambda a, b, s: a + 0.5 * b + s
    whole = _auc([r[2] for r in base], [score(*r[3:]) for r in base])
    for r in found.collect():
        column = ["a", "b", "same"].index(r["column_name"])
        other = place(f"x:{r['column_name']}")
        swapped = [score(*[o[3 + k] if k == column else v for k, v in enumerate(mine[3:])]) for mine, o in zip(base, other)]
        want = _auc([m[2] for m in base], swapped)
        assert abs(r["auc_roc"] - whole) < 1e-12 and abs(r["shuffled_auc"] - want) < 1e-12 and abs(r["importance"] - (whole - want)) < 1e-12
    assert {r["column_name"]: r["importance"] for r in found.collect()}["same"] == 0


def test_one_class_has_no_area(spark):
    frame = spark.createDataFrame([("a", 1, 1, 0.5)], "key string, n int, label int, a double")
    found = importance.permutation_importance(frame, ["key", "n"], ["a"], "label", lambda v: v("a")).collect()
    assert [(r["auc_roc"], r["importance"]) for r in found] == [(None, None)]


def _design(seed=2, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 5, 0.1, 0] + [1000, 0, 3, 7]
    y = 2 * (x[:, 0] - 1000) - 0.3 * x[:, 1] + rng.normal(size=n)
    return x, y


COLUMNS = ["a", "b", "c", "flat"]


@pytest.fixture
def table(spark):
    x, y = _design()
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)] + [(None, 1.0, 1.0, 7.0, 1.0), (1.0, 1.0, 1.0, 7.0, None)]
    return spark.createDataFrame(rows, "a double, b double, c double, flat double, y double").repartition(5)


def test_ridge_and_lasso_against_numpy(table):
    x, y = _design()
    z = x[:, :3] - x[:, :3].mean(axis=0)
    z /= z.std(axis=0)
    m = penalized.moments(table, COLUMNS, "y")
    assert m.rows == 400
    for model in penalized.ridge_path(m, [0.0, 0.1, 10.0]):
        want = np.linalg.solve(z.T @ z / 400 + model.penalty * np.eye(3), z.T @ (y - y.mean()) / 400)
        assert np.allclose(model.coefficients[:3], want, atol=1e-8) and abs(model.coefficients[3]) < 1e-12
    for model in penalized.lasso_path(m, [0.01, 0.5, 100.0]):
        slope = z.T @ (y - y.mean() - z @ model.coefficients[:3]) / 400
        active = model.coefficients[:3] != 0
        assert np.allclose(slope[active], model.penalty * np.sign(model.coefficients[:3][active]), atol=1e-8) and (np.abs(slope[~active]) <= model.penalty + 1e-8).all()
    assert not penalized.lasso_path(m, [100.0])[0].coefficients.any()


def test_slopes_and_predictions(table):
    m = penalized.moments(table, COLUMNS, "y")
    models = penalized.ridge_path(m, [0.5])
    for r in penalized.slopes(table, models, COLUMNS, "y").collect():
        assert abs(r["slope"] - 0.5 * r["coefficient"]) < 1e-8
    x, y = _design()
    found = table.dropna().select("y", models[0].prediction(COLUMNS).alias("p")).collect()
    assert np.mean([(r["y"] - r["p"]) ** 2 for r in found]) < np.var(y)


def test_no_rows(table):
    m = penalized.moments(table.limit(0), COLUMNS, "y")
    assert m.rows == 0 and not penalized.lasso_path(m, [0.1])[0].coefficients.any()
