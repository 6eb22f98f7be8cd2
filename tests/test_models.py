import math
import random

import numpy as np
import pytest
from helpers import day
from pyspark.sql import functions as F

from tidemark.operators import metrics, modeling, quality
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans import comparison
from tidemark.plans.comparison import Setup, compare


@pytest.mark.parametrize("gather_rows", [5, 200, 100_000])
def test_quantiles(spark, gather_rows):
    rng = np.random.default_rng(4)
    n = 30_000
    data = {
        "a": rng.normal(size=n), "b": np.where(rng.random(n) < 0.4, 7.0, rng.normal(7, 1, n)),
        "c": np.round(rng.exponential(size=n), 1), "d": np.full(n, 2.5),
    }
    df = spark.createDataFrame([tuple(float(x) for x in r) for r in zip(*data.values())], "a double, b double, c double, d double")
    df = df.withColumns({"e": F.when(F.col("a") > 0, F.col("a")), "f": F.lit(None).cast("double")})
    probs = [0.0, 0.01, 0.5, 0.731, 0.99, 1.0]
    got = exact_quantiles(df, ["a", "b", "c", "d", "e", "f"], probs, gather_rows)
    data["e"] = data["a"][data["a"] > 0]
    for c, x in data.items():
        assert got[c] == pytest.approx(list(np.quantile(x, probs)), abs=1e-12)
    assert got["f"] == [None] * len(probs)


def test_quantiles_of_few_rows(spark):
    df = spark.createDataFrame([(3.0, 1.0), (None, 2.0)], "x double, y double")
    assert exact_quantiles(df, ["x", "y"], [0.25, 0.5]) == {"x": [3.0, 3.0], "y": [1.25, 1.5]}
    assert exact_quantiles(df, [], [0.5]) == {}


def predictions(spark, rows):
    return spark.createDataFrame([("m", *r) for r in rows], "model_name string, label int, predicted_label int, predicted_probability double")


@pytest.mark.parametrize("rows_per_bucket", [10, 10_000])
def test_auc_against_pairs(spark, rows_per_bucket):
    random.seed(8)
    rows = [(random.randrange(2), 1, round(random.random(), 2)) for _ in range(300)]
    got = metrics.auc(predictions(spark, rows), ["model_name"], rows_per_bucket=rows_per_bucket).first().auc_roc
    pos, neg = ([s for y, _, s in rows if y == k] for k in (1, 0))
    wins = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
    assert got == pytest.approx(wins / len(pos) / len(neg))


@pytest.mark.parametrize("rows_per_bucket", [1, 10_000])
def test_auc_ignores_rows_without_a_score(spark, rows_per_bucket):
    rows = [(1, 1, 0.9), (0, 0, 0.1), (1, 0, float("nan")), (0, 1, None), (1, 1, 0.5)]
    assert metrics.auc(predictions(spark, rows), ["model_name"], rows_per_bucket=rows_per_bucket).first().auc_roc == 1.0


def test_quantiles_ignore_nan(spark):
    df = spark.range(100).select(F.when(F.col("id") < 90, F.col("id") + 10.0).otherwise(float("nan")).alias("x"))
    for gather in (10, 100_000):
        assert exact_quantiles(df, ["x"], [0.5, 0.99], gather) == {"x": [54.5, pytest.approx(98.11)]}


def test_metrics_without_positive_predictions(spark):
    row = metrics.classification_metrics(predictions(spark, [(1, 0, 0.4), (0, 0, 0.0)]), ["model_name"]).first()
    assert (row.precision, row.recall, row.f1, row.accuracy, row.auc_roc) == (0.0, 0.0, 0.0, 0.5, 1.0)
    assert (row.tn, row.fp, row.fn, row.tp) == (1, 0, 1, 0)
    assert row.log_loss == pytest.approx(-math.log(0.4) / 2, abs=1e-9)
    single = metrics.auc(predictions(spark, [(1, 0, 0.4)]), ["model_name"]).first()
    assert single.auc_roc is None
    tidy = metrics.tidy_metrics(metrics.confusion(predictions(spark, [(1, 1, 0.9)]), ["model_name"]), ["model_name"])
    assert tidy.count() == 9 and tidy.columns == ["model_name", "metric", "value"]


def test_best_model_prefers_the_earlier_on_a_tie(spark):
    df = spark.createDataFrame([("s", "b", 0.6), ("s", "a", 0.6), ("s", "c", 0.1)], "feature_setup string, model_name string, auc_roc double")
    assert metrics.best_model(df, ["feature_setup"], ["a", "b", "c"]).first().best_model == "a"
    assert metrics.best_model(df, ["feature_setup"], ["c", "b", "a"]).first().best_model == "b"


def test_split_date(spark):
    ten = spark.createDataFrame([(day(i),) for i in range(10)] * 2, "date date")
    assert modeling.split_date(ten) == day(8)
    train, test = modeling.time_split(ten, day(8))
    assert (train.count(), test.count()) == (16, 4)
    nine = ten.where(F.col("date") < F.lit(day(9)))
    with pytest.raises(ValueError, match="too few dates"):
        modeling.split_date(nine)
    assert modeling.split_date(nine, min_dates=None) == day(7)
    with pytest.raises(ValueError, match="test part"):
        modeling.require_rows(train, test.where("false"))


def test_usable_features(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") >= 200, 1.0).alias("twenty"), F.when(F.col("id") >= 201, 1.0).alias("more"), F.lit(None).cast("double").alias("none"), F.lit(1.0).alias("full")
    )
    used, missing = modeling.usable_features(df, ["twenty", "more", "none", "full"])
    assert used == ["twenty", "full"] and missing == {"twenty": 20.0, "more": 20.1, "none": 100.0, "full": 0.0}
    with pytest.raises(ValueError):
        modeling.usable_features(df, ["none"])


def test_winsorize_impute_scale(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(101)] + [(None, 1.0)], "x double, k double")
    fitted = modeling.fit_columns(df, ["x", "k"])
    assert fitted.bounds["x"] == (1.0, 99.0) and fitted.medians["x"] == 50.0
    done = modeling.impute(modeling.winsorize(df, fitted.bounds), fitted.medians)
    x = sorted(r.x for r in done.collect())
    assert x[:3] == [1.0, 1.0, 2.0] and x[-2:] == [99.0, 99.0] and x.count(50.0) == 2
    scales = modeling.scaling(done, ["x", "k"])
    assert scales["k"] == (1.0, 1.0) and scales["x"][1] == pytest.approx(np.std(x))
    z = [r.x for r in modeling.standardize(done, scales).collect()]
    assert np.mean(z) == pytest.approx(0, abs=1e-12) and np.std(z) == pytest.approx(1)


def test_reports(spark):
    df = spark.createDataFrame([("a", day(0), 1), ("a", day(1), None), ("b", day(2), 1)], "k string, d date, label int")
    row = quality.table_summary(df, "k", "d", "label").first()
    assert tuple(row) == (3, 2, day(0), day(2), 2, 1)
    assert tuple(quality.class_balance(df).first()) == (2, 0.0, 100.0)
    assert [tuple(r) for r in quality.value_counts(df, "label").collect()] == [(1, 2), (None, 1)]
    assert [tuple(r) for r in quality.missing_percentages(df, ["label", "d", "zzz"]).collect()][0] == ("d", 0.0)


def panel(spark, n=240):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        x, u = rng.normal(size=2)
        label = int(rng.random() < 1 / (1 + np.exp(-1.5 * x)))
        rows.append((f"t{i % 3}", day(i // 3), 0.0, label, float(x), float(u) if i % 9 else None, None))
    return spark.createDataFrame(rows, "ticker string, date date, forward_return_5d double, label int, x double, u double, empty double")


def test_logistic_regression_solves_the_summed_ridge_problem(spark):
    df = panel(spark).select("label", "x").cache()
    weights = modeling.class_weights(df)
    n = df.count()
    spec = modeling.build_models(n)["logistic_regression"]
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(df.withColumn("weight", modeling.weight_column(weights)))
    model = spec.estimator.fit(data)
    rows = df.collect()
    x = np.array([[1.0, r.x] for r in rows])
    y = np.array([r.label for r in rows])
    s = np.array([weights[v] for v in y])
    beta = np.zeros(2)
    ridge = np.diag([0.0, 1.0])
    for _ in range(50):  # Newton steps on sum(weight * loss) + |slope|^2 / 2
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (s * (p - y)) + ridge @ beta
        beta -= np.linalg.solve((x * (s * p * (1 - p))[:, None]).T @ x + ridge, gradient)
    assert model.intercept == pytest.approx(beta[0], abs=1e-4) and model.coefficients[0] == pytest.approx(beta[1], abs=1e-4)


def test_comparison(spark):
    sizes = modeling.ModelSizes(50, 5, 3, 3, 2)
    df = panel(spark)
    result = compare({"small": Setup(df, ("u",)), "large": Setup(df, ("u", "x", "empty"))}, sizes, min_dates=10)
    assert result.split_date == day(64)
    assert result.features == {"small": ["u"], "large": ["u", "x"]}
    assert result.metrics.count() == 6
    scores = {(r.feature_setup, r.model_name): r.auc_roc for r in result.metrics.collect()}
    assert scores["large", "logistic_regression"] > scores["small", "logistic_regression"] + 0.1
    best = {r.feature_setup: r.best_model for r in result.best.collect()}
    rows = result.best_predictions().collect()
    assert len(rows) == 2 * 48 and {(r.feature_setup, r.model_name) for r in rows} == set(best.items())
    assert len({(r.ticker, r.date, r.feature_setup) for r in rows}) == len(rows)
    assert result.tidy().count() == 6 * 10
    assert result.column_report().where("not used").count() == 1
    assert {r.part: r.row_count for r in result.summary.where("feature_setup = 'small'").collect()} == {"train": 192, "test": 48}


def test_models_are_built_for_the_rows_that_are_fitted(spark, monkeypatch):
    counts, fitted = [], []
    monkeypatch.setattr(comparison, "build_models", lambda n, sizes: counts.append(n) or modeling.build_models(n, sizes))
    monkeypatch.setattr(modeling, "fitting_rows", lambda *a, f=modeling.fitting_rows: fitted.append(f(*a).count()) or f(*a))
    compare({"small": Setup(panel(spark), ("u",))}, modeling.ModelSizes(50, 5, 3, 3, 2), models=["logistic_regression"], min_dates=10, fit_rows=100)
    assert counts == fitted and 50 < counts[0] < 150


@pytest.mark.parametrize("fit_rows", [40, 70_000])
def test_a_bounded_sample_leaves_the_scan_to_many_tasks(spark, monkeypatch, fit_rows):
    seen = []
    monkeypatch.setattr(modeling, "cut_lineage", lambda df: seen.append(df) or df)
    rows = spark.range(0, 400, 1, 8).select("id", (F.col("id") % 2).cast("int").alias("label"), (F.col("id") * 1.5).alias("x"))
    specs = {"logistic_regression": modeling.build_models(400)["logistic_regression"]}
    modeling.fit_and_predict(rows, rows, ["x"], ["id"], specs, fit_rows)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "Exchange" in plan
    assert seen[0].rdd.getNumPartitions() == math.ceil(fit_rows / modeling.FIT_PARTITION_ROWS)
