"""Quantiles by counting ranges: equal to sorted arrays, little is shuffled, few rows reach the driver."""

import numpy as np
import pytest
from helpers import day
from pyspark.sql import functions as F

from tidemark.operators import foldmodels, quantiles, validation


def test_order_keys_follow_the_numbers():
    x = np.array([-np.inf, -1e300, -2.0, -1.5, -5e-324, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2.0), 1e300, np.inf])
    keys = quantiles.order_keys(x)
    assert (np.diff(keys.astype(object)) > 0).all()
    assert [quantiles._value(int(k)) for k in keys] == x.tolist()
    assert quantiles.order_keys(np.array([-0.0])) == quantiles.order_keys(np.array([0.0]))


@pytest.mark.parametrize("gather_rows", [0, 3, 100_000])
def test_extreme_values_and_heavy_ties(spark, gather_rows):
    x = [float("-inf"), -1e300, -3.0, -3.0, -0.0, 0.0, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 1e300, float("inf"), *[7.0] * 40, *[7.0 + k * 2.0**-50 for k in range(1, 9)]]
    df = spark.createDataFrame([(v,) for v in x], "x double").repartition(3)
    probs = [k / (len(x) - 1) for k in range(1, len(x) - 1)]
    assert quantiles.exact_quantiles(df, ["x"], probs, gather_rows)["x"] == pytest.approx(sorted(x)[1:-1], abs=0, rel=1e-15)


def test_passes_move_counters_and_not_sketches(spark, monkeypatch):
    """The old sketches sent ten thousand numbers per column and partition to one task; ranges send what is counted."""
    df = spark.range(200_000, numPartitions=8).select(*[F.sin(F.col("id") * (k + 1)).alias(f"x{k}") for k in range(4)])
    seen = []
    hits = quantiles._hits
    monkeypatch.setattr(quantiles, "_hits", lambda *a: seen.append(hits(*a)) or seen[-1])
    found = quantiles.exact_quantiles(df, df.columns, [0.01, 0.5, 0.99], gather_rows=1000)
    for k in range(4):
        assert found[f"x{k}"] == pytest.approx(np.quantile(np.sin(np.arange(200_000) * (k + 1.0)), [0.01, 0.5, 0.99]).tolist(), abs=1e-12)
    assert len(seen) <= 3 and all(len(rows) <= 4 * 6 for rows in seen)


def test_scales_of_folds_count_gaps_as_their_median(spark):
    rng = np.random.default_rng(3)
    for size, gaps in ((1, 4), (2, 1), (7, 0), (8, 3), (9, 30), (50, 7)):
        x = rng.normal(size=size).round(1)
        rows = [(day(0), float(v)) for v in x] + [(day(0), None)] * gaps
        folds = [validation.Fold(1, day(0), day(1), day(1), None)]
        member = foldmodels.with_folds(spark.createDataFrame(rows, "date date, x double"), folds)
        p = foldmodels.prepare_folds(member, folds, ["x"])[1]
        lo, mid, hi = np.quantile(x, [0.01, 0.5, 0.99])
        filled = np.concatenate([np.clip(x, lo, hi), np.full(gaps, mid)])
        q = np.quantile(filled, [0.25, 0.5, 0.75])
        assert (p.low[0], p.fill[0], p.high[0]) == pytest.approx((lo, mid, hi))
        assert (p.center[0], p.scale[0]) == pytest.approx((q[1], (q[2] - q[0]) or 1.0))


def test_rows_of_overlapping_groups_are_sent_once(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 10 == 0).alias("null_group"))
    groups = {1: F.col("x") < 500, 2: F.col("x") >= 250, 3: F.lit(None).cast("boolean")}
    found = foldmodels.grouped_quantiles(df, groups, ["x"], [0.5], gather_rows=10)
    assert found == {1: {"x": [249.5]}, 2: {"x": [624.5]}, 3: {"x": [None]}}
    wide, *_ = foldmodels._per_group(df, groups, ["x"])
    assert len(wide.columns) == 1 + len(groups)  # not one column per group and column


def test_a_fold_is_decided_by_constants(spark):
    rows = spark.createDataFrame([(day(0), day(1))], "date date, label_end date")
    folds = [validation.Fold(k, day(0), day(k), day(k), None) for k in range(1, 9)]
    plan = validation.assign_folds(rows, folds, label_end="label_end")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "filter(" not in plan.lower().replace("filter (", "")
