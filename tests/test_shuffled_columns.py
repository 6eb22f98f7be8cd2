import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import importance, metrics


def test_rows_are_numbered_once_and_travel_without_their_keys(spark, monkeypatch):
    written = []
    cut = importance.cut_lineage
    monkeypatch.setattr(importance, "cut_lineage", lambda df: written.append(df) or cut(df))
    frame = spark.createDataFrame([(f"k{k}", k, k % 2, float(k), float(-k)) for k in range(30)], "key string, n int, label int, a double, b double")
    importance.permutation_importance(frame, ["key", "n"], ["a", "b"], "label", lambda v: v("a") + v("b"))
    assert [df.columns for df in written[:3]] == [["label", "a", "b", "__at"], ["__other0", "__at"], ["__other1", "__at"]]
    assert len(written) == 4


def test_key_column_and_label_may_be_shuffled_too(spark):
    frame = spark.createDataFrame([(k, k % 2, float(k)) for k in range(30)], "n int, label int, a double")
    found = importance.permutation_importance(frame, ["n"], ["n", "a"], "label", lambda v: v("n") + v("a")).collect()
    assert sorted(r["column_name"] for r in found) == ["a", "n"]


@pytest.mark.parametrize("rows_per_bucket", [7, 10**6])
def test_areas_of_groups_in_sorted_batches(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(metrics, "blocks", lambda batches: (b.slice(at, 5) for b in batches for at in range(0, len(b), 5)))
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([0, 1, 1]), rng.choice([round(rng.random(), 1), -0.0, 0.0, float("inf"), None, float("nan")])) for _ in range(400)]
    rows += [("only", 1, 1, 0.5)]
    frame = spark.createDataFrame(rows, "g string, h int, label int, predicted_probability double").repartition(3)
    found = {(r.g, r.h): r.auc_roc for r in metrics.auc(frame, ["g", "h"], rows_per_bucket=rows_per_bucket).collect()}
    for g, h in {r[:2] for r in rows}:
        mine = [r for r in rows if r[:2] == (g, h) and r[3] is not None and not np.isnan(r[3])]
        pairs = [(x[3] > y[3]) + 0.5 * (x[3] == y[3]) for x in mine for y in mine if x[2] == 1 and y[2] == 0]
        assert found[g, h] == pytest.approx(sum(pairs) / len(pairs)) if pairs else found[g, h] is None
    plan = metrics.auc(frame, ["g", "h"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Window [") == 1
    assert metrics.auc(frame.drop("g", "h")).count() == 1
