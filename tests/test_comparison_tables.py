import os
import re

import numpy as np
import pytest
from helpers import day

from tidemark.operators import modeling
from tidemark.plans import comparison
from tidemark.plans.comparison import Setup, compare
from tidemark.queries import modeling as queries
from tidemark.queries.registry import Tables


def panel(spark, n=240):
    rng = np.random.default_rng(9)
    rows = [(f"t{i % 3}", day(i // 3), 0.0, i % 2, float(x), float(u)) for i, (x, u) in enumerate(rng.normal(size=(n, 2)))]
    return spark.createDataFrame(rows, "ticker string, date date, forward_return_5d double, label int, x double, u double")


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_a_shared_panel_is_written_once_and_goes(spark, monkeypatch, limit):
    paths = []
    monkeypatch.setattr(comparison, "SIDE_BY_SIDE_ROWS", limit)
    monkeypatch.setattr(comparison, "written", lambda df, f=comparison.written: paths.append(f(df)) or paths[-1])
    df = panel(spark)
    result = compare({"small": Setup(df, ("u",)), "large": Setup(df, ("x", "u"))}, modeling.ModelSizes(50, 3, 2, 2, 2))
    assert len(paths) == 1 and not os.path.exists(paths[0][1].removeprefix("file:"))
    assert result.metrics.count() == 6 and result.summary.count() == 4
    assert result.predictions.count() == 6 * 48 and result.best_predictions().count() == 2 * 48
    assert result.features == {"small": ["u"], "large": ["x", "u"]}


def test_panels_are_dealt_by_key_once(spark):
    setup = queries._market_setups(Tables(spark, "/root/testdata/sf0.001"))["layer1_plus_layer2_full"]
    text = setup.panel._jdf.queryExecution().executedPlan().toString()
    # bars: by day, then by ticker; facts: newest per concept, per period, then by ticker; neither the join nor the features add one
    assert len(re.findall(r"Exchange (\w+)\(", text)) == 5 and "MapInArrow" in text
