import random

from helpers import day
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import series
from tidemark.operators import trailing
from tidemark.operators.trailing import trailing_frames
from tidemark.plans.features import market_features

FRAMES = {"m3": ("mean", "x", 3), "m1": ("mean", "x", 1), "d2": ("deviation", "x", 2), "d5": ("deviation", "x", 5)}


def _rows(seed=3):
    rng = random.Random(seed)
    odd = [None, float("nan"), float("inf"), -0.0, 1e300, 0.1]
    out = []
    for key, n in (("a", 40), ("b", 4), ("c", 1), (None, 12), ("d", 30)):
        for k in rng.sample(range(100), n):
            x = 0.1 if key == "d" else rng.choice(odd) if rng.random() < 0.2 else rng.gauss(0, 100)
            out.append((key, day(k), x))
    rng.shuffle(out)
    return out


def test_frames_agree_with_windows_to_the_last_bit(spark, monkeypatch):
    monkeypatch.setattr(trailing, "blocks", lambda batches: (b.slice(at, 7) for b in batches for at in range(0, len(b), 7)))
    df = spark.createDataFrame(_rows(), "key string, date date, x double").repartition(3)
    w = Window.partitionBy("key").orderBy("date")
    plain = {"mean": series.trailing_mean, "deviation": series.trailing_std}
    want = df.select("*", *[plain[kind](c, n, w).alias(name) for name, (kind, c, n) in FRAMES.items()])
    text = lambda d: sorted(map(str, d.select("key", "date", *[F.hex(F.col(n).cast("string").cast("binary")) for n in ("x", *FRAMES)]).collect()))
    got = trailing_frames(df, ["key"], ["date"], FRAMES)
    assert text(got) == text(want)
    assert {r.d5 for r in got.where("key = 'd' AND d5 IS NOT NULL").collect()} == {0.0}


def test_market_features_work_no_frame_out_row_by_row(spark):
    df = spark.createDataFrame(_rows(), "ticker string, date date, adj_close double").withColumn("volume", F.lit(1.0))
    plan = market_features(df)._jdf.queryExecution().executedPlan().toString()
    assert "stddev_samp" not in plan and "avg(" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
