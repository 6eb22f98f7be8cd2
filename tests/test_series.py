import math
import random
import statistics

import pytest
from helpers import day, sorted_rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import series
from tidemark.operators.segments import SEG, assign_segments, over_series
from tidemark.plans.features import MARKET_FEATURES, forward_labels, market_features, statement_features


@pytest.fixture(scope="module", autouse=True)
def key_window(spark):
    global W
    W = Window.partitionBy("k").orderBy("t")


def frame(spark, numbers):
    return spark.createDataFrame([("a", i, x) for i, x in enumerate(numbers)], "k string, t int, x double")


def column(df, expr):
    return [r.y for r in df.select("t", expr.alias("y")).orderBy("t").collect()]


def test_growth_edges(spark):
    got = column(frame(spark, [0.0, 5.0, -2.0, -1.0]), series.growth("x", 1, W))
    assert got == [None, None, -1.4, -0.5]
    assert column(frame(spark, [1.0, 2.0]), series.growth("x", 4, W)) == [None, None]


def test_forward_return_and_average(spark):
    df = frame(spark, [2.0, 3.0, None, 0.0, 1.0])
    assert column(df, series.forward_return("x", 1, W)) == [0.5, None, None, math.inf, None]
    assert column(df, series.average_balance("x", W)) == [None, 2.5, None, None, 0.5]


def test_trailing_needs_a_full_frame(spark):
    assert column(frame(spark, [1.0, 2.0]), series.trailing_mean("x", 3, W)) == [None, None]
    assert column(frame(spark, [1.0, 2.0, 6.0]), series.trailing_mean("x", 3, W)) == [None, None, 3.0]
    assert column(frame(spark, [1.0, None, 6.0, 2.0]), series.trailing_mean("x", 3, W)) == [None] * 4
    constant = frame(spark, [4.0] * 4)
    assert column(constant, series.trailing_std("x", 3, W))[2:] == [0.0, 0.0]
    assert column(constant, series.trailing_zscore("x", 3, W)) == [None] * 4
    assert column(constant, series.ratio_to_trailing_mean("x", 3, W))[2:] == [1.0, 1.0]


def rsi(spark, prices):
    df = frame(spark, prices).withColumn("move", series.diff("x", W))
    return column(df, series.rsi("move", 14, W))


def test_rsi(spark):
    random.seed(3)
    prices = [100 + random.random() for _ in range(15)]
    moves = [b - a for a, b in zip(prices, prices[1:])]
    up = statistics.fmean(max(m, 0) for m in moves)
    down = statistics.fmean(max(-m, 0) for m in moves)
    assert rsi(spark, prices[:14]) == [None] * 14
    got = rsi(spark, prices)
    assert got[:14] == [None] * 14 and got[14] == pytest.approx(100 - 100 / (1 + up / down))
    assert rsi(spark, [float(i) for i in range(15)])[-1] is None
    assert rsi(spark, [float(-i) for i in range(15)])[-1] == 0.0


def uneven_series(spark, seed=1):
    """One key with most rows, a burst inside it, and two small keys."""
    random.seed(seed)
    rows = [("hot", i * 50, random.random()) for i in range(400)]
    rows += [("hot", 10_001 + i, random.random()) for i in range(40)]
    rows += [("mid", i * 1000, random.random()) for i in range(30)]
    rows += [("one", 5, 1.0)]
    return spark.createDataFrame(rows, "k string, t bigint, x double")


def windows(df, w):
    step = df.withColumn("d", series.diff("x", w))
    return step.select(
        "k", "t", "x", "d",
        F.round(series.trailing_mean("d", 7, w), 9).alias("m"),
        F.round(series.trailing_std("x", 8, w), 9).alias("s"),
        series.shift("x", -5, w).alias("ahead"),
    )


@pytest.mark.parametrize("rows_per_segment", [3, 20, 100])
def test_split_windows_equal_plain_windows(spark, rows_per_segment):
    df = uneven_series(spark)
    plain = over_series(df, ["k"], ["t"], windows, rows_per_segment=None)
    split = over_series(df, ["k"], ["t"], windows, back=8, ahead=5, rows_per_segment=rows_per_segment)
    assert sorted_rows(split) == sorted_rows(plain)


def largest(cut):
    return max(r.n for r in cut.groupBy("k", SEG).agg(F.count("*").alias("n")).collect())


def test_segments_are_small_and_ordered(spark):
    df = uneven_series(spark)
    cut = assign_segments(df, ["k"], [F.col("t")], 40).cache()
    sizes = {(r.k, r[SEG]): r.n for r in cut.groupBy("k", SEG).agg(F.count("*").alias("n")).collect()}
    assert sizes[("mid", None)] == 30 and sizes[("one", None)] == 1
    assert max(n for (k, _), n in sizes.items() if k == "hot") <= 80
    order = [r[SEG] for r in cut.where("k = 'hot'").orderBy("t").collect()]
    assert order == sorted(order)


def test_common_prefixes_outliers_and_hashed_ties(spark):
    """Cuts follow the rows, not the span of the first order column or the first bytes of a text."""
    prefix = spark.range(200).select(F.lit("k").alias("k"), F.lit(7).alias("t"), F.format_string("0000320193-%05d", "id").alias("a"))
    assert largest(assign_segments(prefix, ["k"], [F.col("t"), F.col("a")], 10)) <= 30
    outliers = spark.range(4000).select(F.lit("k").alias("k"), F.when(F.col("id") < 2, F.col("id") - 10**12).otherwise(F.col("id")).alias("t"))
    assert largest(assign_segments(outliers, ["k"], [F.col("t")], 100)) <= 300
    hashed = spark.range(1000).select(F.lit("k").alias("k"), F.lit(7).alias("t"), F.xxhash64("id").alias("h"))
    assert largest(assign_segments(hashed, ["k"], [F.col("t"), F.col("h")], 100)) <= 300


def test_rows_without_a_key_are_cut_too(spark):
    df = spark.range(200).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    assert largest(assign_segments(df, ["k"], [F.col("t")], 10)) <= 30
    plain = over_series(df, ["k"], ["t"], windows, rows_per_segment=None)
    split = over_series(df, ["k"], ["t"], windows, back=8, ahead=5, rows_per_segment=10)
    assert sorted_rows(split) == sorted_rows(plain)


def test_one_instant_is_cut_along_the_next_order_column(spark):
    rows = [("k", day(1), f"doc-{random.randrange(10**6):06d}-{i}" if i % 50 else None, float(i)) for i in range(600)]
    rows += [("k", day(9), "late", -1.0), ("k", day(0), "early", -2.0)]
    df = spark.createDataFrame(rows, "k string, d date, a string, x double")
    unique = df.groupBy("k", "d", "a").agg(F.max("x").alias("x"))

    def change(frame, w):
        return frame.withColumn("y", series.diff("x", w))

    plain = over_series(unique, ["k"], ["d", "a"], change, rows_per_segment=None)
    split = over_series(unique, ["k"], ["d", "a"], change, back=1, rows_per_segment=30)
    assert sorted_rows(split) == sorted_rows(plain)
    assert largest(assign_segments(unique, ["k"], [F.col("d"), F.col("a")], 30)) <= 90


def test_market_features_do_not_look_ahead(spark):
    random.seed(5)
    rows = [("a", day(i), 50 + random.random(), 1000.0 + random.randrange(100)) for i in range(60)]
    bars = spark.createDataFrame(rows, "ticker string, date date, adj_close double, volume double")
    full = {r.date: tuple(r) for r in market_features(bars).collect()}
    cut = market_features(bars.where(F.col("date") <= F.lit(day(40))))
    assert all(full[r.date] == tuple(r) for r in cut.collect())
    assert all(v is not None for v in full[day(59)])
    split = market_features(bars, rows_per_segment=4)
    assert split.columns == ["ticker", "date", *MARKET_FEATURES]
    for r in split.collect():
        assert list(r)[2:] == [x if x is None else pytest.approx(x) for x in full[r.date][2:]]


def test_labels_are_computed_before_trimming(spark):
    bars = spark.createDataFrame([("a", day(i), float(10 + (i % 3)), 1.0) for i in range(12)], "ticker string, date date, adj_close double, volume double")
    got = forward_labels(bars, horizon=(str(day(0)), str(day(6)))).orderBy("date").collect()
    assert [r.label for r in got] == [1, 0, 0, 1, 0, 0, 1]
    assert [r.label for r in forward_labels(bars).orderBy("date").collect()][-5:] == [None] * 5


def test_statement_features_with_absent_concepts(spark):
    rows = [("a", day(90 * i), 100.0 + i, 10.0, 50.0, 25.0) for i in range(6)]
    wide = spark.createDataFrame(rows, "ticker string, period_end date, revenue double, net_income double, total_assets double, current_liabilities double")
    got = statement_features(wide).orderBy("period_end").collect()
    assert got[0].net_margin == 0.1 and got[0].roa is None and got[1].roa == 0.2
    assert got[4].revenue_growth_yoy == pytest.approx(0.04) and got[3].revenue_growth_yoy is None
    assert all(r.gross_margin is None and r.current_ratio is None for r in got)
    assert "inventory" not in got[0].asDict()
