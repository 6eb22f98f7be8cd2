import bisect
import random

import pytest
from helpers import day, sorted_rows
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join

LEFT, RIGHT = "id int, k string, d date", "k string, f date, tie string, v int"


def test_edges(spark):
    left = spark.createDataFrame([(1, "a", day(0)), (2, "a", day(5)), (3, "a", day(7)), (4, "b", day(9)), (5, None, day(9)), (6, "a", None)], LEFT)
    right = spark.createDataFrame(
        [("a", day(5), "x", 1), ("a", day(5), "y", 2), ("a", day(8), "x", 3), ("c", day(1), "x", 4), ("a", None, "x", 5), (None, day(1), "x", 6)], RIGHT
    )
    for how in (None, 1, 100):
        got = asof_join(left, right, ["k"], "d", "f", ties=["tie"], right_columns=["f", "v"], prefix="r_", rows_per_segment=how)
        assert got.columns == ["id", "k", "d", "r_f", "r_v"]
        assert {r.id: (r.r_f, r.r_v) for r in got.collect()} == {
            1: (None, None), 2: (day(5), 2), 3: (day(5), 2), 4: (None, None), 5: (None, None), 6: (None, None),
        }, how


def test_null_tie_counts_as_greatest(spark):
    left = spark.createDataFrame([(1, "a", day(3))], LEFT)
    right = spark.createDataFrame([("a", day(1), None, 1), ("a", day(1), "z", 2)], RIGHT)
    for how in (None, 1):
        assert asof_join(left, right, ["k"], "d", "f", ties=["tie"], rows_per_segment=how).first().v == 1


def test_name_clash_and_type_mismatch(spark):
    left = spark.createDataFrame([(1, "a", day(3))], LEFT)
    right = spark.createDataFrame([("a", day(1), 1)], "k string, f date, id int")
    with pytest.raises(ValueError, match="set a prefix: id"):
        asof_join(left, right, ["k"], "d", "f")
    with pytest.raises(TypeError):
        asof_join(left, right.withColumn("f", F.col("f").cast("timestamp")).drop("id"), ["k"], "d", "f")


@pytest.mark.parametrize("rows_per_segment", [None, 5, 30, 10_000])
def test_random_against_search(spark, rows_per_segment):
    random.seed(11)
    keys = ["hot"] * 12 + ["b", "c", None]
    left = [(i, random.choice(keys), random.choice([None, *range(300), *[77] * 60])) for i in range(600)]
    right = [(random.choice(keys), random.choice([None, *range(300), *[77] * 20]), random.randrange(50), i) for i in range(300)]
    got = asof_join(
        spark.createDataFrame(left, "id int, k string, t int"),
        spark.createDataFrame(right, "k string, t2 int, tie int, v int"),
        ["k"], "t", "t2", ties=["tie", "v"], rows_per_segment=rows_per_segment,
    )
    known = {}
    for k, t, tie, v in right:
        if k is not None and t is not None:
            known.setdefault(k, []).append((t, tie, v))
    expected = []
    for i, k, t in left:
        rows = sorted(known.get(k, []))
        at = bisect.bisect_right(rows, (t, 10**9, 0)) if t is not None else 0
        expected.append((i, k, t, *((rows[at - 1]) if at else (None, None, None))))
    assert len(got.columns) == 6
    assert sorted_rows(got) == sorted(expected, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_one_hot_instant_is_split_and_keeps_its_winner(spark):
    left = spark.range(400).select(F.col("id"), F.lit("a").alias("k"), F.lit(7).alias("t"))
    right = spark.range(300).select(F.lit("a").alias("k"), F.lit(7).alias("u"), F.col("id").alias("v"))
    got = asof_join(left, right, ["k"], "t", "u", ties=["v"], rows_per_segment=20)
    assert {r.v for r in got.collect()} == {299} and got.count() == 400
