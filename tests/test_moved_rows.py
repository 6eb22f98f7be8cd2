"""Plans that must not move rows, or work out hashes, more often than needed."""

from helpers import day, sorted_rows
from pyspark.sql import functions as F

from tidemark.operators import bitemporal, ensembles, segments


def test_keys_that_are_all_hot_need_no_join(spark, monkeypatch):
    rows = spark.range(200).select((F.col("id") % 4).alias("k"), "id")
    written = []
    cut = segments.cut_lineage
    monkeypatch.setattr(segments, "cut_lineage", lambda df: written.append(df) or cut(df))
    all_hot = segments.assign_segments(rows, ["k"], [F.col("id")], 20, hot_rows=0)
    assert "Join" not in written[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in all_hot._jdf.queryExecution().optimizedPlan().toString()
    assert all_hot.columns == ["k", "id", segments.SEG] and all_hot.count() == 200
    assert all_hot.groupBy("k").agg(F.countDistinct(segments.SEG).alias("n")).where("n > 1").count() >= 3
    some = segments.assign_segments(rows.where("k > 0 OR id < 8"), ["k"], [F.col("id")], 20, hot_rows=10)
    assert sorted_rows(some.where(F.col(segments.SEG).isNull()).select("k", "id")) == [(0, 0), (0, 4)]
    assert some.count() == 152


def test_versions_are_dealt_once_after_the_newest_facts(spark):
    facts = spark.createDataFrame(
        [("a", day(0), day(k), c, float(k), "f") for k in range(4) for c in ("x", "y") if (k, c) != (2, "x")],
        "ticker string, period date, filed date, concept string, value double, form string",
    )
    for together in (None, ["ticker"]):
        made = bitemporal.versions(facts, ["ticker", "period"], "filed", ["filed", "form"], "concept", "value", ["x", "y"], ["value"], together)
        per_day = made.groupBy("ticker", *([] if together else ["period"]), "filed").agg(F.max("x").alias("x"), F.max("y").alias("y"))
        assert sorted_rows(per_day.select("filed", "x", "y")) == [(day(0), 0.0, 0.0), (day(1), 1.0, 1.0), (day(2), 1.0, 2.0), (day(3), 3.0, 3.0)]
        plan = per_day._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # the newest facts, and one deal for all that follows


def test_a_draw_hashes_once(spark):
    drawn = spark.range(50).select(ensembles.draws(["id"], 3).alias("n"), ensembles.uniform(["id"], 3).alias("u"))
    assert all(r["n"] == sum(r["u"] >= p for p in ensembles._POISSON) for r in drawn.collect())
    assert drawn.select("n")._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
