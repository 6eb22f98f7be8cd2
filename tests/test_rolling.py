import datetime as dt
import random

import pytest
from helpers import day, sorted_rows, values

from tidemark.operators import rolling
from tidemark.plans.features import sentiment_momentum


def _plain(left, events, days):
    gap = dt.timedelta(days=days)
    return sorted(
        ((k, t, n, None if k is None or t is None else sum(e[0] == k and e[1] is not None and t - gap < e[1] <= t for e in events)) for k, t, n in left),
        key=lambda r: tuple((x is None, str(x)) for x in r),
    )


@pytest.mark.parametrize("how", [dict(rows_per_segment=None), dict(), dict(rows_per_segment=6, hot_rows=0), dict(rows_per_segment=50, hot_rows=80)])
@pytest.mark.parametrize("kind,days", [("date", 3), ("timestamp", 1.5)])
def test_counts_against_plain_python(spark, how, kind, days):
    rng = random.Random(3)

    def when():
        if rng.random() < 0.04:
            return None
        return day(rng.randrange(30)) if kind == "date" else dt.datetime(2020, 1, 1) + dt.timedelta(hours=6 * rng.randrange(120))

    left = [(rng.choice(["a", "b", "c", None]), when(), n) for n in range(200)]
    events = [(rng.choice(["a", "a", "a", "b", None]), when()) for _ in range(300)]
    found = rolling.trailing_counts(
        spark.createDataFrame(left, f"k string, at {kind}, n int"), spark.createDataFrame(events, f"k string, seen {kind}"), ["k"], "at", "seen", days, "count", **how
    )
    assert found.columns == ["k", "at", "n", "count"]
    assert sorted_rows(found) == _plain(left, events, days)


def test_empty_tables_and_names(spark):
    left = spark.createDataFrame([("a", day(1))], "k string, at date")
    none = spark.createDataFrame([], "k string, seen date")
    assert sorted_rows(rolling.trailing_counts(left, none, ["k"], "at", "seen", 5, "count")) == [("a", day(1), 0)]
    with pytest.raises(ValueError):
        rolling.trailing_counts(left, none, ["k"], "at", "seen", 5, "at")
    with pytest.raises(ValueError):
        rolling.trailing_counts(left, none, ["k"], "at", "seen", 0.5, "count")


def test_momentum_of_a_stepping_score(spark):
    scores = [None, 1.0, 1.0, 1.0, 1.0, 1.0, 3.0, 3.0, 3.0, 3.0, 3.0, 3.0]
    frame = spark.createDataFrame([("a", day(n), s) for n, s in enumerate(scores)], "ticker string, date date, sec_sentiment_score double")
    for rows_per_segment in (None, 3):
        found = sorted(values(sentiment_momentum(frame, rows_per_segment=rows_per_segment), "date", "sentiment_change_5d", "sentiment_momentum_5d"))
        assert [r[1] for r in found] == [None] * 6 + [2.0] * 5 + [0.0]
        assert [r[2] and round(r[2], 9) for r in found] == [None] * 10 + [2.0, 1.6]
