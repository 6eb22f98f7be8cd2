import datetime as dt
import random

import pytest
from helpers import day, sorted_rows, values

from tidemark.operators import bitemporal, durations
from tidemark.plans.panels import clean_fundamentals, fundamental_versions
from tidemark.sources.facts import flatten_facts

D = dt.date


def _random_sides(seed, n=300):
    rng = random.Random(seed)
    right = [(rng.choice("ab") if rng.random() < 0.95 else None, day(rng.randrange(40)) if rng.random() < 0.95 else None, rng.choice([None, *range(6)]), k) for k in range(n)]
    left = [(rng.choice("abc"), day(rng.randrange(45)) if rng.random() < 0.95 else None, k) for k in range(n)]
    return left, right


def _plain(left, right):
    out = []
    for key, at, n in left:
        seen = [r for r in right if r[0] == key and r[1] is not None and at is not None and r[1] <= at]
        best = max(seen, key=lambda r: (r[2] is not None, r[2] or 0, r[1], r[3]), default=(None, None, None, None))
        out.append((key, at, n, best[1], best[2], best[3]))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("how", [dict(rows_per_segment=None), dict(), dict(rows_per_segment=7, hot_rows=0), dict(rows_per_segment=40, hot_rows=100)])
def test_newest_period_known_against_plain_python(spark, how):
    left, right = _random_sides(4)
    found = bitemporal.as_known_join(
        spark.createDataFrame(left, "k string, at date, n int"), spark.createDataFrame(right, "k string, filed date, period int, id int"), ["k"], "at", "filed", ["period"], **how
    )
    assert found.columns == ["k", "at", "n", "filed", "period", "id"]
    assert sorted_rows(found) == _plain(left, right)


def test_clashing_names_and_empty_sides(spark):
    left = spark.createDataFrame([("a", day(1), 1)], "k string, at date, filed int")
    right = spark.createDataFrame([], "k string, filed date, period int")
    with pytest.raises(ValueError):
        bitemporal.as_known_join(left, right, ["k"], "at", "filed", ["period"])
    assert sorted_rows(bitemporal.as_known_join(left, right, ["k"], "at", "filed", ["period"], prefix="r_")) == [("a", day(1), 1, None, None)]


def _facts(rows):
    return [("T", "1", filed, period, "FY", 2020, "10-K", concept, value, "USD", "s") for filed, period, concept, value in rows]


FACTS = "ticker string, cik string, filing_date date, period_end date, fiscal_period string, fiscal_year long, form_type string, concept_name string, value double, unit string, source string"


def test_versions_carry_what_was_known(spark):
    rows = _facts(
        [
            (D(2020, 2, 1), D(2019, 12, 31), "revenue", 10.0), (D(2020, 2, 1), D(2019, 12, 31), "net_income", 1.0), (D(2020, 8, 1), D(2019, 12, 31), "revenue", 12.0),
            (D(2020, 8, 1), D(2019, 12, 31), "net_income", None), (D(2021, 2, 1), D(2020, 12, 31), "revenue", 20.0), (D(2021, 5, 1), D(2019, 12, 31), "net_income", 2.0),
        ]
    )
    frame = spark.createDataFrame(rows, FACTS)
    known = fundamental_versions(frame, ["revenue", "net_income"])
    assert sorted(values(known, "period_end", "filing_date", "revenue", "net_income"), key=str) == [
        (D(2019, 12, 31), D(2020, 2, 1), 10.0, 1.0), (D(2019, 12, 31), D(2020, 8, 1), 12.0, 1.0), (D(2019, 12, 31), D(2021, 5, 1), 12.0, 2.0), (D(2020, 12, 31), D(2021, 2, 1), 20.0, None),
    ]
    days = spark.createDataFrame([("T", d) for d in (D(2020, 1, 1), D(2020, 3, 1), D(2020, 9, 1), D(2021, 6, 1))], "ticker string, date date")
    panel = bitemporal.as_known_join(days, known, ["ticker"], "date", "filing_date", ["period_end"])
    # the late correction of the old period hides nothing
    assert sorted(values(panel, "date", "period_end", "revenue"), key=str) == [
        (D(2020, 1, 1), None, None), (D(2020, 3, 1), D(2019, 12, 31), 10.0), (D(2020, 9, 1), D(2019, 12, 31), 12.0), (D(2021, 6, 1), D(2020, 12, 31), 20.0),
    ]
    first = clean_fundamentals(frame.dropna(subset=["value"]), ["revenue", "net_income"], keep="first")
    assert sorted(values(first, "period_end", "filing_date", "revenue", "net_income"), key=str) == [(D(2019, 12, 31), D(2020, 2, 1), 10.0, 1.0), (D(2020, 12, 31), D(2021, 2, 1), 20.0, None)]
    with pytest.raises(ValueError):
        clean_fundamentals(frame, keep="any")


SPAN = "ticker string, concept_name string, period_start date, period_end date, value double, filing_date date"


def _quarters(spark, rows):
    frame = spark.createDataFrame([("T", "c", *r) for r in rows], SPAN)
    return sorted(values(durations.quarterly(frame, ties=["value"]), "period_start", "period_end", "value", "filing_date", "origin"))


Q = [(D(2020, 1, 1), D(2020, 3, 31)), (D(2020, 4, 1), D(2020, 6, 30)), (D(2020, 7, 1), D(2020, 9, 30)), (D(2020, 10, 1), D(2020, 12, 31))]
YEAR = D(2020, 1, 1)


def test_differences_of_the_year_so_far(spark):
    rows = [(YEAR, e, v, e + dt.timedelta(30)) for (_, e), v in zip(Q, (1.0, 3.0, 6.0, 10.0))]
    assert _quarters(spark, rows) == [
        (*Q[0], 1.0, D(2020, 4, 30), "reported"), (*Q[1], 2.0, D(2020, 7, 30), "difference"), (*Q[2], 3.0, D(2020, 10, 30), "difference"), (*Q[3], 4.0, D(2021, 1, 30), "difference"),
    ]
    # a missing amount leaves a step of two quarters, which is none
    assert [r[4] for r in _quarters(spark, [rows[0], rows[2], rows[3]])] == ["reported", "difference"]


def test_remainder_of_a_year(spark):
    reported = [(*q, v, q[1] + dt.timedelta(20)) for q, v in zip(Q[:3], (1.0, 2.0, 3.0))]
    year = (YEAR, D(2020, 12, 31), 10.0, D(2021, 2, 1))
    assert _quarters(spark, [*reported, year])[-1] == (*Q[3], 4.0, D(2021, 2, 1), "remainder")
    assert len(_quarters(spark, [reported[0], reported[2], year])) == 2  # two quarters leave two
    assert _quarters(spark, [*reported, (*Q[3], 5.0, D(2021, 1, 5)), year])[-1] == (*Q[3], 5.0, D(2021, 1, 5), "reported")
    # the last filed amount of a span counts, also when it is only an input
    late = [*reported, (*Q[0], 1.5, D(2021, 6, 1)), year]
    assert _quarters(spark, late)[-1] == (*Q[3], 3.5, D(2021, 6, 1), "remainder")


def test_spans_that_take_no_part(spark):
    assert _quarters(spark, [(None, D(2020, 3, 31), 1.0, D(2020, 4, 1)), (YEAR, None, 1.0, D(2020, 4, 1)), (*Q[0], None, D(2020, 4, 1)), (YEAR, D(2020, 1, 31), 1.0, D(2020, 4, 1))]) == []
    assert _quarters(spark, []) == []
    named = durations.with_duration(spark.createDataFrame([(YEAR, D(2020, 6, 30)), (None, YEAR), (YEAR, D(2020, 2, 1)), (YEAR, D(2020, 9, 30)), (YEAR, D(2020, 12, 31))], "period_start date, period_end date"))
    assert values(named, "duration") == ["half_year", "instant", "other", "nine_months", "year"]


def test_first_days_come_with_flattened_facts(spark):
    text = '{"facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"form": "10-Q", "filed": "2020-05-01", "start": "2020-01-01", "end": "2020-03-31", "val": 5}, {"form": "10-Q", "filed": "2020-05-01", "end": "2020-03-31", "val": 6}]}}}}}'
    documents = spark.createDataFrame([("T", "1", text)], "ticker string, cik string, json string")
    assert sorted(values(flatten_facts(documents, spans=True), "period_start", "value"), key=str) == [(None, "6"), (D(2020, 1, 1), "5")]
    assert "period_start" not in flatten_facts(documents).columns
