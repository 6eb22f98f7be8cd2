import re
from collections import Counter

import pytest
from plain import words
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.queries import ORACLES, QUERIES


def plain(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


MEASURED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics(frame, texts):
    rows = texts + [(None, "a b c a b c a"), (-1, None), (-2, ""), (-3, " \n\t"), (-4, "é | é | é | é\n\né | é | é | é"), (-5, "a b c a b c a")]
    found = quality.statistics(frame(rows)).collect()
    want = sorted((str(d), *plain(t)) for d, t in rows)
    assert sorted((str(r["doc_id"]), *[r[c] for c in MEASURED]) for r in found) == want


def test_query_against_sql(spark, folder):
    import duckdb

    for table in ("documents", "labels"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = duckdb.sql(ORACLES["op5_risk_controlled_quality"])
    found = QUERIES["op5_risk_controlled_quality"](spark, folder).select(*want.columns)
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("x, n, p", [(0, 10, 0.1), (3, 100, 0.05), (40, 1000, 0.05), (100, 100_000, 0.0012), (0, 1, 0.5)])
def test_binomial_tail(spark, x, n, p):
    from math import comb

    got = spark.range(1).select(quality.binomial_tail(F.lit(x), F.lit(n), p)).first()[0]
    want = 1.0 if x >= n * p else sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1)) if n <= 1000 else None
    if want is not None:
        assert got == pytest.approx(want, rel=1e-6)
    else:
        assert 0 < got < 1
        few = spark.range(1).select(quality.binomial_tail(F.lit(x), F.lit(n), p, terms=5)).first()[0]
        assert few >= got * (1 - 1e-9)  # the bound of the cut sum is from above


def stats(spark, n, bad, stratum="en"):
    """n good documents, of which ``bad`` are full of symbols."""
    rows = [(i, stratum, 100, 500, 300 if i < bad else 0, 5, 0, 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")


def test_cutoffs_need_proof(spark):
    few = quality.cutoffs(stats(spark, 100, 0), "stratum").first()
    assert few["cut_symbols"] is None  # a hundred labels prove nothing at this risk
    many = quality.cutoffs(stats(spark, 5000, 0), "stratum").first()
    assert many["cut_symbols"] == 0.06
    spoiled = quality.cutoffs(stats(spark, 5000, 100), "stratum").first()
    assert spoiled["cut_symbols"] is None and spoiled["cut_duplicate_lines"] == 0.2


def test_no_python_on_the_main_path(spark, folder):
    plan = QUERIES["op5_risk_controlled_quality"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_tables(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    empty = frame([]).withColumn("lang", F.lit("en"))
    assert quality.judge(empty, labels).collect() == []
    one = frame([(1, "a " * 60), (None, None)]).withColumn("lang", F.lit(None).cast("string"))
    assert sorted((r["n_words"], r["kept"]) for r in quality.judge(one, labels).collect()) == [(0, False), (60, False)]
