"""Every registered query with SQL gives the rows that SQL gives, on the smallest tables."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as registered

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield con
    con.close()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shaped(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(0.0 if r[i] == 0 and isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    df = registered.queries()[name](spark, FOLDER)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # bytes that are not UTF-8 are decoded in Python; a model is Python
    if name not in ("corpus_round_trip", "model_scored_texts"):
        assert "EvalPython" not in text and "InPandas" not in text
    result = database.execute(registered.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    got, expected = shaped([tuple(r) for r in df.collect()], df.columns), shaped(result.fetchall(), columns)
    assert got == expected
    assert not any(isinstance(x, float) and math.isnan(x) for r in got for x in r)


def test_entry(spark):
    df = registered.entry(spark)
    assert {"ticker", "date", "label", "roa"} <= set(df.columns) and df.count() > 0


def test_flagship_plan(spark):
    text = plan(registered.queries()["modelling_panel"](spark, FOLDER))
    # bars: by day, then by ticker; facts: newest per concept, per period, then by ticker; the as-of join adds none
    exchanges = re.findall(r"Exchange (\w+)\(([^)]*)\)", text)
    assert [kind for kind, _ in exchanges] == ["hashpartitioning"] * 5
    assert "SinglePartition" not in text and "Cartesian" not in text and "Python" not in text


def test_scans_read_only_needed_columns(spark):
    text = plan(registered.queries()["bars"](spark, FOLDER))
    assert re.search(r"ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_extendedprice:double,l_shipdate", text)
    text = plan(registered.queries()["coverage_gap"](spark, FOLDER))
    assert "EqualTo(l_returnflag,R)" in text
