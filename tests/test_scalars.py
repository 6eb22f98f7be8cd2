import math

import pytest
from helpers import values
from pyspark.sql import functions as F

from tidemark.contracts import (
    Contract,
    MissingColumnsError,
    align,
    coerce,
    column_or_null,
    enforce,
    first_matching,
    require,
    resolve_aliases,
    typed_empty,
)
from tidemark.functions import scalars as s


def test_safe_divide_nulls_unsafe_denominators(spark):
    inf, nan = math.inf, math.nan
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, nan), (1.0, inf), (1.0, -inf), (1.0, -4.0), (None, 2.0)], "n double, d double")
    assert values(df, s.safe_divide("n", "d")) == [None, None, None, None, None, -0.25, None]


def test_clip_keeps_nulls_and_open_bounds(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (0.5,), (9.0,)], "x double")
    assert values(df, s.clip("x", 0.0, 1.0)) == [None, 0.0, 0.5, 1.0]
    assert values(df, s.clip("x", lower=0.0)) == [None, 0.0, 0.5, 9.0]
    assert values(df, s.clip("x", upper=1.0)) == [None, -5.0, 0.5, 1.0]
    assert values(df, s.clip("x")) == [None, -5.0, 0.5, 9.0]


def test_label_and_indicator(spark):
    df = spark.createDataFrame([(None,), (0.0,), (0.1,), (-0.1,)], "r double")
    assert values(df, s.binary_label("r")) == [None, 0, 1, 0]
    assert values(df, s.indicator(F.col("r") > 0)) == [0, 0, 1, 0]


def test_dominant_class_ties(spark):
    df = spark.createDataFrame([(0.3, 0.3, 0.3), (0.2, 0.4, 0.4), (0.1, 0.2, 0.7), (None, 0.1, 0.2)], "p double, n double, u double")
    assert values(df, s.dominant_class("p", "n", "u")) == ["positive", "negative", "neutral", None]


def test_softmax_is_stable(spark):
    df = spark.createDataFrame([(1000.0, 1000.0, 0.0)], "a double, b double, c double")
    row = df.select(*[x.alias(f"p{i}") for i, x in enumerate(s.softmax(F.col("a"), F.col("b"), F.col("c")))]).first()
    assert row.p0 == pytest.approx(0.5) and row.p2 == pytest.approx(0.0)


def test_pad_id_never_truncates(spark):
    df = spark.createDataFrame([("42",), (" 7 ",), ("123456789012",)], "x string")
    assert values(df, s.pad_id("x")) == ["0000000042", "0000000007", "123456789012"]


def test_symbols_and_date_windows(spark):
    df = spark.createDataFrame([(" ko ", "2020-01-01"), ("  ", None), (None, "2021-01-01")], "t string, d string")
    assert values(df, s.normalize_symbol("t")) == ["KO", None, None]
    dated = df.select(F.col("d").try_cast("date").alias("d"))
    assert values(dated, s.within("d", "2020-01-01", "2020-12-31")) == [True, False, False]
    assert values(dated, s.within("d", "2020-01-01", "2020-12-31", null_ok=True)) == [True, True, False]


def test_bad_values_become_null(spark):
    df = spark.createDataFrame([("x",), ("",), ("NaN",), ("2020-13-01",), ("1d",), ("1.5",)], "v string")
    assert values(df, coerce(F.col("v"), "string", "double")) == [None, None, None, None, None, 1.5]
    assert values(df, coerce(F.col("v"), "string", "bigint")) == [None, None, None, None, None, 1]
    assert values(df, coerce(F.col("v"), "string", "date"))[:4] == [None] * 4


def test_contract(spark):
    contract = Contract("things", {"k": "string", "d": "date", "v": "double"}, not_null=("k",))
    df = spark.createDataFrame([(1, "2020-02-03", float("nan"), "x"), (None, "bad", 2.0, "y")], "k int, d string, v double, extra string")
    got = enforce(df, contract)
    assert got.dtypes == [("k", "string"), ("d", "date"), ("v", "double"), ("extra", "string")]
    assert [(r.k, str(r.d), r.v) for r in got.collect()] == [("1", "2020-02-03", None)]
    with pytest.raises(MissingColumnsError, match="things is missing required columns: d, v"):
        enforce(df.drop("d", "v"), contract)
    with pytest.raises(MissingColumnsError):
        require(df, ["nope"])
    assert typed_empty(spark, contract).unionByName(align(df.select("k"), contract)).collect()[0].d is None
    assert values(df, column_or_null(df, "absent")) == [None, None]


def test_aliases(spark):
    assert first_matching(["Filed", "VAL"], ["filing_date", "filed"]) == "Filed"
    assert first_matching(["a"], ["b"]) is None
    df = spark.createDataFrame([("2020-01-01", 5)], "Filed string, VAL int")
    aliases = {"filing_date": ["filing_date", "filed"], "value": ["value", "val"], "unit": ["unit"]}
    assert resolve_aliases(df, aliases, ["filing_date", "value"]).first().asDict() == {"filing_date": "2020-01-01", "value": 5, "unit": None}
    assert resolve_aliases(df, aliases, ["unit"]) is None


def test_all_white_space_around_symbols_and_identifiers_goes(spark):
    df = spark.createDataFrame([("\tkr\n\u00a0", "320193\n")], "t string, x string")
    assert values(df, s.normalize_symbol("t"), s.pad_id("x")) == [("KR", "0000320193")]
