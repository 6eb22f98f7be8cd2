import json

import pytest
from helpers import day, sorted_rows
from pyspark.sql import functions as F

from tidemark.contracts import FILING_INDEX, RAW_FACTS
from tidemark.operators import dedup, joins, reshape
from tidemark.plans.panels import clean_fundamentals, statement_panel, usable_rows
from tidemark.queries import roundtrips
from tidemark.queries.registry import Tables
from tidemark.session import cut_lineage, ensure_checkpoint_dir
from tidemark.sources import facts as src
from tidemark.sources import filings, tables, universe


def test_keep_last_and_first(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "z"), ("a", 0, "y"), ("b", None, "q"), ("b", 5, "r")], "k string, o int, tie string")
    assert sorted_rows(dedup.keep_last(df, ["k"], ["o", "tie"])) == [("a", 1, "z"), ("b", None, "q")]
    assert sorted_rows(dedup.keep_first(df, ["k"], ["o", "tie"])) == [("a", 0, "y"), ("b", 5, "r")]
    counts = dedup.duplicate_counts(df, ["k"]).first()
    assert (counts.total_rows, counts.kept_rows, counts.removed_rows) == (5, 2, 3)
    empty = dedup.duplicate_counts(df.where("false"), ["k"]).first()
    assert (empty.total_rows, empty.kept_rows, empty.removed_rows) == (0, 0, 0)


def test_exact_duplicates_keep_the_first_position(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 1, 3), ("a", 2, 5)], "k string, v int, at int")
    assert sorted_rows(dedup.drop_exact_duplicates(df, "at")) == [("a", 1, 3), ("a", 2, 5)]
    assert dedup.drop_exact_duplicates(df.drop("at")).count() == 2


def test_resume(spark):
    new = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    old = spark.createDataFrame([("a", 0), (None, 0)], "k string, v int")
    assert sorted_rows(dedup.new_only(new, old, ["k"])) == [("b", 2), (None, 3)]
    assert dedup.new_only(new, old, ["k"], rescore=True).count() == 3
    assert sorted_rows(dedup.append_new(old.dropna(), new.dropna(), ["k"], ["v"])) == [("a", 0), ("b", 2)]


def test_sources_and_coverage(spark):
    a = spark.createDataFrame([("x", 1)], "k string, v int")
    b = spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert sorted_rows(joins.prefer_source(a, b, ["k"])) == [("x", 1), ("y", 3)]
    assert sorted_rows(joins.missing_members(b, a, ["k"])) == [("y",)]
    matched, unmatched = joins.lookup(b, a.select("k", F.col("v").alias("id")), ["k"])
    assert sorted_rows(matched) == [("x", 2, 1)] and sorted_rows(unmatched) == [("y",)]
    found = spark.createDataFrame([("x", "revenue")], "k string, concept string")
    assert sorted_rows(joins.missing_concepts(found, b, "k", "concept", ["revenue", "cash"])) == [("x", "cash"), ("y", "cash"), ("y", "revenue")]


FACT_SCHEMA = ", ".join(f"{n} {t}" for n, t in RAW_FACTS.columns.items())


def fact(concept, value, filed, end=10, cik="1", form="10-Q", ticker="a"):
    return (ticker, cik, day(filed), day(end), "Q1", 2020, form, concept, value, "USD", "s")


def test_clean_fundamentals(spark):
    rows = [
        fact("revenue", 1.0, 20), fact("revenue", 2.0, 30, form="10-Q/A"),
        fact("inventory", 7.0, 30), fact("net_income", 5.0, 25), fact("net_income", 6.0, 25),
        fact("total_assets", 9.0, 40, form="8-K"),
        fact("revenue", 3.0, 20, end=11, cik="1"), fact("net_income", 4.0, 21, end=11, cik="2"),
        fact("unknown concept", 8.0, 22, end=12),
        ("a", "1", None, day(10), "Q1", 2020, "10-Q", "revenue", 1.0, "USD", "s"),
    ]
    got = {r.period_end: r for r in clean_fundamentals(spark.createDataFrame(rows, FACT_SCHEMA)).collect()}
    first = got[day(10)]
    assert (first.revenue, first.inventory, first.net_income, first.total_assets) == (2.0, 7.0, 6.0, None)
    # both concepts were filed last on day 30; the greater name names the form
    assert (first.filing_date, first.form_type) == (day(30), "10-Q/A")
    # the metadata row belongs to another owner than the revenue row
    assert (got[day(11)].cik, got[day(11)].revenue, got[day(11)].net_income) == ("2", None, 4.0)
    assert got[day(12)].revenue is None and got[day(12)].ticker == "a"


def test_flatten_company_facts(spark, tmp_path):
    def entry(**kw):
        return {"form": "10-K", "filed": "2020-02-01", "end": "2019-12-31", "fp": "FY", "fy": 2019, "val": 1, **kw}

    document = {"facts": {"us-gaap": {
        "Revenues": {"units": {"USD": [entry(), entry(), entry(form="8-K"), entry(filed="2030-01-01"), entry(end=None, val=2.5)]}},
        "SalesRevenueNet": {"units": {"EUR": [entry(val=3)], "USD": [entry(val=None)]}},
        "Other": {"units": {"USD": [entry()]}},
    }}}
    (tmp_path / "a.json").write_text(json.dumps(document, indent=1))
    docs = src.read_documents(spark, str(tmp_path / "*.json")).withColumns({"ticker": F.lit("a"), "cik": F.lit("1")})
    flat = src.flatten_facts(docs)
    assert flat.count() == 5
    raw = src.build_raw_facts(flat)
    got = sorted((r.unit, r.value, str(r.period_end), r.fiscal_year, r.concept_name) for r in raw.collect())
    assert got == [
        ("EUR", 3.0, "2019-12-31", 2019, "revenue"), ("USD", 1.0, "2019-12-31", 2019, "revenue"), ("USD", 2.5, "None", 2019, "revenue"),
    ]
    wide = clean_fundamentals(raw).collect()
    # a tag later in the candidate list has a higher priority
    assert len(wide) == 1 and wide[0].revenue == 1.0
    assert src.concept_tags(spark).count() == sum(map(len, src.CONCEPT_TAGS.values()))


def test_entity_ids(spark):
    document = {"0": {"ticker": "ko ", "cik_str": 21344}, "1": {"ticker": "", "cik_str": 5}, "2": {"ticker": "KO", "cik_str": 99}, "3": {"ticker": "PEP", "cik_str": None}}
    docs = spark.createDataFrame([(json.dumps(document),)], "json string")
    assert sorted_rows(src.entity_ids(docs)) == [("KO", "0000000099")]


def test_wide_prices(spark):
    wide = spark.createDataFrame([("2020-01-01", 1.0, float("nan"), 5.0, 6.0), ("bad", 1.0, 1.0, 1.0, 1.0)], "Date string, `Adj Close|A` double, `Adj Close|B` double, `Volume|A` double, `Volume|B` double")
    fields = {"Adj Close": "adj_close", "Volume": "volume"}
    assert sorted_rows(reshape.wide_prices_to_long(wide, fields)) == [("A", day(0), 1.0, 5.0)]
    single = spark.createDataFrame([("2020-01-01", 1.0)], "Date string, `Adj Close` double")
    row = reshape.wide_prices_to_long(single, fields, single_ticker="KO").first()
    assert (row.ticker, row.adj_close, row.volume) == ("KO", 1.0, None)
    with pytest.raises(ValueError):
        reshape.wide_prices_to_long(single, fields)


def test_filing_rows(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes(b"caf\xc3\xa9 \xff\xfe ok")
    (tmp_path / "two.txt").write_bytes("plain � text".encode())
    texts = filings.read_texts(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.text for r in texts.collect()}
    assert got == {"one.txt": "café  ok", "two.txt": "plain � text"}
    index = spark.createDataFrame(
        [("a", "x1", "10-K/A", day(3), str(tmp_path / "one.txt")), ("a", "unknown_accession", "10-Q", day(4), "gone"), ("a", None, "10-Q", None, "gone")],
        "ticker string, accession_number string, form_type string, filing_date date, text_file_path string",
    )
    assert filings.attach_texts(index, texts).first().text == "café  ok"
    assert filings.missing_texts(index, texts).count() == 2
    keys = [tuple(r.k) for r in index.select(filings.filing_key().alias("k")).collect()]
    assert keys == [("accession", "x1"), ("10-Q", "2020-01-05"), ("10-Q", "unknown_date")]
    assert index.select(filings.text_path("r").alias("p")).first().p == "r/a/2020-01-04_10-K_A_x1.txt"
    assert filings.filing_index(index).columns == FILING_INDEX.names
    assert filings.original_filings(index, horizon=(str(day(0)), str(day(9)))).count() == 1
    blank = spark.createDataFrame([(" \n", "md"), (None, None), ("t", "md")], "a string, b string")
    assert [r.c for r in blank.select(filings.choose_text(F.col("a"), F.col("b")).alias("c")).collect()] == ["md", "", "t"]


def test_index_of_pulled_filings(spark):
    rows = [
        ("a", "x1", "10-K", day(1), "text", None), ("a", "x1", "10-K", day(2), "again", None), ("a", "x2", "10-K", day(2), " ", "# md"),
        ("a", "x3", "10-Q", day(3), None, " "), ("a", "x4", "10-Q", None, "text", None), ("a", "unknown_accession", "10-Q", day(5), "text", None),
    ]
    found = spark.createDataFrame(rows, "ticker string, accession_number string, form_type string, filing_date date, plain string, markdown string")
    found = found.withColumns({"cik": F.lit("1"), "company_name": F.lit("A"), "period_end": F.lit(None).cast("date")})
    first = filings.index_filings(found, "r")
    got = {r.accession_number: (r.text, r.text_length) for r in first.collect()}
    assert got == {"x1": ("text", 4), "x2": ("# md", 4), "unknown_accession": ("text", 4)}
    assert filings.index_filings(found, "r", existing=first).count() == 0
    assert filings.index_filings(found, "r", existing=first.where("accession_number <> 'unknown_accession'")).count() == 1


def test_universe(spark):
    assert [r.ticker for r in universe.universe(spark, [" ko", None, "", "KO", "pep "]).orderBy("position").collect()] == ["KO", "KO", "PEP"]
    assert universe.universe(spark).count() == len(universe.TICKERS) == 34
    present = spark.createDataFrame([(t,) for t in universe.TICKERS[1:]], "ticker string")
    assert sorted_rows(joins.missing_members(universe.universe(spark), present, ["ticker"])) == [(universe.TICKERS[0],)]


def test_panel_keeps_every_bar(spark):
    bars = spark.createDataFrame([("a", day(i), 0.1, 1 if i < 3 else None) for i in range(5)], "ticker string, date date, forward_return_5d double, label int")
    features = spark.createDataFrame([("a", day(1), day(-90), 1.0), ("a", day(1), day(0), 2.0), ("a", None, day(0), 3.0)], "ticker string, filing_date date, period_end date, roa double")
    panel = statement_panel(bars, features)
    assert panel.count() == 5
    assert [r.roa for r in panel.orderBy("date").collect()] == [None, 2.0, 2.0, 2.0, 2.0]
    assert usable_rows(panel).count() == 2


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", day(i * 200), float(i)) for i in range(4)], "ticker string, date date, v double")
    tables.write_panel(df, str(tmp_path / "panel"))
    assert sorted(p.name for p in (tmp_path / "panel").glob("year=*")) == ["year=2020", "year=2021"]
    assert tables.scan(spark, str(tmp_path / "panel"), columns=["ticker"]).count() == 4
    with pytest.raises(ValueError, match="missing required columns: w"):
        tables.scan(spark, str(tmp_path / "panel"), columns=["w"])
    tidy = spark.createDataFrame([("m", "auc", 0.5), ("m", "f1", 0.25)], "model string, metric string, value double")
    tables.write_metrics(tidy, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 2
    assert json.loads(tables.metrics_document(tidy, ["model"]).first().metrics_json) == {"auc": 0.5, "f1": 0.25}
    again = cut_lineage(df)
    assert sorted_rows(again) == sorted_rows(df)
    assert ensure_checkpoint_dir(spark).removeprefix("file:") in again.inputFiles()[0]
    assert tables.spread(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() == 4
    wide = spark.range(0, 10, numPartitions=9)
    assert tables.spread(wide, "id") is wide


def test_texts_of_one_source_are_in_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(roundtrips, "FILE_ROWS", 5, raising=False)
    monkeypatch.setattr(roundtrips, "_folder", lambda t: str(tmp_path / "texts"))
    tables = Tables(spark, "/root/testdata/sf0.001")
    roundtrips.corpus_round_trip(tables)
    rows = {r["source"]: r["count"] for r in tables("documents").groupBy("source").count().collect()}
    files = {s: len(list((tmp_path / "texts" / f"source={s}").glob("part-*"))) for s in rows}
    assert all(5 * files[s] >= rows[s] for s in rows), (files, rows)
