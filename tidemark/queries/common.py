"""Inputs the queries share: the roles the tables play, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pad_id
from ..sources.facts import CONCEPTS
from ..sources.tables import spread
from .registry import Tables

# Which tag each (line number, line status) pair of an item line reports; revenue has two.
LINE_TAGS = (
    "Revenues", "NetIncomeLoss", "Assets", "Liabilities", "AssetsCurrent", "LiabilitiesCurrent",
    "CashAndCashEquivalentsAtCarryingValue", "StockholdersEquity", "OperatingIncomeLoss",
    "NetCashProvidedByUsedInOperatingActivities", "LongTermDebt", "InventoryNet",
    "AccountsReceivableNetCurrent", "SalesRevenueNet",
)
LINE_CONCEPTS = (*CONCEPTS, "revenue")
FORM_OF_FLAG = {"A": "10-K", "N": "10-Q", "R": "8-K"}
HORIZON = ("1995-01-01", "2001-12-31")
TIES = ("value", "form_type")  # order of facts filed on one day


def bars(t: Tables) -> DataFrame:
    """Daily bars per supplier: the dearest unit price of the day and the quantity shipped."""
    return (
        t("lineitem")
        .groupBy(F.col("l_suppkey").cast("string").alias("ticker"), F.to_date("l_shipdate").alias("date"))
        .agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("adj_close"), F.sum("l_quantity").alias("volume"))
    )


BARS = """bars AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
         max(l_extendedprice / l_quantity) AS adj_close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""


def _line_place():
    return (F.col("l_linenumber") - 1) * 2 + (F.col("l_linestatus") == "O").cast("int") + 1


def raw_facts(t: Tables, lines: DataFrame | None = None) -> DataFrame:
    """Item lines as filed facts: the concept from the line, the period from the ship date's year."""
    period = F.make_date(F.year("l_shipdate"), F.lit(12), F.lit(31))
    names = F.array(*[F.lit(c) for c in LINE_CONCEPTS])
    form = F.element_at(F.create_map(*[F.lit(x) for p in FORM_OF_FLAG.items() for x in p]), F.col("l_returnflag"))
    return (lines if lines is not None else t("lineitem")).select(
        F.col("l_suppkey").cast("string").alias("ticker"),
        pad_id("l_suppkey").alias("cik"),
        F.date_add(period, F.col("l_quantity").cast("int")).alias("filing_date"),
        period.alias("period_end"),
        F.lit("FY").alias("fiscal_period"),
        F.year("l_shipdate").cast("bigint").alias("fiscal_year"),
        form.alias("form_type"),
        F.element_at(names, _line_place()).alias("concept_name"),
        F.col("l_extendedprice").alias("value"),
        F.lit("USD").alias("unit"),
        F.lit("lines").alias("source"),
    )


FACTS = f"""raw AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ticker, lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS cik,
         make_date(year(l_shipdate), 12, 31) AS period_end, 'FY' AS fiscal_period,
         year(l_shipdate) AS fiscal_year,
         CASE l_returnflag WHEN 'A' THEN '10-K' WHEN 'N' THEN '10-Q' ELSE '8-K' END AS form_type,
         ({list(LINE_CONCEPTS)})[(l_linenumber - 1) * 2 + CAST(l_linestatus = 'O' AS INTEGER) + 1] AS concept_name,
         l_extendedprice AS value, l_quantity
  FROM lineitem),
facts AS (
  SELECT * EXCLUDE (l_quantity), period_end + CAST(l_quantity AS INTEGER) AS filing_date
  FROM raw WHERE form_type IN ('10-K', '10-Q', '10-K/A', '10-Q/A'))"""

# One row per (ticker, period_end): newest metadata, newest value per concept.
WIDE = (
    FACTS
    + """,
latest AS (
  SELECT * FROM facts
  QUALIFY row_number() OVER (PARTITION BY ticker, period_end, concept_name
                             ORDER BY filing_date DESC, value DESC, form_type DESC) = 1),
meta AS (
  SELECT ticker, cik, filing_date, period_end, fiscal_period, fiscal_year, form_type FROM latest
  QUALIFY row_number() OVER (PARTITION BY ticker, period_end ORDER BY filing_date DESC, concept_name DESC) = 1),
cells AS (
  SELECT ticker, period_end, """
    + ",\n         ".join(f"max(CASE WHEN concept_name = '{c}' THEN value END) AS {c}" for c in CONCEPTS)
    + """
  FROM latest GROUP BY 1, 2),
wide AS (SELECT * FROM meta JOIN cells USING (ticker, period_end))"""
)


def documents(t: Tables) -> DataFrame:
    """The documents in enough partitions to work on their texts in parallel."""
    return spread(t("documents"), "doc_id")


def filings(t: Tables) -> DataFrame:
    """Documents as filings of their source; longer ones are filed later."""
    form = F.when(F.col("lang") == "en", "10-Q").when(F.col("lang").isin("fr", "de"), "10-K").otherwise("10-K/A")
    filed = F.date_add(F.lit("1995-01-01").cast("date"), F.floor(F.sqrt("n_chars") * 6).cast("int"))
    return documents(t).select(
        F.col("source").alias("ticker"),
        F.lit("0000000001").alias("cik"),
        F.col("source").alias("company_name"),
        form.alias("form_type"),
        filed.alias("filing_date"),
        F.last_day(F.add_months(filed, -1)).alias("period_end"),
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("accession_number"),
        F.concat(F.lit("docs/"), F.col("doc_id")).alias("text_file_path"),
        F.col("n_chars").alias("text_length"),
        F.lit("documents").alias("source"),
        "lang",
        "text",
    )


FILINGS = """filings AS (
  SELECT source AS ticker, '0000000001' AS cik, source AS company_name,
         CASE WHEN lang = 'en' THEN '10-Q' WHEN lang IN ('fr', 'de') THEN '10-K' ELSE '10-K/A' END AS form_type,
         DATE '1995-01-01' + CAST(floor(sqrt(n_chars) * 6) AS INTEGER) AS filing_date,
         last_day(CAST(DATE '1995-01-01' + CAST(floor(sqrt(n_chars) * 6) AS INTEGER) - INTERVAL 1 MONTH AS DATE)) AS period_end,
         'doc-' || CAST(doc_id AS VARCHAR) AS accession_number,
         'docs/' || CAST(doc_id AS VARCHAR) AS text_file_path,
         n_chars AS text_length, 'documents' AS source, lang, text
  FROM documents)"""


def r6(*names: str) -> str:
    """SQL select list of the named columns at six places."""
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def iso(*names: str) -> str:
    """SQL select list of the named dates as ISO text."""
    return ", ".join(f"CAST({n} AS VARCHAR) AS {n}" for n in names)


def nonzero(expr: str) -> str:
    return f"nullif({expr}, 0)"
