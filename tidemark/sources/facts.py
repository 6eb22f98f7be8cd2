"""Nested company-facts documents to long fact rows, and the entity identifier map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import RAW_FACTS, enforce
from ..functions.scalars import normalize_symbol, pad_id, to_date, within
from ..operators.dedup import drop_exact_duplicates, keep_last

# Study horizon, accepted form types, and the tags that may report each concept.
HORIZON = ("2015-01-01", "2024-12-31")
ALLOWED_FORMS = ("10-K", "10-Q", "10-K/A", "10-Q/A")
CONCEPT_TAGS = {
    "revenue": [
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "SalesRevenueNet",
        "Revenues",
        "Revenue",
    ],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "total_assets": ["Assets"],
    "total_liabilities": ["Liabilities"],
    "current_assets": ["AssetsCurrent"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "cash_and_cash_equivalents": [
        "CashAndCashEquivalentsAtCarryingValue",
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
    ],
    "shareholders_equity": [
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ],
    "operating_income": ["OperatingIncomeLoss"],
    "operating_cash_flow": [
        "NetCashProvidedByUsedInOperatingActivities",
        "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations",
    ],
    "long_term_debt": [
        "LongTermDebtAndCapitalLeaseObligations",
        "LongTermDebtNoncurrent",
        "LongTermDebt",
    ],
    "inventory": ["InventoryNet", "InventoriesNetOfReserves"],
    "accounts_receivable": ["AccountsReceivableNetCurrent", "ReceivablesNetCurrent"],
}
CONCEPTS = tuple(CONCEPT_TAGS)

FACT = "struct<form:string,filed:string,start:string,end:string,fp:string,fy:string,val:string>"
FACTS_DOCUMENT = f"struct<facts:struct<`us-gaap`:map<string,struct<units:map<string,array<{FACT}>>>>>>"
ID_MAP_DOCUMENT = "map<string,struct<ticker:string,cik_str:string>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one per file, as (path, json); splits by file, not by line."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("json")
    )


def concept_tags(spark: SparkSession, tags: Mapping[str, Sequence[str]] = CONCEPT_TAGS) -> DataFrame:
    """Short table (concept_name, tag, priority); a later candidate has a higher priority."""
    rows = [(c, t, i) for c, names in tags.items() for i, t in enumerate(names)]
    return spark.createDataFrame(rows, "concept_name string, tag string, priority int")


def flatten_facts(
    documents: DataFrame,
    json_column: str = "json",
    tags: Mapping[str, Sequence[str]] = CONCEPT_TAGS,
    forms: Sequence[str] = ALLOWED_FORMS,
    horizon: tuple[str, str] = HORIZON,
    source: str = "sec_companyfacts",
    spans: bool = False,
) -> DataFrame:
    """Long facts from documents with ``ticker``, ``cik`` and a JSON column.

    Every accepted tag of a concept contributes rows. Facts of other forms, or with a known date
    outside the horizon, are left out. ``fact_order`` records where a fact stood (tag priority,
    unit, position) for use as the last tie-break. With ``spans`` the first day of what a fact covers comes
    along as ``period_start`` (null for instants); see :mod:`tidemark.operators.durations`.
    """
    wanted = F.create_map(
        *[
            x
            for concept, names in tags.items()
            for i, tag in enumerate(names)
            for x in (F.lit(tag), F.struct(F.lit(concept).alias("concept"), F.lit(i).alias("priority")))
        ]
    )
    parsed = documents.select(
        "ticker", "cik", F.from_json(json_column, FACTS_DOCUMENT).getField("facts").getField("us-gaap").alias("tags")
    )
    # unknown tags go before their facts are expanded
    known = F.map_filter("tags", lambda tag, _: F.map_contains_key(wanted, tag))
    per_tag = parsed.select("ticker", "cik", F.explode(known).alias("tag", "body")).withColumn(
        "role", F.element_at(wanted, F.col("tag"))
    )
    per_unit = per_tag.select("ticker", "cik", "role", F.posexplode("body.units").alias("unit_no", "unit", "facts"))
    per_fact = per_unit.select("ticker", "cik", "role", "unit_no", "unit", F.posexplode("facts").alias("fact_no", "fact"))
    start, end = horizon
    filed, closed = to_date(F.col("fact.filed")), to_date(F.col("fact.end"))
    return (
        per_fact.where(F.col("fact.form").isin(*forms))
        .select(
            "ticker",
            "cik",
            filed.alias("filing_date"),
            closed.alias("period_end"),
            *([to_date(F.col("fact.start")).alias("period_start")] if spans else []),
            F.col("fact.fp").alias("fiscal_period"),
            F.col("fact.fy").alias("fiscal_year"),
            F.col("fact.form").alias("form_type"),
            F.col("role.concept").alias("concept_name"),
            F.col("fact.val").alias("value"),
            "unit",
            F.lit(source).alias("source"),
            (
                F.shiftleft(F.col("role.priority").cast("bigint"), 48)
                + F.shiftleft(F.col("unit_no").cast("bigint"), 32)
                + F.col("fact_no")
            ).alias("fact_order"),
        )
        .where(within("filing_date", start, end, null_ok=True) & within("period_end", start, end, null_ok=True))
    )


def build_raw_facts(facts: DataFrame) -> DataFrame:
    """Typed facts without exact repeats and without rows that lack a key or a value."""
    typed = enforce(facts, RAW_FACTS).dropna(subset=["ticker", "cik", "filing_date", "concept_name", "value"])
    lineage = "fact_order" if "fact_order" in typed.columns else None
    return drop_exact_duplicates(typed, lineage)


def entity_ids(documents: DataFrame, json_column: str = "json", position: Column | None = None) -> DataFrame:
    """Symbol to zero-padded identifier; the last record of a symbol wins, blanks are dropped.

    ``position`` orders the documents when there are several.
    """
    records = documents.select(
        (position if position is not None else F.lit(0)).alias("document"),
        F.posexplode(F.from_json(json_column, ID_MAP_DOCUMENT)).alias("at", "entry", "record"),
    ).select(
        normalize_symbol("record.ticker").alias("ticker"),
        pad_id("record.cik_str").alias("cik"),
        "document",
        "at",
    )
    kept = records.where(F.col("ticker").isNotNull() & (F.ltrim(F.col("cik")) != "") & F.col("cik").isNotNull())
    return keep_last(kept, ["ticker"], ["document", "at"]).select("ticker", "cik")
