"""Facts: flattening, dedup, pivot, statement ratios, sources, coverage, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import FILING_INDEX, RAW_FACTS, align, coerce, resolve_aliases, typed_empty
from ..functions.scalars import normalize_symbol, safe_divide, within
from ..operators import durations
from ..operators.dedup import append_new, drop_exact_duplicates, duplicate_counts, keep_first, keep_last, new_only
from ..operators.joins import lookup, missing_concepts, missing_members, prefer_source
from ..operators.reshape import pivot_concepts
from ..plans.features import STATEMENT_FEATURES, statement_features
from ..plans.panels import clean_fundamentals, normalize_facts
from ..sources.facts import CONCEPTS, build_raw_facts, entity_ids, flatten_facts
from ..sources.filings import filing_index, filing_key, text_path
from ..sources.tables import spread
from . import common as base
from .registry import Tables, comparable, query

_FACT_COLUMNS = ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}" if c.endswith(("_date", "_end")) else c for c in RAW_FACTS.columns if c not in ("source", "unit")
)


@query(
    f"""WITH {base.FACTS}
SELECT {_FACT_COLUMNS}, 'USD' AS unit, 'sec_companyfacts' AS source FROM (
  SELECT DISTINCT ticker, cik, filing_date, period_end, fiscal_period, fiscal_year, form_type, concept_name, value FROM facts
  WHERE filing_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'
    AND period_end BETWEEN DATE '1995-01-01' AND DATE '2001-12-31')"""
)
def flatten_company_facts(t: Tables) -> DataFrame:
    """Facts written as nested documents (tag, unit, list of facts), then flattened again."""
    facts = base.raw_facts(t, spread(t("lineitem"), "l_orderkey"))
    tag = F.element_at(F.array(*[F.lit(x) for x in base.LINE_TAGS]), F.array_position(
        F.array(*[F.lit(c) for c in base.LINE_CONCEPTS]), F.col("concept_name")).cast("int"))
    fact = F.struct(
        F.col("form_type").alias("form"), F.col("filing_date").alias("filed"), F.col("period_end").alias("end"),
        F.col("fiscal_period").alias("fp"), F.col("fiscal_year").alias("fy"), F.col("value").alias("val"),
    )
    body = F.struct(F.create_map(F.col("unit"), F.array(fact)).alias("units"))
    noise = F.struct(F.create_map(F.lit("shares"), F.array(fact)).alias("units"))
    tags = F.create_map(tag, body, F.lit("EntityCommonStockSharesOutstanding"), noise)
    documents = facts.select(
        "ticker", "cik", F.to_json(F.struct(F.struct(tags.alias("us-gaap")).alias("facts"))).alias("json")
    )
    flat = build_raw_facts(flatten_facts(documents, horizon=base.HORIZON))
    return comparable(flat.select(*RAW_FACTS.names))


@query(
    """
SELECT event_id, user_id, k.key AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value
FROM events, (SELECT 'k' AS key) k"""
)
def flatten_props(t: Tables) -> DataFrame:
    parsed = t("events").select("event_id", "user_id", F.from_json("props", "map<string,bigint>").alias("m"))
    return comparable(parsed.select("event_id", "user_id", F.explode("m").alias("key", "value")))


@query(
    """
SELECT upper(trim(s_name)) AS ticker, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier
QUALIFY row_number() OVER (PARTITION BY upper(trim(s_name)) ORDER BY s_suppkey DESC) = 1"""
)
def entity_id_map(t: Tables) -> DataFrame:
    number = F.concat(F.lit("\t"), F.col("s_suppkey").cast("string"), F.lit("\n"))
    record = F.struct(F.concat(F.lit(" \t"), F.lower("s_name"), F.lit("\u00a0\n")).alias("ticker"), number.alias("cik_str"))
    blank = F.struct(F.lit(" \u2003\n").alias("ticker"), number.alias("cik_str"))
    documents = t("supplier").select(
        "s_suppkey", F.to_json(F.create_map(F.lit("0"), record, F.lit("1"), blank)).alias("json")
    )
    return comparable(entity_ids(documents, position=F.col("s_suppkey")))


@query(
    f"""WITH {base.FACTS},
doubled AS (SELECT * FROM facts UNION ALL SELECT * FROM facts WHERE form_type = '10-K')
SELECT DISTINCT {_FACT_COLUMNS} FROM doubled"""
)
def exact_dedup(t: Tables) -> DataFrame:
    facts = normalize_facts(base.raw_facts(t))
    doubled = facts.unionByName(facts.where(F.col("form_type") == "10-K"))
    return comparable(drop_exact_duplicates(doubled).drop("unit", "source"))


@query(
    f"""WITH {base.FACTS}
SELECT {_FACT_COLUMNS} FROM facts
QUALIFY row_number() OVER (PARTITION BY ticker, period_end, concept_name
                           ORDER BY filing_date DESC, value DESC, form_type DESC) = 1"""
)
def facts_keep_last(t: Tables) -> DataFrame:
    facts = normalize_facts(base.raw_facts(t)).drop("unit", "source")
    return comparable(keep_last(facts, ["ticker", "period_end", "concept_name"], ["filing_date", *base.TIES]))


@query(
    f"""WITH {base.FACTS}, groups AS (SELECT count(*) AS n FROM facts GROUP BY ticker, period_end, concept_name)
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS kept_rows, CAST(sum(n - 1) AS BIGINT) AS removed_rows FROM groups"""
)
def facts_dedup_counts(t: Tables) -> DataFrame:
    return comparable(duplicate_counts(normalize_facts(base.raw_facts(t)), ["ticker", "period_end", "concept_name"]))


_WIDE_META = "ticker, cik, CAST(filing_date AS VARCHAR) AS filing_date, CAST(period_end AS VARCHAR) AS period_end, fiscal_period, fiscal_year, form_type"


@query(f"WITH {base.WIDE} SELECT {_WIDE_META} FROM meta")
def facts_period_metadata(t: Tables) -> DataFrame:
    facts = normalize_facts(base.raw_facts(t))
    newest = keep_last(facts, ["ticker", "period_end"], ["filing_date", "concept_name", *base.TIES])
    return comparable(newest.select("ticker", "cik", "filing_date", "period_end", "fiscal_period", "fiscal_year", "form_type"))


@query(f"WITH {base.WIDE} SELECT ticker, CAST(period_end AS VARCHAR) AS period_end, {base.r6(*CONCEPTS)} FROM cells")
def facts_pivot(t: Tables) -> DataFrame:
    facts = normalize_facts(base.raw_facts(t))
    unique = keep_last(facts, ["ticker", "period_end", "concept_name"], ["filing_date", *base.TIES])
    return comparable(pivot_concepts(unique, ["ticker", "period_end"], "concept_name", "value", CONCEPTS))


@query(f"WITH {base.WIDE} SELECT {_WIDE_META}, {base.r6(*CONCEPTS)} FROM wide")
def fundamentals_wide(t: Tables) -> DataFrame:
    """Dedup, metadata choice and pivot in one aggregation."""
    return comparable(clean_fundamentals(base.raw_facts(t), ties=base.TIES))


def _safe(n: str, d: str) -> str:
    return f"({n}) / nullif({d}, 0)"


_PRIOR = ", ".join(
    f"lag({c}, {k}) OVER w AS {c}_{k}"
    for c, k in (("total_assets", 1), ("shareholders_equity", 1), ("inventory", 1), ("accounts_receivable", 1),
                 ("revenue", 1), ("revenue", 4), ("net_income", 1), ("net_income", 4))
)


def _avg(c: str) -> str:
    return f"(({c} + {c}_1) / 2)"


_STATEMENT_SQL = {
    "current_ratio": _safe("current_assets", "current_liabilities"),
    "quick_ratio": _safe("current_assets - inventory", "current_liabilities"),
    "cash_ratio": _safe("cash_and_cash_equivalents", "current_liabilities"),
    "working_capital_to_total_assets": _safe("current_assets - current_liabilities", "total_assets"),
    "debt_to_equity": _safe("total_liabilities", "shareholders_equity"),
    "debt_to_assets": _safe("total_liabilities", "total_assets"),
    "long_term_debt_ratio": _safe("long_term_debt", "total_assets"),
    "gross_margin": "CAST(NULL AS DOUBLE)",
    "operating_margin": _safe("operating_income", "revenue"),
    "net_margin": _safe("net_income", "revenue"),
    "roa": _safe("net_income", _avg("total_assets")),
    "roe": _safe("net_income", _avg("shareholders_equity")),
    "asset_turnover": _safe("revenue", _avg("total_assets")),
    "inventory_turnover": _safe("revenue", _avg("inventory")),
    "receivables_turnover": _safe("revenue", _avg("accounts_receivable")),
    "revenue_growth_qoq": _safe("revenue - revenue_1", "revenue_1"),
    "revenue_growth_yoy": _safe("revenue - revenue_4", "revenue_4"),
    "earnings_growth_qoq": _safe("net_income - net_income_1", "net_income_1"),
    "earnings_growth_yoy": _safe("net_income - net_income_4", "net_income_4"),
    "cfo_to_net_income": _safe("operating_cash_flow", "net_income"),
    "accruals_ratio": _safe("net_income - operating_cash_flow", _avg("total_assets")),
}
STATEMENTS = (
    f"{base.WIDE}, prior AS (SELECT *, {_PRIOR} FROM wide WINDOW w AS (PARTITION BY ticker ORDER BY period_end)),\n"
    f"statements AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _STATEMENT_SQL.items())} FROM prior)"
)


@query(f"WITH {STATEMENTS} SELECT {_WIDE_META}, {base.r6(*STATEMENT_FEATURES)} FROM statements")
def statement_ratios(t: Tables) -> DataFrame:
    """All 21 statement features."""
    features = statement_features(clean_fundamentals(base.raw_facts(t), ties=base.TIES))
    return comparable(features.drop(*CONCEPTS))


@query(
    """
SELECT l_orderkey, l_partkey, l_linenumber,
       round(l_extendedprice / nullif(l_discount, 0), 6) AS price_per_discount,
       round(l_tax / nullif(l_quantity - 25, 0), 6) AS tax_per_excess
FROM lineitem"""
)
def safe_ratios(t: Tables) -> DataFrame:
    """Division with zero denominators."""
    lines = t("lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        safe_divide("l_extendedprice", "l_discount").alias("price_per_discount"),
        safe_divide(F.col("l_tax"), F.col("l_quantity") - 25).alias("tax_per_excess"),
    )
    return comparable(lines)


@query(
    """
WITH a AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT * FROM orders WHERE o_orderstatus = 'O')
SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice FROM a
UNION ALL
SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 6) FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)"""
)
def source_fallback(t: Tables) -> DataFrame:
    """Finished orders of a customer where there are any, else the open ones."""
    orders = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    first = orders.where(F.col("o_orderstatus") == "F")
    return comparable(prefer_source(first, orders.where(F.col("o_orderstatus") == "O"), ["o_custkey"]))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40")
def coverage_gap(t: Tables) -> DataFrame:
    """Parts that were never returned in bulk."""
    returned = t("lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 40)).select(F.col("l_partkey").alias("p_partkey"))
    return comparable(missing_members(t("part"), returned, ["p_partkey"]))


@query(
    f"""WITH {base.FACTS}, wanted AS (
  SELECT ticker, unnest({list(CONCEPTS)}) AS concept_name FROM (SELECT DISTINCT ticker FROM facts))
SELECT ticker, concept_name FROM wanted
EXCEPT SELECT ticker, concept_name FROM facts WHERE period_end = DATE '1998-12-31'"""
)
def concept_gap(t: Tables) -> DataFrame:
    """Concepts a supplier did not report for one year."""
    facts = normalize_facts(base.raw_facts(t))
    quarter = facts.where(F.col("period_end") == F.lit("1998-12-31").cast("date"))
    return comparable(missing_concepts(quarter, facts, "ticker", "concept_name", CONCEPTS))


_MAPPED = """mapped AS (SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier WHERE s_acctbal > 0),
shipped AS (SELECT l_suppkey AS s_suppkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)"""


def _shipped(t: Tables) -> tuple[DataFrame, DataFrame]:
    mapped = t("supplier").where("s_acctbal > 0").select(
        "s_suppkey", F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik")
    )
    shipped = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").alias("quantity"))
    return lookup(shipped, mapped, ["s_suppkey"])


@query(f"WITH {_MAPPED} SELECT s_suppkey, round(quantity, 6) AS quantity, cik FROM shipped JOIN mapped USING (s_suppkey)")
def id_lookup(t: Tables) -> DataFrame:
    return comparable(_shipped(t)[0])


@query(f"WITH {_MAPPED} SELECT s_suppkey FROM shipped WHERE s_suppkey NOT IN (SELECT s_suppkey FROM mapped)")
def id_lookup_unmatched(t: Tables) -> DataFrame:
    return comparable(_shipped(t)[1])


@query(
    """
SELECT doc_id, source, n_chars FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def resume_new_only(t: Tables) -> DataFrame:
    """Documents without an existing result."""
    return comparable(new_only(t("documents").select("doc_id", "source", "n_chars"), t("labels"), ["doc_id"]))


@query(
    """
WITH old AS (SELECT doc_id, 'old' AS origin, quality FROM labels),
new AS (SELECT doc_id, 'new' AS origin, CAST(NULL AS INTEGER) AS quality FROM documents)
SELECT doc_id, origin, CAST(quality AS BIGINT) AS quality FROM old
UNION ALL SELECT doc_id, origin, CAST(quality AS BIGINT) FROM new WHERE doc_id NOT IN (SELECT doc_id FROM old)"""
)
def append_results(t: Tables) -> DataFrame:
    """Existing results win over new rows; columns the new rows lack are null."""
    old = t("labels").select("doc_id", F.lit("old").alias("origin"), "quality")
    new = t("documents").select("doc_id", F.lit("new").alias("origin"))
    return comparable(append_new(old, new, ["doc_id"], ["origin"]))


@query(
    """
SELECT o_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1"""
)
def keep_first_order(t: Tables) -> DataFrame:
    orders = t("orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return comparable(keep_first(orders, ["o_custkey"], ["day", "o_orderkey"]))


@query(
    f"""WITH {base.FILINGS}
SELECT ticker, cik, company_name, form_type, {base.iso('filing_date', 'period_end')}, accession_number,
       text_file_path, text_length, source FROM filings"""
)
def filing_index_table(t: Tables) -> DataFrame:
    """Index of two overlapping pulls, one row per accession."""
    found = base.filings(t)
    again = found.where(F.col("form_type") == "10-K").withColumn("text_file_path", F.concat(F.lit("zz/"), "text_file_path"))
    return comparable(filing_index(found.unionByName(again), ["text_file_path"]))


@query(
    f"""WITH {base.FILINGS}
SELECT accession_number, CASE WHEN lang = 'es' THEN form_type ELSE 'accession' END AS kind,
       CASE WHEN lang = 'es' THEN CAST(filing_date AS VARCHAR) ELSE accession_number END AS id,
       'texts/' || ticker || '/' || CAST(filing_date AS VARCHAR) || '_' || replace(form_type, '/', '_') || '_' || accession_number || '.txt' AS path
FROM filings"""
)
def filing_keys(t: Tables) -> DataFrame:
    """Resume key and storage path of each filing; one language lacks accessions."""
    found = base.filings(t).withColumn(
        "known", F.when(F.col("lang") == "es", F.lit("unknown_accession")).otherwise(F.col("accession_number"))
    )
    return comparable(
        found.select("accession_number", filing_key("known").alias("k"), text_path("texts/").alias("path"))
        .select("accession_number", "k.kind", "k.id", "path")
    )


@query(
    """
SELECT l_orderkey, l_partkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS filing_date, l_returnflag AS form_type,
       round(l_extendedprice, 6) AS value, CAST(NULL AS VARCHAR) AS unit
FROM lineitem"""
)
def alias_columns(t: Tables) -> DataFrame:
    """First alias present, whatever its case; an optional target without a source is null."""
    source = t("lineitem").select(
        "l_orderkey", "l_partkey", F.to_date("l_shipdate").alias("Filed"), F.col("l_returnflag").alias("FORM"),
        F.col("l_extendedprice").alias("val"),
    )
    aliases = {
        "filing_date": ["filing_date", "filed"], "form_type": ["form_type", "form"],
        "value": ["numeric_value", "value", "val"], "unit": ["unit", "units"],
    }
    resolved = resolve_aliases(source, aliases, needed=["filing_date", "form_type", "value"])
    assert resolved is not None
    return comparable(resolved)


@query(
    """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number,
       CAST(TRY_CAST(strftime(ts, '%Y-%m-') || json_extract_string(props, '$.k') AS DATE) AS VARCHAR) AS day
FROM events"""
)
def coerced_columns(t: Tables) -> DataFrame:
    """Text to number and date; a day of the month that does not exist becomes null."""
    text = t("events").select(
        "event_id",
        F.get_json_object("props", "$.k").alias("number"),
        F.concat(F.date_format("ts", "yyyy-MM-"), F.get_json_object("props", "$.k")).alias("day"),
    )
    return comparable(
        text.select(
            "event_id", coerce(F.col("number"), "string", "double").alias("number"),
            coerce(F.col("day"), "string", "date").alias("day"),
        )
    )


@query(
    """
SELECT DISTINCT upper(trim(c_mktsegment)) AS symbol, c_custkey FROM customer
WHERE upper(trim(c_mktsegment)) IN ('BUILDING', 'MACHINERY')"""
)
def symbol_filter(t: Tables) -> DataFrame:
    """All customers' symbols cleaned of white space of any kind; those of a symbol list stay."""
    dressed = F.concat(F.lit(" \t"), F.lower("c_mktsegment"), F.lit("\u00a0\r\n"))
    symbols = t("customer").select(normalize_symbol(dressed).alias("symbol"), "c_custkey").dropna(subset=["symbol"])
    return comparable(symbols.where(F.col("symbol").isin("BUILDING", "MACHINERY")).distinct())


@query(
    """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders
WHERE o_orderstatus = 'P' OR CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"""
)
def window_filter(t: Tables) -> DataFrame:
    """Date window that lets unknown dates pass: pending orders have none here."""
    orders = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    dated = orders.withColumn("known", F.when(F.col("o_orderstatus") != "P", F.col("day")))
    return comparable(dated.where(within("known", "1996-01-01", "1997-12-31", null_ok=True)).select("o_orderkey", "day"))


@query(
    f"""WITH {base.FILINGS}
SELECT ticker, cik, company_name, form_type, {base.iso('filing_date', 'period_end')}, accession_number,
       CAST(NULL AS VARCHAR) AS text_file_path, CAST(NULL AS BIGINT) AS text_length, CAST(NULL AS VARCHAR) AS source
FROM filings"""
)
def align_columns(t: Tables) -> DataFrame:
    """Rows of an older layout brought under the index contract, appended to an empty table."""
    older = base.filings(t).select(
        "ticker", "cik", "company_name", "form_type", "filing_date", "period_end", "accession_number"
    )
    return comparable(typed_empty(t.spark, FILING_INDEX).unionByName(align(older, FILING_INDEX)))


# Item lines as amounts of a quarter, of the year so far or of a whole year, by line number.
_SPANS = """spans AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ticker, l_linestatus AS concept_name, l_extendedprice AS value,
         CAST(CASE WHEN l_linenumber IN (1, 4) THEN date_trunc('quarter', l_shipdate) ELSE date_trunc('year', l_shipdate) END AS DATE) AS period_start,
         CASE WHEN l_linenumber IN (3, 7) THEN make_date(year(l_shipdate), 12, 31)
              ELSE CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) END AS period_end,
         CAST(l_shipdate AS DATE) + 100 AS filing_date
  FROM lineitem),
latest AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY ticker, concept_name, period_start, period_end ORDER BY filing_date DESC, value DESC) = 1),
reported AS (SELECT *, 'reported' AS origin FROM latest WHERE period_end - period_start + 1 BETWEEN 80 AND 100),
steps AS (SELECT *, lag(period_end) OVER w AS e, lag(value) OVER w AS v, lag(filing_date) OVER w AS f FROM latest WINDOW w AS (PARTITION BY ticker, concept_name, period_start ORDER BY period_end)),
differences AS (
  SELECT ticker, concept_name, value - v AS value, e + 1 AS period_start, period_end, greatest(filing_date, f) AS filing_date, 'difference' AS origin
  FROM steps WHERE period_end - e BETWEEN 80 AND 100),
known AS (
  SELECT * FROM (SELECT *, 1 AS o FROM reported UNION ALL SELECT *, 2 FROM differences) QUALIFY row_number() OVER (PARTITION BY ticker, concept_name, period_start, period_end ORDER BY o) = 1),
years AS (SELECT * FROM latest WHERE period_end - period_start + 1 BETWEEN 350 AND 380),
summed AS (
  SELECT y.ticker, y.concept_name, y.period_start, y.period_end, y.value, y.filing_date, count(*) AS n, sum(k.value) AS total, min(k.period_start) AS first, max(k.period_end) + 1 AS rest,
         sum(k.period_end - k.period_start + 1) AS covered, max(k.filing_date) AS f
  FROM years y JOIN known k ON y.ticker = k.ticker AND y.concept_name = k.concept_name AND k.period_start >= y.period_start AND k.period_end < y.period_end
  GROUP BY ALL),
remainders AS (
  SELECT ticker, concept_name, value - total AS value, rest AS period_start, period_end, greatest(filing_date, f) AS filing_date, 'remainder' AS origin
  FROM summed WHERE n = 3 AND first = period_start AND covered = rest - period_start AND period_end - rest + 1 BETWEEN 80 AND 100),
quarters AS (
  SELECT * FROM (SELECT * FROM known UNION ALL SELECT *, 3 FROM remainders) QUALIFY row_number() OVER (PARTITION BY ticker, concept_name, period_start, period_end ORDER BY o) = 1)"""


def _spans(t: Tables) -> DataFrame:
    day = F.to_date("l_shipdate")
    quarter = F.trunc(day, "quarter")
    return t("lineitem").select(
        F.col("l_suppkey").cast("string").alias("ticker"),
        F.col("l_linestatus").alias("concept_name"),
        F.col("l_extendedprice").alias("value"),
        F.when(F.col("l_linenumber").isin(1, 4), quarter).otherwise(F.trunc(day, "year")).alias("period_start"),
        F.when(F.col("l_linenumber").isin(3, 7), F.make_date(F.year(day), F.lit(12), F.lit(31))).otherwise(F.date_add(F.add_months(quarter, 3), -1)).alias("period_end"),
        F.date_add(day, 100).alias("filing_date"),
    )


@query(f"WITH {_SPANS} SELECT ticker, concept_name, {base.iso('period_start', 'period_end', 'filing_date')}, round(value, 6) AS value, origin FROM quarters")
def facts_by_quarter(t: Tables) -> DataFrame:
    """Single quarters: reported ones, differences of amounts of the year so far, and what three quarters leave of a year."""
    return comparable(durations.quarterly(_spans(t), ties=["value"]))


@query(
    f"""WITH {_SPANS}, counted AS (SELECT *, period_end - period_start + 1 AS days FROM spans)
SELECT ticker, concept_name, {base.iso('period_start', 'period_end', 'filing_date')}, round(value, 6) AS value FROM counted WHERE days BETWEEN 80 AND 380
QUALIFY row_number() OVER (PARTITION BY ticker, concept_name, period_end ORDER BY days DESC, filing_date DESC, value DESC) = 1"""
)
def facts_year_to_date(t: Tables) -> DataFrame:
    """The longest amount of each period end."""
    return comparable(durations.year_to_date(_spans(t), ties=["value"]))


@query(
    f"""WITH {_SPANS}, named AS (SELECT concept_name, CASE WHEN d BETWEEN 80 AND 100 THEN 'quarter' WHEN d BETWEEN 170 AND 195 THEN 'half_year' WHEN d BETWEEN 260 AND 285 THEN 'nine_months'
  WHEN d BETWEEN 350 AND 380 THEN 'year' ELSE 'other' END AS duration FROM (SELECT *, period_end - period_start + 1 AS d FROM spans))
SELECT concept_name, duration, count(*) AS n FROM named GROUP BY ALL"""
)
def facts_by_duration(t: Tables) -> DataFrame:
    """How many facts cover a quarter, half a year, nine months, a year or another length."""
    return comparable(durations.with_duration(_spans(t)).groupBy("concept_name", "duration").agg(F.count(F.lit(1)).alias("n")))
