"""As-of joins and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.asof import asof_join
from ..operators.joins import attach
from ..plans.features import MARKET_CORE, MARKET_FEATURES, STATEMENT_FEATURES, forward_labels, market_features, statement_features
from ..plans.panels import bars_to_panel, clean_fundamentals, fundamental_versions, market_panel, panel_as_known, statement_panel, usable_rows
from ..sources.facts import CONCEPTS
from . import common as base
from .facts import STATEMENTS
from .market import FEATURES, LABELS
from .registry import REGISTRY, Tables, comparable, query

_EVENT_PAIR_SQL = """
WITH l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts, event_id AS view_id, value AS view_value FROM events WHERE event_type = 'view')
SELECT l.event_id, l.user_id, round(l.value, 6) AS value, strftime(r.ts, '%Y-%m-%d %H:%M:%S.%f') AS view_ts,
       r.view_id, round(r.view_value, 6) AS view_value
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts"""


def _event_pairs(t: Tables, **how) -> DataFrame:
    events = t("events").select("event_id", "user_id", "ts", "value", "event_type")
    left = events.where(F.col("event_type") == "purchase").drop("event_type")
    right = events.where(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value")
    )
    return comparable(asof_join(left, right, ["user_id"], "ts", "view_ts", ties=["view_id"], **how).drop("ts"))


@query(_EVENT_PAIR_SQL)
def asof_events(t: Tables) -> DataFrame:
    """Each purchase with the user's last view before it; hot users are split along time."""
    return _event_pairs(t)


@query(_EVENT_PAIR_SQL)
def asof_events_split(t: Tables) -> DataFrame:
    """The same with every user taken for hot, and the histories cut at some hundred places."""
    return _event_pairs(t, rows_per_segment=max(10, t("events").count() // 100), hot_rows=0)


@query(
    """
WITH l AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'O'),
r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderpriority, o_totalprice, o_orderkey FROM orders WHERE o_orderstatus = 'F'
      QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderpriority DESC, o_orderkey DESC) = 1)
SELECT l.o_orderkey, l.o_custkey, CAST(l.d AS VARCHAR) AS d, CAST(r.d AS VARCHAR) AS last_d,
       r.o_orderpriority AS last_priority, round(r.o_totalprice, 6) AS last_price
FROM l ASOF LEFT JOIN r ON l.o_custkey = r.o_custkey AND l.d >= r.d"""
)
def asof_ties(t: Tables) -> DataFrame:
    """Several right rows on one day: the greatest tie columns win."""
    orders = t("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    left = orders.where(F.col("o_orderstatus") == "O").select("o_orderkey", "o_custkey", "d")
    right = orders.where(F.col("o_orderstatus") == "F").select(
        "o_custkey", "d", F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), "o_orderkey"
    )
    return comparable(
        asof_join(
            left, right, ["o_custkey"], "d", "d", ties=["priority", "o_orderkey"],
            right_columns=["d", "priority", "price"], prefix="last_",
        )
    )


PANEL = f"""{STATEMENTS}, {LABELS},
filed AS (SELECT * FROM statements
  QUALIFY row_number() OVER (PARTITION BY ticker, filing_date ORDER BY period_end DESC) = 1),
panel AS (
  SELECT b.ticker, b.date, b.adj_close, b.volume, b.forward_return_5d, b.label, f.* EXCLUDE (ticker)
  FROM labelled b ASOF LEFT JOIN filed f ON b.ticker = f.ticker AND b.date >= f.filing_date)"""


def _statements(t: Tables) -> DataFrame:
    return statement_features(clean_fundamentals(base.raw_facts(t), ties=base.TIES))


def _panel(t: Tables) -> DataFrame:
    return statement_panel(forward_labels(base.bars(t)), _statements(t))


@query(
    f"""WITH {PANEL}
SELECT ticker, {base.iso('date', 'filing_date', 'period_end')}, adj_close, {base.r6('forward_return_5d')},
       CAST(label AS BIGINT) AS label, form_type, {base.r6(*STATEMENT_FEATURES)}
FROM panel"""
)
def statement_panel_rows(t: Tables) -> DataFrame:
    """Every bar with the newest filed statement features."""
    columns = ["ticker", "date", "filing_date", "period_end", "adj_close", "forward_return_5d", "label", "form_type"]
    return comparable(_panel(t).select(*columns, *STATEMENT_FEATURES), exact=("adj_close",))


@query(
    f"""WITH {PANEL}
SELECT ticker, {base.iso('date', 'filing_date')}, {base.r6('forward_return_5d')}, CAST(label AS BIGINT) AS label,
       {base.r6(*STATEMENT_FEATURES)}
FROM panel WHERE filing_date IS NOT NULL AND label IS NOT NULL"""
)
def modelling_panel(t: Tables) -> DataFrame:
    """Panel rows usable for modelling: a filing is known and a label exists."""
    columns = ["ticker", "date", "filing_date", "forward_return_5d", "label", *STATEMENT_FEATURES]
    return comparable(usable_rows(_panel(t)).select(*columns))


@query(
    f"""WITH {PANEL}, {FEATURES[FEATURES.index('moves AS'):]}
SELECT p.ticker, CAST(p.date AS VARCHAR) AS date, CAST(p.label AS BIGINT) AS label, round(p.net_margin, 6) AS net_margin,
       {", ".join(f"round(m.{c}, 6) AS {c}" for c in MARKET_FEATURES)}
FROM panel p LEFT JOIN market m ON p.ticker = m.ticker AND p.date = m.date
WHERE p.filing_date IS NOT NULL AND p.label IS NOT NULL"""
)
def statement_market_panel(t: Tables) -> DataFrame:
    """Usable panel rows with the market features of the day, from one pass over the bars."""
    panel = usable_rows(bars_to_panel(base.bars(t), _statements(t), keep=["ticker", "date", "label", "filing_date", "net_margin"]))
    return comparable(panel.select("ticker", "date", "label", "net_margin", *MARKET_FEATURES))


@query(REGISTRY["statement_market_panel"].sql)
def statement_market_join(t: Tables) -> DataFrame:
    """The same from two tables joined on key and day."""
    panel = usable_rows(_panel(t)).select("ticker", "date", "label", "net_margin")
    return comparable(market_panel(panel, market_features(base.bars(t))))


@query(
    f"""WITH {FEATURES}
SELECT CAST(l.l_suppkey AS VARCHAR) AS ticker, l.l_orderkey, l.l_partkey, l.l_linenumber, CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR) AS date,
       {", ".join(f"round(m.{c}, 6) AS {c}" for c in MARKET_CORE)}
FROM lineitem l LEFT JOIN (SELECT * FROM market WHERE volatility_21d IS NOT NULL) m
  ON CAST(l.l_suppkey AS VARCHAR) = m.ticker AND CAST(l.l_shipdate AS DATE) = m.date"""
)
def attach_market_features(t: Tables) -> DataFrame:
    """Item lines with the market features of supplier and day; days still warming up stay null."""
    lines = t("lineitem").select(
        F.col("l_suppkey").cast("string").alias("ticker"), "l_orderkey", "l_partkey", "l_linenumber", F.to_date("l_shipdate").alias("date")
    )
    ready = market_features(base.bars(t)).where(F.col("volatility_21d").isNotNull())
    return comparable(attach(lines, ready, ["ticker", "date"], MARKET_CORE))


_FIRST = f"""{base.FACTS},
earliest AS (
  SELECT * FROM facts
  QUALIFY row_number() OVER (PARTITION BY ticker, period_end, concept_name ORDER BY filing_date, value DESC, form_type DESC) = 1),
meta AS (
  SELECT ticker, cik, filing_date, period_end, fiscal_period, fiscal_year, form_type FROM earliest
  QUALIFY row_number() OVER (PARTITION BY ticker, period_end ORDER BY filing_date, concept_name) = 1),
cells AS (SELECT ticker, period_end, {", ".join(f"max(CASE WHEN concept_name = '{c}' THEN value END) AS {c}" for c in CONCEPTS)} FROM earliest GROUP BY 1, 2)
SELECT m.ticker, cik, CAST(filing_date AS VARCHAR) AS filing_date, CAST(m.period_end AS VARCHAR) AS period_end, fiscal_period, fiscal_year, form_type, {base.r6(*CONCEPTS)}
FROM meta m JOIN cells c ON m.ticker = c.ticker AND m.period_end = c.period_end"""


@query(f"WITH {_FIRST}")
def fundamentals_first_reported(t: Tables) -> DataFrame:
    """Every value as first reported."""
    return comparable(clean_fundamentals(base.raw_facts(t), ties=base.TIES, keep="first"))


_VERSIONS = f"""{base.FACTS}, {LABELS},
daily AS (
  SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY ticker, period_end, filing_date, concept_name ORDER BY value DESC, form_type DESC) = 1),
filed AS (
  SELECT ticker, period_end, filing_date, max_by(form_type, concept_name) AS form_type, {", ".join(f"max(CASE WHEN concept_name = '{c}' THEN value END) AS {c}" for c in CONCEPTS)}
  FROM daily GROUP BY 1, 2, 3),
versions AS (
  SELECT ticker, period_end, filing_date, form_type, {", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in CONCEPTS)}
  FROM filed WINDOW w AS (PARTITION BY ticker, period_end ORDER BY filing_date ROWS UNBOUNDED PRECEDING))"""

_AS_KNOWN = f"""WITH {_VERSIONS},
best AS (
  SELECT ticker, filing_date AS known_from, max({{'period_end': period_end, 'filing_date': filing_date}}) OVER (PARTITION BY ticker ORDER BY filing_date RANGE UNBOUNDED PRECEDING) AS b
  FROM versions),
steps AS (SELECT DISTINCT ticker, known_from, b.period_end AS period_end, b.filing_date AS filing_date FROM best),
known AS (SELECT s.known_from, v.* FROM steps s JOIN versions v ON s.ticker = v.ticker AND s.period_end = v.period_end AND s.filing_date = v.filing_date)
SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, CAST(b.label AS BIGINT) AS label, {base.iso('k.period_end', 'k.filing_date').replace('AS k.', 'AS ')}, k.form_type, {base.r6(*CONCEPTS)}
FROM labelled b ASOF LEFT JOIN known k ON b.ticker = k.ticker AND b.date >= k.known_from"""


def _as_known(t: Tables, **how) -> DataFrame:
    known = fundamental_versions(base.raw_facts(t), ties=base.TIES)
    panel = panel_as_known(forward_labels(base.bars(t)), known, **how)
    return comparable(panel.select("ticker", "date", "label", "period_end", "filing_date", "form_type", *CONCEPTS))


@query(_AS_KNOWN)
def panel_known_by_day(t: Tables) -> DataFrame:
    """Every bar with the newest period filed by its day, in the version of that day."""
    return _as_known(t)


@query(_AS_KNOWN)
def panel_known_by_day_split(t: Tables) -> DataFrame:
    """The same with every key taken for hot, and the histories cut at some hundred places."""
    return _as_known(t, rows_per_segment=max(10, t("lineitem").count() // 100), hot_rows=0)
