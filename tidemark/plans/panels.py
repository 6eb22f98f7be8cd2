"""Statement and filing-text panels: from facts, bars and scored filings to one row per key and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import FUNDAMENTALS_META, LABELLED_BARS, RAW_FACTS, STATEMENT_FEATURES, enforce
from ..operators.asof import asof_join
from ..operators.bitemporal import as_known_join, versions
from ..operators.joins import attach
from ..operators.reshape import facts_to_wide
from ..operators.segments import ROWS_PER_SEGMENT
from ..sources.facts import ALLOWED_FORMS, CONCEPTS
from .features import MARKET_FEATURES, forward_labels, market_features, text_feature_names


def normalize_facts(raw: DataFrame) -> DataFrame:
    """Typed facts of the accepted forms that have every key."""
    facts = enforce(raw, RAW_FACTS).where(F.col("form_type").isin(*ALLOWED_FORMS))
    return facts.dropna(subset=["ticker", "cik", "filing_date", "period_end", "concept_name"])


def _ties(facts: DataFrame, ties: Sequence[str] | None) -> list[str]:
    if ties is not None:
        return list(ties)
    return ["fact_order"] if "fact_order" in facts.columns else ["value"]


def clean_fundamentals(
    raw: DataFrame, concepts: Sequence[str] = CONCEPTS, ties: Sequence[str] | None = None, keep: str = "last"
) -> DataFrame:
    """One wide row per ticker and period end, every value from its latest filing.

    ``ties`` orders facts of one filing date; by default the recorded position of the fact, else its value.
    ``keep="first"`` takes every value as first reported.
    """
    facts = normalize_facts(raw)
    return facts_to_wide(
        facts, ["ticker", "period_end"], FUNDAMENTALS_META.names, "concept_name", "value",
        concepts, latest=["filing_date"], ties=_ties(facts, ties), owner="cik", keep=keep,
    )


def fundamental_versions(raw: DataFrame, concepts: Sequence[str] = CONCEPTS, ties: Sequence[str] | None = None) -> DataFrame:
    """One wide row per ticker, period end and filing day: all that was known of the period by that day."""
    facts = normalize_facts(raw)
    return versions(
        facts, ["ticker", "period_end"], "filing_date", FUNDAMENTALS_META.names, "concept_name", "value",
        concepts, ties=_ties(facts, ties), together=["ticker"],
    )


def panel_as_known(
    labelled_bars: DataFrame, known: DataFrame, rows_per_segment: int | None = None, hot_rows: int | None = None
) -> DataFrame:
    """Every bar with the newest period filed by its day, as it was known on that day.

    Unlike :func:`statement_panel` a later correction changes no earlier bar, and a correction of an old
    period does not stand in for a newer one. ``known`` comes from :func:`fundamental_versions`.
    """
    bars = enforce(labelled_bars, LABELLED_BARS)
    return as_known_join(
        bars, known, ["ticker"], "date", "filing_date", ["period_end"],
        rows_per_segment=rows_per_segment, hot_rows=hot_rows,
    )


def statement_panel(
    labelled_bars: DataFrame, features: DataFrame, rows_per_segment: int | None = None
) -> DataFrame:
    """Every bar with the newest statement row filed on or before its day.

    Bars have one row per key and day and statements one per key and period, so histories are
    bounded by the calendar and the hot-key pass is off by default.
    """
    bars = enforce(labelled_bars, LABELLED_BARS)
    return asof_join(
        bars, enforce(features, STATEMENT_FEATURES), ["ticker"], "date", "filing_date",
        ties=["period_end"], rows_per_segment=rows_per_segment,
    )


def usable_rows(panel: DataFrame) -> DataFrame:
    """Rows with a known filing and a known label."""
    return panel.dropna(subset=["filing_date", "label"])


def text_panel(
    panel: DataFrame, text_features: DataFrame, prefix: str = "sec_", rows_per_segment: int | None = ROWS_PER_SEGMENT
) -> DataFrame:
    """A statement panel with the newest filing-text row; the filing's own columns get ``sent_`` names.

    Filings per key and day are not bounded, so hot keys are split by default.
    """
    filing = ["filing_date", "accession_number", "form_type"]
    right = text_features.select(
        "ticker", *[F.col(c).alias(f"sent_{c}") for c in filing], *text_feature_names(prefix)
    )
    return asof_join(
        panel, right, ["ticker"], "date", "sent_filing_date",
        ties=["sent_accession_number"], rows_per_segment=rows_per_segment,
    )


def bars_to_panel(
    bars: DataFrame, statements: DataFrame, horizon: tuple[str, str] | None = None, rows_per_segment: int | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Labels, newest statement and market features of every bar, from one exchange of the bars.

    Equal to :func:`statement_panel` followed by :func:`market_panel` where both tables come from the
    same bars, without the join: the features are worked out on the panel's rows, which the as-of join leaves dealt by
    key. As in the separate tables, labels see the bars beyond the horizon and trailing features start inside it.
    ``keep`` names the panel's columns that are wanted beside the features, by default all.
    """
    labelled = forward_labels(bars, horizon=horizon, rows_per_segment=rows_per_segment)
    panel = statement_panel(labelled, statements, rows_per_segment)
    return market_features(panel, keep=keep or panel.columns, rows_per_segment=rows_per_segment)


def market_panel(panel: DataFrame, market: DataFrame) -> DataFrame:
    """A statement panel with the market features of the same key and day."""
    return attach(panel, market, ["ticker", "date"], MARKET_FEATURES)
