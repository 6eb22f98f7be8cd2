"""The study end to end: each stage reads the tables it needs below one root folder and writes its own.

Inputs below the root:

- ``input/tickers.json``: symbol to identifier map
- ``input/facts/CIK##########.json``: company facts, one document per entity
- ``input/prices``: parquet, a date column and ``field|ticker`` columns
- ``input/filings``: parquet, pulled filings with ``plain`` and ``markdown`` texts

``run(spark, root, "statement_panel")`` runs one stage; ``run_all`` runs all of them in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import FILING_INDEX, FILING_SENTIMENT, PRICE_TABLE, SECTION_SENTIMENT, align, typed_empty
from ..operators.joins import lookup, missing_concepts, missing_members
from ..operators.modeling import MIN_DATES, ModelSizes
from ..operators.reshape import wide_prices_to_long
from ..operators.scoring import DEFAULT_LEXICON, Chunker, Scorer, split_failures, word_chunks
from ..session import cut_lineage
from ..sources.facts import CONCEPTS, HORIZON, build_raw_facts, entity_ids, flatten_facts, read_documents
from ..sources.filings import index_filings, original_filings
from ..sources.tables import scan, write_metrics, write_panel, write_table
from ..sources.universe import TICKERS, universe
from .comparison import Comparison, Setup, compare
from .features import (
    MARKET_CORE,
    MARKET_FEATURES,
    STATEMENT_FEATURES,
    forward_labels,
    market_features,
    normalized_bars,
    normalized_fundamentals,
    statement_features,
    text_feature_names,
    text_features,
)
from .filings import resume, score_filings, score_sections
from .panels import clean_fundamentals, market_panel, statement_panel, text_panel, usable_rows

# Source field names of the price layout.
PRICE_FIELDS = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}
SEC, MDA = tuple(text_feature_names("sec_")), tuple(text_feature_names("mda_"))


@dataclass
class Study:
    """Where a study lives, and the choices that apply to it."""

    spark: SparkSession
    root: str
    tickers: Iterable[str] = TICKERS
    horizon: tuple[str, str] = HORIZON
    scorer: Scorer = DEFAULT_LEXICON
    chunker: Chunker = field(default_factory=word_chunks)
    sizes: ModelSizes = ModelSizes()
    max_filings: int | None = None
    rescore: bool = False

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def read(self, name: str) -> DataFrame:
        return scan(self.spark, self.path(name))

    def has(self, name: str) -> bool:
        try:
            self.read(name)
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return False
            raise
        return True


def _facts(s: Study) -> None:
    """Facts of the universe's entities; entities without an identifier and missing concepts are listed."""
    ids = entity_ids(read_documents(s.spark, s.path("input/tickers.json")))
    wanted = universe(s.spark, s.tickers).select("ticker").distinct()
    known, unmatched = lookup(wanted, ids, ["ticker"])
    documents = read_documents(s.spark, s.path("input/facts/*.json")).withColumn(
        "cik", F.regexp_extract("path", r"CIK(\d+)\.json$", 1)
    )
    raw = build_raw_facts(flatten_facts(documents.join(known, "cik"), horizon=s.horizon))
    write_table(raw, s.path("raw_facts"))
    write_table(unmatched, s.path("reports/unmatched_tickers"))
    gaps = missing_concepts(s.read("raw_facts").withColumnRenamed("concept_name", "concept"), known, "ticker", "concept", CONCEPTS)
    write_table(gaps, s.path("reports/missing_concepts"))


def _fundamentals(s: Study) -> None:
    write_table(clean_fundamentals(s.read("raw_facts")), s.path("fundamentals"))
    absent = missing_members(universe(s.spark, s.tickers), s.read("fundamentals"), ["ticker"])
    write_table(absent, s.path("reports/absent_tickers"))


def _statements(s: Study) -> None:
    write_table(statement_features(normalized_fundamentals(s.read("fundamentals"))), s.path("statement_features"))


def _prices(s: Study) -> None:
    only = list(s.tickers)[0]
    long = wide_prices_to_long(s.read("input/prices"), PRICE_FIELDS, single_ticker=only)
    write_table(align(forward_labels(long, horizon=s.horizon), PRICE_TABLE), s.path("prices"))


def _market(s: Study) -> None:
    write_table(market_features(normalized_bars(s.read("prices"))), s.path("market_features"))


def _panel(s: Study) -> None:
    write_panel(usable_rows(statement_panel(s.read("prices"), s.read("statement_features"))), s.path("statement_panel"))


def _index(s: Study) -> None:
    """Newly pulled filings are appended to the index, which also holds their texts as a column."""
    existing = s.read("filing_index") if s.has("filing_index") else typed_empty(s.spark, FILING_INDEX)
    new = index_filings(typed_dates(s.read("input/filings")), s.path("texts"), existing)
    write_table(new, s.path("filing_index"), mode="append")


def typed_dates(found: DataFrame) -> DataFrame:
    """Pulled filings with typed dates, whatever type they arrived in."""
    return found.withColumns({c: F.col(c).cast("string").try_cast("date") for c in ("filing_date", "period_end")})


def _scoring(name: str, score: Callable[..., DataFrame]) -> Callable[[Study], None]:
    def stage(s: Study) -> None:
        """Score the filings that have no result yet and append them; failures are written apart."""
        chosen = original_filings(s.read("filing_index"), horizon=s.horizon, max_filings=s.max_filings)
        contract = SECTION_SENTIMENT if score is score_sections else FILING_SENTIMENT
        fresh_start = s.rescore or not s.has(name)
        existing = typed_empty(s.spark, contract) if fresh_start else align(s.read(name), contract)
        todo = resume(chosen, existing, s.rescore)
        # written once: both outputs read it, and a model must not run twice
        good, bad = split_failures(cut_lineage(score(todo, s.scorer, s.chunker)))
        write_table(good, s.path(name), mode="overwrite" if fresh_start else "append")
        write_table(bad, s.path(f"reports/{name}_failures"))

    return stage


def _text_features(source: str, target: str, prefix: str, length: str | None) -> Callable[[Study], None]:
    def stage(s: Study) -> None:
        write_table(text_features(s.read(source), prefix, text_length=length), s.path(target))

    return stage


def _text_panel(features: str, target: str, prefix: str) -> Callable[[Study], None]:
    def stage(s: Study) -> None:
        write_panel(text_panel(s.read("statement_panel").drop("year"), s.read(features), prefix), s.path(target))

    return stage


def save_comparison(result: Comparison, folder: str) -> None:
    """Metrics, column reports and summary as JSON lines, best-model predictions as parquet."""
    for name, frame in (
        ("metrics", result.tidy()), ("best", result.best), ("columns", result.column_report()), ("summary", result.summary),
    ):
        write_metrics(frame, f"{folder}/{name}")
    write_table(result.best_predictions(), f"{folder}/predictions")


def _baseline(s: Study) -> None:
    panel = s.read("statement_panel")
    save_comparison(compare({"layer1_only": Setup(panel, STATEMENT_FEATURES)}, s.sizes, min_dates=MIN_DATES), s.path("results/baseline"))


# Fixed values in the next two stages: the names of the feature setups.
def _compare_market(s: Study) -> None:
    panel = market_panel(s.read("statement_panel"), s.read("market_features"))
    setups = {
        "layer1_only": Setup(panel, STATEMENT_FEATURES),
        "layer1_plus_layer2_core": Setup(panel, STATEMENT_FEATURES + MARKET_CORE),
        "layer1_plus_layer2_full": Setup(panel, STATEMENT_FEATURES + MARKET_FEATURES),
    }
    save_comparison(compare(setups, s.sizes), s.path("results/market"))


def _compare_text(*variants: str) -> Callable[[Study], None]:
    columns = {"full": ("filing_panel", SEC), "mda": ("section_panel", MDA)}

    def stage(s: Study) -> None:
        setups = {"layer1_only": Setup(s.read("statement_panel"), STATEMENT_FEATURES)}
        for v in variants:
            name = "layer1_plus_layer3" if len(variants) == 1 else f"layer1_plus_layer3_{v}"
            setups[name] = Setup(s.read(columns[v][0]), STATEMENT_FEATURES + columns[v][1])
        save_comparison(compare(setups, s.sizes), s.path("results/text_" + "_".join(variants)))

    return stage


STAGES: dict[str, Callable[[Study], None]] = {
    "raw_facts": _facts,
    "fundamentals": _fundamentals,
    "statement_features": _statements,
    "prices": _prices,
    "market_features": _market,
    "statement_panel": _panel,
    "filing_index": _index,
    "filing_sentiment": _scoring("filing_sentiment", score_filings),
    "section_sentiment": _scoring("section_sentiment", score_sections),
    "filing_features": _text_features("filing_sentiment", "filing_features", "sec_", None),
    "section_features": _text_features("section_sentiment", "section_features", "mda_", "mda_text_length"),
    "filing_panel": _text_panel("filing_features", "filing_panel", "sec_"),
    "section_panel": _text_panel("section_features", "section_panel", "mda_"),
    "baseline": _baseline,
    "compare_market": _compare_market,
    "compare_text": _compare_text("full"),
    "compare_text_sections": _compare_text("full", "mda"),
}


def run(study: Study, stage: str) -> None:
    STAGES[stage](study)


def run_all(study: Study) -> None:
    for stage in STAGES.values():
        stage(study)
