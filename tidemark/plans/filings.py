"""Filing sentiment: clean, optionally cut out the section, chunk, score, average."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import FILING_SENTIMENT, SECTION_SENTIMENT, align
from ..functions.text import MIN_SECTION_CHARS, discussion_section, normalize_whitespace
from ..operators.dedup import append_new, new_only
from ..operators.scoring import DEFAULT_LEXICON, Chunker, Scorer, score_texts, word_chunks

_INDEX = ["ticker", "cik", "company_name", "form_type", "filing_date", "period_end", "accession_number", "text_file_path"]


def score_filings(
    filings: DataFrame,
    scorer: Scorer = DEFAULT_LEXICON,
    chunker: Chunker = word_chunks(),
    model_name: str = "lexicon",
    source: str = "full_text",
) -> DataFrame:
    """Whole-filing sentiment. Filings without text or chunks are dropped; failed ones keep an error.

    ``filings`` has the index columns and ``text``.
    """
    cleaned = filings.withColumn("__clean", normalize_whitespace("text")).select(
        *_INDEX, "text_length", "__clean", F.length("__clean").cast("bigint").alias("clean_text_length")
    )
    scored = score_texts(cleaned, "__clean", [*_INDEX, "text_length", "clean_text_length"], scorer, chunker)
    kept = scored.where(F.col("chunk_count") > 0).withColumns(
        {"model_name": F.lit(model_name), "source": F.lit(source)}
    )
    return kept.select(*FILING_SENTIMENT.names, "scoring_error")


def score_sections(
    filings: DataFrame,
    scorer: Scorer = DEFAULT_LEXICON,
    chunker: Chunker = word_chunks(),
    min_chars: int = MIN_SECTION_CHARS,
    model_name: str = "lexicon",
    source: str = "section_text",
) -> DataFrame:
    """Discussion-section sentiment. Every filing is kept, with a status that says how far it came."""
    cut = filings.select(
        *_INDEX,
        F.length("text").cast("bigint").alias("raw_text_length"),
        discussion_section("text", "form_type", min_chars).alias("s"),
    ).select(
        *_INDEX,
        "raw_text_length",
        F.length("s.text").cast("bigint").alias("mda_text_length"),
        F.col("s.status").alias("__status"),
        F.col("s.method").alias("extraction_method"),
        F.when(F.col("s.status") == "scored", F.col("s.text")).alias("__section"),
    )
    keep = [*_INDEX, "raw_text_length", "mda_text_length", "__status", "extraction_method"]
    scored = score_texts(cut, "__section", keep, scorer, chunker)
    done = (F.col("__status") == "scored") & (F.col("chunk_count") > 0)
    status = F.when((F.col("__status") == "scored") & (F.col("chunk_count") == 0), "no_valid_chunks").otherwise(
        F.col("__status")
    )
    return scored.withColumns(
        {
            "mda_found": done.cast("int"),
            "extraction_status": status,
            "chunk_count": F.when(done, F.col("chunk_count")),
            "model_name": F.lit(model_name),
            "source": F.lit(source),
        }
    ).select(*SECTION_SENTIMENT.names, "scoring_error")


def resume(candidates: DataFrame, existing: DataFrame, rescore: bool = False) -> DataFrame:
    """Filings whose accession has not been scored yet."""
    known = existing.where(F.col("accession_number") != "")
    return new_only(candidates, known, ["accession_number"], rescore)


def merge_scored(existing: DataFrame, new: DataFrame, section: bool = False) -> DataFrame:
    """Existing results plus new ones under one contract; the existing row of an accession stays."""
    contract = SECTION_SENTIMENT if section else FILING_SENTIMENT
    return append_new(
        align(existing, contract), align(new, contract), ["ticker", "accession_number"], ["filing_date", "form_type"]
    )
