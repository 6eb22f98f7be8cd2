"""Filing text: corpus scan, choice of text, index rows, resume keys."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import FILING_INDEX, align
from ..functions.scalars import within
from ..functions.text import WS
from ..operators.dedup import keep_first

# Forms scored, the stand-in for an unknown accession, study horizon.
ORIGINAL_FORMS = ("10-K", "10-Q")
UNKNOWN_ACCESSION = "unknown_accession"
HORIZON = ("2015-01-01", "2024-12-31")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) per file. UTF-8, with undecodable bytes left out rather than replaced."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), decode_lenient(F.col("content")).alias("text"))


def decode_lenient(content: Column) -> Column:
    """UTF-8 decoding that ignores bad bytes.

    Valid content never leaves the JVM. Only rows that fail the validity test take the Arrow route.
    """
    good = F.is_valid_utf8(content.cast("string"))
    return F.when(good, content.cast("string")).otherwise(_drop_bad_bytes(F.when(~good, content)))


@F.pandas_udf(T.StringType())
def _drop_bad_bytes(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def attach_texts(index: DataFrame, texts: DataFrame, path: str = "text_file_path") -> DataFrame:
    """Index rows with their text; rows whose file is missing are dropped and can be listed apart."""
    return index.join(texts.withColumnRenamed("path", path), path, "inner")


def missing_texts(index: DataFrame, texts: DataFrame, path: str = "text_file_path") -> DataFrame:
    return index.join(texts.select(F.col("path").alias(path)), path, "left_anti")


def choose_text(*candidates: Column) -> Column:
    """First candidate that is more than whitespace, returned as it is; else empty."""
    return F.coalesce(*[F.when(c.rlike(f"[^{WS}]"), c) for c in candidates], F.lit(""))


def filing_key(accession: str = "accession_number", form: str = "form_type", day: str = "filing_date") -> Column:
    """Key (kind, id): the accession where known, else the form with the filing date."""
    a = F.col(accession)
    known = a.isNotNull() & (a != "") & (a != UNKNOWN_ACCESSION)
    day_text = F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("unknown_date"))
    return F.when(known, F.struct(F.lit("accession").alias("kind"), a.alias("id"))).otherwise(
        F.struct(F.col(form).alias("kind"), day_text.alias("id"))
    )


def text_path(root: str, ticker: str = "ticker") -> Column:
    """Where a filing's text is kept: ``root/ticker/date_form_accession.txt``."""
    form = F.replace(F.col("form_type"), F.lit("/"), F.lit("_"))
    name = F.concat_ws("_", F.date_format("filing_date", "yyyy-MM-dd"), form, F.col("accession_number"))
    return F.concat(F.lit(root.rstrip("/") + "/"), F.col(ticker), F.lit("/"), name, F.lit(".txt"))


def filing_index(rows: DataFrame, order: Sequence[str] = ("filing_date", "form_type", "text_file_path")) -> DataFrame:
    """Typed index, one row per (ticker, accession): the first in ``order``."""
    return align(keep_first(rows, ["ticker", "accession_number"], order), FILING_INDEX)


def new_filings(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Filings whose (ticker, key) the existing index does not have."""
    keyed = found.withColumn("__key", filing_key())
    known = existing.select("ticker", filing_key().alias("__key")).distinct()
    return keyed.join(known, ["ticker", "__key"], "left_anti").drop("__key")


def index_filings(found: DataFrame, root: str, existing: DataFrame | None = None, source: str = "filings") -> DataFrame:
    """Index columns plus ``text`` for pulled filings with ``plain`` and ``markdown`` texts.

    Filings without a date or without any text are left out, known ones skipped, and one row per
    (ticker, accession) is kept. Lengths are characters.
    """
    dated = found.dropna(subset=["filing_date"])
    fresh = dated if existing is None else new_filings(dated, existing)
    rows = (
        fresh.withColumn("text", choose_text(F.col("plain"), F.col("markdown")))
        .where(F.col("text") != "")
        .withColumns({"text_length": F.length("text").cast("bigint"), "text_file_path": text_path(root), "source": F.lit(source)})
    )
    return keep_first(rows, ["ticker", "accession_number"], ["filing_date", "form_type", "text_file_path"]).select(
        *FILING_INDEX.names, "text"
    )


def original_filings(
    index: DataFrame,
    forms: Sequence[str] = ORIGINAL_FORMS,
    horizon: tuple[str, str] = HORIZON,
    max_filings: int | None = None,
) -> DataFrame:
    """Original (unamended) filings inside the horizon; optionally the first few in sorted order."""
    kept = index.where(F.col("form_type").isin(*forms) & within("filing_date", *horizon))
    if max_filings is None:
        return kept
    return kept.orderBy("ticker", "filing_date", "form_type", "accession_number").limit(max_filings)
