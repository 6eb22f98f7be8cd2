"""The studied universe of symbols."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normalize_symbol

# The 34 symbols of the study.
TICKERS = (
    "WMT", "COST", "PG", "KO", "PM", "MDLZ", "PEP", "MO", "CL", "TGT", "MNST", "KR", "KDP", "ADM", "SYY", "KMB", "HSY",
    "DG", "CHD", "STZ", "DLTR", "GIS", "KHC", "TSN", "EL", "BG", "CLX", "MKC", "SJM", "CAG", "TAP", "HRL", "BF-B", "CPB",
)


def universe(spark: SparkSession, tickers: Iterable[str | None] = TICKERS) -> DataFrame:
    """(position, ticker): cleaned symbols without blanks; order and repeats are kept."""
    rows = spark.createDataFrame(list(enumerate(tickers)), "position int, ticker string")
    return rows.withColumn("ticker", normalize_symbol("ticker")).dropna(subset=["ticker"])
