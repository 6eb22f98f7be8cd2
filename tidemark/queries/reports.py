"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality
from ..plans.features import MARKET_FEATURES, forward_labels, market_features
from . import common as base
from .market import FEATURES, LABELS
from .registry import Tables, comparable, query


@query(
    f"""WITH {LABELS}
SELECT count(*) AS row_count, count(DISTINCT ticker) AS distinct_keys, CAST(min(date) AS VARCHAR) AS first_date,
       CAST(max(date) AS VARCHAR) AS last_date, count(label) AS labelled_rows, count(*) - count(label) AS unlabelled_rows
FROM labelled"""
)
def table_summary(t: Tables) -> DataFrame:
    return comparable(quality.table_summary(forward_labels(base.bars(t)), "ticker", "date", "label"))


def _missing_sql(source: str, columns: tuple[str, ...] | list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 6) AS missing_pct FROM {source}"
        for c in columns
    )


@query(f"WITH {FEATURES}, m AS MATERIALIZED (SELECT * FROM market)\n{_missing_sql('m', MARKET_FEATURES)}")
def missing_market_features(t: Tables) -> DataFrame:
    return comparable(quality.missing_percentages(market_features(base.bars(t)), MARKET_FEATURES))


@query(f"WITH j AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))\n{_missing_sql('j', ['doc_id', 'lang', 'quality', 'toxic'])}")
def missing_labels(t: Tables) -> DataFrame:
    joined = t("documents").join(t("labels"), "doc_id", "left")
    return comparable(quality.missing_percentages(joined, ["doc_id", "lang", "quality", "toxic", "absent_column"]))


@query("SELECT CAST(quality AS BIGINT) AS quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def value_counts(t: Tables) -> DataFrame:
    """Counts with the null group."""
    return comparable(quality.value_counts(t("documents").join(t("labels"), "doc_id", "left"), "quality"))


@query("SELECT lang, round(avg(length(text)), 6) AS mean_chars FROM documents GROUP BY 1")
def mean_length_by_group(t: Tables) -> DataFrame:
    return comparable(quality.group_mean(t("documents").select("lang", F.length("text").alias("chars")), "lang", "chars"))


@query(
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean_value FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )
)
def column_means(t: Tables) -> DataFrame:
    return comparable(quality.column_means(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query(
    """
SELECT count(*) AS row_count, round(avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS class_0_pct,
       round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) * 100, 6) AS class_1_pct
FROM documents JOIN labels USING (doc_id)"""
)
def class_balance(t: Tables) -> DataFrame:
    joined = t("documents").join(t("labels"), "doc_id", "left")
    return comparable(quality.class_balance(joined, "quality"))
