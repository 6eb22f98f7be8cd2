"""Column contracts: what a stage needs, which type each column has, and how bad values become null."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.scalars import nan_to_null, to_date, to_number


class MissingColumnsError(ValueError):
    """A table lacks columns its contract requires."""

    def __init__(self, table: str, columns: Sequence[str]):
        self.table, self.columns = table, list(columns)
        super().__init__(f"{table} is missing required columns: {', '.join(columns)}")


@dataclass(frozen=True)
class Contract:
    """Declared columns of one table, in output order, as (name, Spark type) pairs."""

    name: str
    columns: Mapping[str, str]
    not_null: tuple[str, ...] = ()
    optional: frozenset[str] = field(default_factory=frozenset)

    @property
    def names(self) -> list[str]:
        return list(self.columns)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in self.columns.items()))


def require(df: DataFrame, columns: Iterable[str], table: str = "table") -> DataFrame:
    """Fail at plan time, before any job, when a column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumnsError(table, missing)
    return df


def coerce(column: Column, source_type: str, target_type: str) -> Column:
    """Cast where a bad value becomes null instead of an error, and NaN becomes null."""
    if target_type in ("double", "float"):
        if source_type == "double":
            return nan_to_null(column)
        return to_number(column, source_type).cast(target_type)
    if source_type == target_type:
        return column
    if target_type == "date":
        return to_date(column)
    if target_type == "string":
        return column.cast("string")
    if source_type in ("double", "float", "string"):
        return to_number(column, source_type).try_cast(target_type)
    return column.try_cast(target_type)


def enforce(df: DataFrame, contract: Contract, extras: bool = True) -> DataFrame:
    """Check presence, coerce types, drop rows whose key columns are null; extra columns pass through."""
    require(df, [c for c in contract.names if c not in contract.optional], contract.name)
    types = dict(df.dtypes)
    declared = [
        coerce(F.col(f"`{n}`"), types[n], t).alias(n) for n, t in contract.columns.items() if n in types
    ]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in contract.columns] if extras else []
    out = df.select(*declared, *rest)
    return out.dropna(subset=list(contract.not_null)) if contract.not_null else out


def typed_empty(spark: SparkSession, contract: Contract) -> DataFrame:
    return spark.createDataFrame([], contract.schema)


def align(df: DataFrame, contract: Contract) -> DataFrame:
    """Declared columns in declared order; columns the table lacks are null."""
    types = dict(df.dtypes)
    return df.select(
        *[
            (coerce(F.col(f"`{n}`"), types[n], t) if n in types else F.lit(None).cast(t)).alias(n)
            for n, t in contract.columns.items()
        ]
    )


def column_or_null(df: DataFrame, name: str, dtype: str = "double") -> Column:
    """The column, or a null column when the table does not have it."""
    return coerce(F.col(f"`{name}`"), dict(df.dtypes)[name], dtype) if name in df.columns else F.lit(None).cast(dtype)


def first_matching(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    """First candidate that is present, ignoring case."""
    present = {c.lower(): c for c in columns}
    return next((present[c.lower()] for c in candidates if c.lower() in present), None)


def resolve_aliases(
    df: DataFrame, aliases: Mapping[str, Sequence[str]], needed: Iterable[str] = ()
) -> DataFrame | None:
    """Rename the first alias found for each target. None when a needed target has no source column."""
    found = {target: first_matching(df.columns, options) for target, options in aliases.items()}
    if any(found.get(target) is None for target in needed):
        return None
    used = set(found.values())
    picked = [
        (F.col(f"`{source}`") if source else F.lit(None).cast("string")).alias(target)
        for target, source in found.items()
    ]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in used and c not in found]
    return df.select(*picked, *rest)


# --- contracts of the tables the plans exchange -------------------------------------------------

RAW_FACTS = Contract(
    "raw facts",
    {
        "ticker": "string", "cik": "string", "filing_date": "date", "period_end": "date",
        "fiscal_period": "string", "fiscal_year": "bigint", "form_type": "string",
        "concept_name": "string", "value": "double", "unit": "string", "source": "string",
    },
)

FUNDAMENTALS_META = Contract(
    "clean fundamentals",
    {
        "ticker": "string", "cik": "string", "filing_date": "date", "period_end": "date",
        "fiscal_period": "string", "fiscal_year": "bigint", "form_type": "string",
    },
)

BARS = Contract(
    "price bars",
    {"ticker": "string", "date": "date", "adj_close": "double", "volume": "double"},
    not_null=("ticker", "date", "adj_close"),
)

PRICE_TABLE = Contract(
    "price table",
    {
        "ticker": "string", "date": "date", "open": "double", "high": "double", "low": "double",
        "close": "double", "adj_close": "double", "volume": "double",
        "forward_return_5d": "double", "label": "int",
    },
)

LABELLED_BARS = Contract(
    "labelled bars",
    {"ticker": "string", "date": "date", "forward_return_5d": "double", "label": "int"},
    not_null=("ticker", "date"),
)

STATEMENT_FEATURES = Contract(
    "statement features",
    {"ticker": "string", "filing_date": "date", "period_end": "date"},
    not_null=("ticker", "filing_date"),
)

FILING_INDEX = Contract(
    "filing text index",
    {
        "ticker": "string", "cik": "string", "company_name": "string", "form_type": "string",
        "filing_date": "date", "period_end": "date", "accession_number": "string",
        "text_file_path": "string", "text_length": "bigint", "source": "string",
    },
)

FILING_SENTIMENT = Contract(
    "filing sentiment",
    {
        "ticker": "string", "cik": "string", "company_name": "string", "form_type": "string",
        "filing_date": "date", "period_end": "date", "accession_number": "string",
        "text_file_path": "string", "text_length": "bigint", "clean_text_length": "bigint",
        "chunk_count": "bigint", "positive_prob": "double", "negative_prob": "double",
        "neutral_prob": "double", "sentiment_score": "double", "dominant_sentiment": "string",
        "model_name": "string", "source": "string",
    },
)

SECTION_SENTIMENT = Contract(
    "section sentiment",
    {
        "ticker": "string", "cik": "string", "company_name": "string", "form_type": "string",
        "filing_date": "date", "period_end": "date", "accession_number": "string",
        "text_file_path": "string", "raw_text_length": "bigint", "mda_text_length": "bigint",
        "chunk_count": "bigint", "mda_found": "int", "extraction_status": "string",
        "extraction_method": "string", "positive_prob": "double", "negative_prob": "double",
        "neutral_prob": "double", "sentiment_score": "double", "dominant_sentiment": "string",
        "model_name": "string", "source": "string",
    },
)
