"""Feature catalogue: statement ratios, market features, filing-text features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..contracts import BARS, FUNDAMENTALS_META, coerce, enforce, require
from ..functions import series
from ..functions.scalars import binary_label, indicator, safe_divide
from ..functions.series import average_balance
from ..operators.dedup import keep_first
from ..operators.segments import ROWS_PER_SEGMENT, SEG, over_series
from ..operators.trailing import trailing_frames
from ..sources.facts import CONCEPTS

# Output column names.
STATEMENT_FEATURES = (
    "current_ratio", "quick_ratio", "cash_ratio", "working_capital_to_total_assets",
    "debt_to_equity", "debt_to_assets", "long_term_debt_ratio",
    "gross_margin", "operating_margin", "net_margin", "roa", "roe",
    "asset_turnover", "inventory_turnover", "receivables_turnover",
    "revenue_growth_qoq", "revenue_growth_yoy", "earnings_growth_qoq", "earnings_growth_yoy",
    "cfo_to_net_income", "accruals_ratio",
)
MARKET_FEATURES = (
    "return_1d", "return_5d", "return_10d", "return_21d",
    "volatility_5d", "volatility_21d", "volatility_ratio_5d_21d",
    "volume_ratio_20d", "volume_zscore_20d", "rsi_14",
)
MARKET_CORE = (
    "return_1d", "return_5d", "return_10d", "return_21d",
    "volatility_5d", "volatility_21d", "volatility_ratio_5d_21d",
)
TEXT_METADATA = ("ticker", "cik", "company_name", "form_type", "filing_date", "period_end", "accession_number")


def statement_features(
    fundamentals: DataFrame,
    key: str = "ticker",
    period: str = "period_end",
    rows_per_segment: int | None = None,
) -> DataFrame:
    """The wide fundamentals plus 21 ratio and growth columns; concepts a table lacks read as null.

    The grain is one row per key and period end, so rows per key are bounded by the calendar and
    plain windows are used unless ``rows_per_segment`` says otherwise.
    """
    extra = [c for c in CONCEPTS + ("gross_profit",) if c not in fundamentals.columns]
    base = fundamentals.select(
        *[
            coerce(F.col(c), t, "double").alias(c) if c in CONCEPTS + ("gross_profit",) else F.col(c)
            for c, t in fundamentals.dtypes
        ],
        *[F.lit(None).cast("double").alias(c) for c in extra],
    )

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        grown = [
            (c, k, f"{name}_growth_{span}")
            for c, name in (("revenue", "revenue"), ("net_income", "earnings"))
            for k, span in ((1, "qoq"), (4, "yoy"))
        ]
        # window results become columns before they are used, so each is computed once
        lagged = df.select(
            "*",
            *[
                average_balance(c, w).alias(f"__avg_{c}")
                for c in ("total_assets", "shareholders_equity", "inventory", "accounts_receivable")
            ],
            *[series.shift(c, k, w).alias(f"__{c}_{k}") for c, k, _ in grown],
        )
        averages = lagged.select("*", *[series.growth_from(c, f"__{c}_{k}").alias(name) for c, k, name in grown])
        c = F.col
        ratios = {
            "current_ratio": (c("current_assets"), c("current_liabilities")),
            "quick_ratio": (c("current_assets") - c("inventory"), c("current_liabilities")),
            "cash_ratio": (c("cash_and_cash_equivalents"), c("current_liabilities")),
            "working_capital_to_total_assets": (c("current_assets") - c("current_liabilities"), c("total_assets")),
            "debt_to_equity": (c("total_liabilities"), c("shareholders_equity")),
            "debt_to_assets": (c("total_liabilities"), c("total_assets")),
            "long_term_debt_ratio": (c("long_term_debt"), c("total_assets")),
            "gross_margin": (c("gross_profit"), c("revenue")),
            "operating_margin": (c("operating_income"), c("revenue")),
            "net_margin": (c("net_income"), c("revenue")),
            "roa": (c("net_income"), c("__avg_total_assets")),
            "roe": (c("net_income"), c("__avg_shareholders_equity")),
            "asset_turnover": (c("revenue"), c("__avg_total_assets")),
            "inventory_turnover": (c("revenue"), c("__avg_inventory")),
            "receivables_turnover": (c("revenue"), c("__avg_accounts_receivable")),
            "cfo_to_net_income": (c("operating_cash_flow"), c("net_income")),
            "accruals_ratio": (c("net_income") - c("operating_cash_flow"), c("__avg_total_assets")),
        }
        return averages.select("*", *[safe_divide(n, d).alias(name) for name, (n, d) in ratios.items()])

    done = over_series(base, [key], [period], compute, back=4, rows_per_segment=rows_per_segment)
    return done.select(*fundamentals.columns, *STATEMENT_FEATURES)


def forward_labels(
    bars: DataFrame,
    days: int = 5,
    key: str = "ticker",
    date: str = "date",
    price: str = "adj_close",
    horizon: tuple[str, str] | None = None,
    rows_per_segment: int | None = None,
) -> DataFrame:
    """Forward return over ``days`` rows and its 0/1 label; trimmed to ``horizon`` only afterwards."""
    name = f"forward_return_{days}d"

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn(name, series.forward_return(price, days, w))

    done = over_series(bars, [key], [date], compute, ahead=days, rows_per_segment=rows_per_segment)
    labelled = done.withColumn("label", binary_label(name))
    if horizon is None:
        return labelled
    start, end = (F.to_date(F.lit(x)) for x in horizon)
    return labelled.where(F.col(date).between(start, end))


def market_features(
    bars: DataFrame,
    key: str = "ticker",
    date: str = "date",
    price: str = "adj_close",
    volume: str = "volume",
    keep: Sequence[str] | None = None,
    rows_per_segment: int | None = None,
) -> DataFrame:
    """Ten trailing features per bar. All frames share one partitioning and order: one sort per key.

    Row offsets are window functions, trailing frames array operations per series. Daily bars have at most one row per key and calendar day, so plain windows suffice; pass
    ``rows_per_segment`` for intraday bars.
    """
    kept = list(keep) if keep is not None else [key, date]

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        # window results become columns before they are used, so each is computed once
        lagged = df.select("*", *[series.shift(price, k, w).alias(f"__lag{k}") for k in (1, 5, 10, 21)])
        returns = lagged.select(
            "*",
            *[(safe_divide(price, f"__lag{k}") - 1.0).alias(f"return_{k}d") for k in (1, 5, 10, 21)],
            (F.col(price) - F.col("__lag1")).alias("__move"),
        )
        # only what is needed further on goes through the batches
        sides = returns.select(
            *[c for c in df.columns if c in (*kept, key, date) or c.startswith("__")], *[f"return_{k}d" for k in (1, 5, 10, 21)],
            series.gain("__move").alias("__up"), series.loss("__move").alias("__down"), F.col(volume).cast("double").alias("__volume"),
        )
        parts = [key, *([SEG] if SEG in df.columns else [])]
        rolled = trailing_frames(sides, parts, [date], {
            "volatility_5d": ("deviation", "return_1d", 5),
            "volatility_21d": ("deviation", "return_1d", 21),
            "__volume_mean": ("mean", "__volume", 20),
            "__volume_std": ("deviation", "__volume", 20),
            "__mean_up": ("mean", "__up", 14),
            "__mean_down": ("mean", "__down", 14),
        })
        return rolled.select(
            "*",
            safe_divide("volatility_5d", "volatility_21d").alias("volatility_ratio_5d_21d"),
            safe_divide("__volume", "__volume_mean").alias("volume_ratio_20d"),
            safe_divide(F.col("__volume") - F.col("__volume_mean"), "__volume_std").alias("volume_zscore_20d"),
            series.rsi_from("__mean_up", "__mean_down").alias("rsi_14"),
        )

    base = bars.select(*dict.fromkeys([*kept, key, date, price, volume]))
    done = over_series(base, [key], [date], compute, back=21, rows_per_segment=rows_per_segment)
    return done.select(*kept, *MARKET_FEATURES)


def text_feature_names(prefix: str) -> list[str]:
    """The feature columns of one variant: ``sec_`` over whole filings, ``mda_`` over sections."""
    names = ["sentiment_score", "positive_prob", "negative_prob", "neutral_prob", "sentiment_abs",
             "sentiment_change_prev", "positive_change_prev", "negative_change_prev",
             "chunk_count", "log_chunk_count"]
    if prefix == "mda_":
        names += ["text_length", "log_text_length"]
    return [prefix + n for n in [*names, "is_10k", "is_10q"]]


def text_features(
    sentiment: DataFrame,
    prefix: str = "sec_",
    text_length: str | None = None,
    key: str = "ticker",
    tie: Sequence[str] = ("form_type", "accession_number"),
    rows_per_segment: int | None = ROWS_PER_SEGMENT,
) -> DataFrame:
    """Filing-level text features; with ``text_length`` the section variant, over scored rows only.

    Changes are against the previous filing of the key, in order of date, form and accession.
    """
    needed = ["form_type", "filing_date", "accession_number", key]
    base = sentiment.dropna(subset=[key, "filing_date", "accession_number"])
    base = keep_first(base, [key, "accession_number"], ["filing_date", "form_type"])
    metadata = [c for c in TEXT_METADATA if c in base.columns]
    if text_length:
        base = base.where(F.col("mda_found") == 1)
        metadata = [*metadata, "extraction_status"]
    require(base, needed, "filing sentiment")

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.select(
            "*",
            series.diff("sentiment_score", w).alias(f"{prefix}sentiment_change_prev"),
            series.diff("positive_prob", w).alias(f"{prefix}positive_change_prev"),
            series.diff("negative_prob", w).alias(f"{prefix}negative_change_prev"),
        )

    done = over_series(base, [key], ["filing_date", *tie], compute, back=1, rows_per_segment=rows_per_segment)
    c = F.col
    made = {
        "sentiment_score": c("sentiment_score"),
        "positive_prob": c("positive_prob"),
        "negative_prob": c("negative_prob"),
        "neutral_prob": c("neutral_prob"),
        "sentiment_abs": F.abs("sentiment_score"),
        "chunk_count": c("chunk_count"),
        "log_chunk_count": F.log1p("chunk_count"),
        "is_10k": indicator(c("form_type") == "10-K"),
        "is_10q": indicator(c("form_type") == "10-Q"),
    }
    if text_length:
        made |= {"text_length": c(text_length), "log_text_length": F.log1p(text_length)}
    named = {prefix + n: v for n, v in made.items()}
    return done.select(
        *metadata, *[named.get(n, c(n)).alias(n) for n in text_feature_names(prefix)]
    )


def normalized_bars(bars: DataFrame) -> DataFrame:
    return enforce(bars, BARS)


def normalized_fundamentals(fundamentals: DataFrame) -> DataFrame:
    return enforce(fundamentals, FUNDAMENTALS_META)


def sentiment_momentum(
    panel: DataFrame, score: str = "sec_sentiment_score", days: int = 5, key: str = "ticker", date: str = "date", rows_per_segment: int | None = None
) -> DataFrame:
    """Adds ``sentiment_change_{days}d`` and ``sentiment_momentum_{days}d`` to a panel that carries the newest score of each day.

    The change is the score known on the day less the one known ``days`` rows earlier; the momentum is the same
    of the trailing mean over ``days`` rows. Both probes ride on the order of the as-of join, without another join. Null while
    there is no score, or the mean has no full frame.
    """
    change, momentum, mean = f"sentiment_change_{days}d", f"sentiment_momentum_{days}d", "__mean"

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        rolled = df.withColumns({change: F.col(score) - series.shift(score, days, w), mean: series.trailing_mean(score, days, w)})
        return rolled.withColumn(momentum, F.col(mean) - series.shift(mean, days, w)).drop(mean)

    return over_series(panel, [key], [date], compute, back=2 * days - 1, rows_per_segment=rows_per_segment)
