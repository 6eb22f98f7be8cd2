"""Bars, labels and trailing features."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import series
from ..functions.scalars import binary_label, safe_divide
from ..operators.reshape import columns_to_rows, wide_prices_to_long
from ..operators.segments import ROWS_PER_SEGMENT, over_series
from ..plans.features import MARKET_FEATURES, forward_labels, market_features
from ..contracts import BARS as BARS_CONTRACT, enforce
from . import common as base
from .registry import Tables, comparable, query


def _daily(t: Tables, compute) -> DataFrame:
    """Bars have one row per ticker and day, so plain windows are bounded by the calendar."""
    return over_series(base.bars(t), ["ticker"], ["date"], compute, rows_per_segment=None)


@query(f"WITH {base.BARS} SELECT ticker, {base.iso('date')}, adj_close, {base.r6('volume')} FROM bars")
def bars(t: Tables) -> DataFrame:
    return comparable(enforce(base.bars(t), BARS_CONTRACT), exact=("adj_close",))


LABELS = f"""{base.BARS},
ahead AS (SELECT *, lead(adj_close, 5) OVER (PARTITION BY ticker ORDER BY date) / adj_close - 1 AS forward_return_5d FROM bars),
labelled AS (SELECT *, CASE WHEN forward_return_5d IS NULL THEN NULL WHEN forward_return_5d > 0 THEN 1 ELSE 0 END AS label FROM ahead)"""


@query(
    f"""WITH {LABELS}
SELECT ticker, {base.iso('date')}, {base.r6('forward_return_5d')}, CAST(label AS BIGINT) AS label FROM labelled"""
)
def forward_label(t: Tables) -> DataFrame:
    done = forward_labels(base.bars(t))
    return comparable(done.select("ticker", "date", "forward_return_5d", "label"))


@query(
    f"""WITH {LABELS}
SELECT ticker, {base.iso('date')}, {base.r6('forward_return_5d')}, CAST(label AS BIGINT) AS label
FROM labelled WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"""
)
def forward_label_in_horizon(t: Tables) -> DataFrame:
    done = forward_labels(base.bars(t), horizon=("1996-01-01", "1999-12-31"))
    return comparable(done.select("ticker", "date", "forward_return_5d", "label"))


@query(
    f"""WITH {base.BARS}
SELECT ticker, {base.iso('date')}, {", ".join(
    f"round(adj_close / nullif(lag(adj_close, {k}) OVER w, 0) - 1, 6) AS return_{k}d" for k in (1, 5, 10, 21))}
FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)"""
)
def trailing_returns(t: Tables) -> DataFrame:
    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.select(
            "ticker", "date", *[series.pct_return("adj_close", k, w).alias(f"return_{k}d") for k in (1, 5, 10, 21)]
        )

    return comparable(_daily(t, compute))


def _std(value: str, rows: int, order: str = "date", key: str = "ticker") -> str:
    over = f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({value}) {over} = {rows} THEN stddev_samp({value}) {over} END"


def _mean(value: str, rows: int, order: str = "date", key: str = "ticker") -> str:
    over = f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({value}) {over} = {rows} THEN avg({value}) {over} END"


FEATURES = f"""{base.BARS},
moves AS (
  SELECT *, {", ".join(f"adj_close / nullif(lag(adj_close, {k}) OVER w, 0) - 1 AS return_{k}d" for k in (1, 5, 10, 21))},
         adj_close - lag(adj_close) OVER w AS move
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
sides AS (
  SELECT *, CASE WHEN move > 0 THEN move WHEN move IS NOT NULL THEN 0.0 END AS up,
         CASE WHEN move < 0 THEN -move WHEN move IS NOT NULL THEN 0.0 END AS down FROM moves),
rolled AS (
  SELECT *, {_std('return_1d', 5)} AS volatility_5d, {_std('return_1d', 21)} AS volatility_21d,
         {_mean('volume', 20)} AS volume_mean, {_std('volume', 20)} AS volume_std,
         {_mean('up', 14)} AS mean_up, {_mean('down', 14)} AS mean_down
  FROM sides),
market AS (
  SELECT ticker, date, return_1d, return_5d, return_10d, return_21d, volatility_5d, volatility_21d,
         volatility_5d / nullif(volatility_21d, 0) AS volatility_ratio_5d_21d,
         volume / nullif(volume_mean, 0) AS volume_ratio_20d,
         (volume - volume_mean) / nullif(volume_std, 0) AS volume_zscore_20d,
         100 - 100 / (1 + mean_up / nullif(mean_down, 0)) AS rsi_14
  FROM rolled)"""


@query(
    f"""WITH {FEATURES}
SELECT ticker, {base.iso('date')}, {base.r6('volatility_5d', 'volatility_21d', 'volatility_ratio_5d_21d')} FROM market"""
)
def rolling_volatility(t: Tables) -> DataFrame:
    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        returns = df.withColumn("r", series.pct_return("adj_close", 1, w))
        return returns.select(
            "ticker", "date",
            series.trailing_std("r", 5, w).alias("volatility_5d"),
            series.trailing_std("r", 21, w).alias("volatility_21d"),
        ).withColumn("volatility_ratio_5d_21d", safe_divide("volatility_5d", "volatility_21d"))

    return comparable(_daily(t, compute))


@query(f"WITH {FEATURES} SELECT ticker, {base.iso('date')}, {base.r6('volume_ratio_20d', 'volume_zscore_20d')} FROM market")
def volume_features(t: Tables) -> DataFrame:
    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.select(
            "ticker", "date",
            series.ratio_to_trailing_mean("volume", 20, w).alias("volume_ratio_20d"),
            series.trailing_zscore("volume", 20, w).alias("volume_zscore_20d"),
        )

    return comparable(_daily(t, compute))


@query(f"WITH {FEATURES} SELECT ticker, {base.iso('date')}, {base.r6('rsi_14')} FROM market")
def rsi_14(t: Tables) -> DataFrame:
    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("move", series.diff("adj_close", w)).select(
            "ticker", "date", series.rsi("move", 14, w).alias("rsi_14")
        )

    return comparable(_daily(t, compute))


@query(f"WITH {FEATURES} SELECT ticker, {base.iso('date')}, {base.r6(*MARKET_FEATURES)} FROM market")
def market_feature_table(t: Tables) -> DataFrame:
    return comparable(market_features(base.bars(t)))


_EVENT_SQL = f"""
WITH e AS (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS prior FROM events),
m AS (SELECT *, value - prior AS change FROM e)
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, round(change, 6) AS change,
       round({_mean('value', 20, 'ts', 'user_id')}, 6) AS mean_20,
       round({_std('change', 5, 'ts', 'user_id')}, 6) AS change_std_5,
       round(lead(value, 5) OVER (PARTITION BY user_id ORDER BY ts) / nullif(value, 0) - 1, 6) AS ahead_5
FROM m"""


def _event_series(t: Tables, rows_per_segment: int, hot_rows: int | None = None) -> DataFrame:
    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("change", series.diff("value", w)).select(
            "*",
            series.trailing_mean("value", 20, w).alias("mean_20"),
            series.trailing_std("change", 5, w).alias("change_std_5"),
            (safe_divide(series.shift("value", -5, w), "value") - 1.0).alias("ahead_5"),
        )

    events = t("events").select("user_id", "ts", "value")
    done = over_series(events, ["user_id"], ["ts"], compute, back=20, ahead=5, rows_per_segment=rows_per_segment, hot_rows=hot_rows)
    return comparable(done.select("user_id", "ts", "change", "mean_20", "change_std_5", "ahead_5"))


@query(_EVENT_SQL)
def event_series(t: Tables) -> DataFrame:
    """A user's events are not bounded by the calendar, so hot users are split along time."""
    return _event_series(t, ROWS_PER_SEGMENT)


@query(_EVENT_SQL)
def event_series_split(t: Tables) -> DataFrame:
    """The same with every user taken for hot, and the histories cut at some hundred places."""
    return _event_series(t, max(25, t("events").count() // 100), hot_rows=0)


@query(
    """
WITH priced AS (
  SELECT s_nationkey AS nation, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice / l_quantity) AS adj_close,
         max(l_extendedprice) AS high, sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT 'N' || CAST(nation AS VARCHAR) AS ticker, CAST(date AS VARCHAR) AS date,
       adj_close, round(high, 6) AS high, round(volume, 6) AS volume
FROM priced"""
)
def wide_prices(t: Tables) -> DataFrame:
    """Prices laid out with a column per field and ticker, turned back into one row per bar."""
    nations = range(25)
    fields = {"Adj Close": "adj_close", "High": "high", "Volume": "volume"}
    lines = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    values = {
        "Adj Close": lambda c: F.max(F.when(c, F.col("l_extendedprice") / F.col("l_quantity"))),
        "High": lambda c: F.max(F.when(c, F.col("l_extendedprice"))),
        "Volume": lambda c: F.sum(F.when(c, F.col("l_quantity"))),
    }
    wide = lines.groupBy(F.to_date("l_shipdate").alias("Date")).agg(
        *[make(F.col("s_nationkey") == n).alias(f"{f}|N{n}") for f, make in values.items() for n in nations]
    )
    return comparable(wide_prices_to_long(wide, fields), exact=("adj_close",))


@query(
    """
UNPIVOT (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME measure VALUE amount"""
)
def measures_long(t: Tables) -> DataFrame:
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    long = columns_to_rows(
        lines, ["l_orderkey", "l_partkey", "l_linenumber"],
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "measure", "amount",
    )
    return comparable(long)


@query(
    """
SELECT event_id, CASE WHEN d > 0 THEN 1 ELSE 0 END AS label, round(d, 6) AS change
FROM (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events) WHERE d IS NOT NULL"""
)
def binary_labels(t: Tables) -> DataFrame:
    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("change", series.diff("value", w))

    events = t("events").select("event_id", "user_id", "ts", "value")
    done = over_series(events, ["user_id"], ["ts"], compute, back=1)
    return comparable(done.select("event_id", binary_label("change").alias("label"), "change").dropna(subset=["change"]))
