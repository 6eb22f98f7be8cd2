"""Modelling steps, metrics and model comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, modeling
from ..operators.quantiles import exact_quantiles
from ..plans.comparison import Comparison, Setup, compare, summarize
from ..plans.features import MARKET_CORE, MARKET_FEATURES, STATEMENT_FEATURES, market_features, text_feature_names, text_features
from ..plans.panels import bars_to_panel, text_panel, usable_rows
from ..session import cut_lineage
from . import common as base
from .market import FEATURES
from .panels import PANEL, _statements
from .registry import Tables, comparable, query
from .texts import filing_scores, section_scores, text_bars

# The calendar of the market table and its part before the split date.
TRAIN = f"""{FEATURES},
days AS (SELECT list(DISTINCT date ORDER BY date) AS d FROM market),
edge AS (SELECT len(d) AS date_count, d[greatest(least(CAST(floor(len(d) * 0.8) AS BIGINT), len(d) - 1), 1) + 1] AS split_date FROM days),
train AS (SELECT * FROM market WHERE date < (SELECT split_date FROM edge)),
test AS (SELECT * FROM market WHERE date >= (SELECT split_date FROM edge))"""


def _market(t: Tables) -> DataFrame:
    """Market features, written once: the modelling steps read them several times."""
    return cut_lineage(market_features(base.bars(t)))


def _train(market: DataFrame) -> DataFrame:
    return modeling.time_split(market, modeling.split_date(market))[0]


@query(
    f"""WITH {TRAIN}
SELECT date_count, CAST(split_date AS VARCHAR) AS split_date, (SELECT count(*) FROM train) AS train_rows,
       (SELECT count(*) FROM test) AS test_rows
FROM edge"""
)
def time_split(t: Tables) -> DataFrame:
    market = base.bars(t)
    found = modeling.split_report(market).first()
    day, edge = F.col("date"), F.lit(found["split_date"])
    return comparable(
        market.agg(
            F.lit(found["date_count"]).alias("date_count"),
            F.lit(found["split_date"]).alias("split_date"),
            F.count_if(day < edge).alias("train_rows"),
            F.count_if(day >= edge).alias("test_rows"),
        )
    )


@query(
    f"""WITH {TRAIN}, shares AS (
{" UNION ALL ".join(f"SELECT '{c}' AS column_name, 100.0 * (count(*) - count({c})) / count(*) AS missing_pct FROM train" for c in MARKET_FEATURES)})
SELECT column_name, round(missing_pct, 6) AS missing_pct, CAST(missing_pct <= 2.0 AS BIGINT) AS usable FROM shares"""
)
def usable_columns(t: Tables) -> DataFrame:
    """Sparsity filter on the training rows, at 2 percent here so that it bites."""
    usable, shares = modeling.usable_features(_train(_market(t)), MARKET_FEATURES, max_missing_pct=2.0)
    rows = [(c, float(p), c in usable) for c, p in shares.items()]
    return comparable(t.spark.createDataFrame(rows, "column_name string, missing_pct double, usable boolean"))


def _bounds_sql(c: str) -> str:
    return f"SELECT '{c}' AS column_name, quantile_cont({c}, 0.01) AS lower_bound, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.99) AS upper_bound FROM train"


_BOUNDS = f"{TRAIN}, bounds AS ({' UNION ALL '.join(_bounds_sql(c) for c in MARKET_FEATURES)})"


@query(f"WITH {_BOUNDS} SELECT column_name, {base.r6('lower_bound', 'median', 'upper_bound')} FROM bounds")
def quantile_bounds(t: Tables) -> DataFrame:
    """Exact 1, 50 and 99 percent quantiles of every feature on the training rows."""
    found = exact_quantiles(_train(_market(t)), MARKET_FEATURES, [0.01, 0.5, 0.99])
    rows = [(c, *map(float, q)) for c, q in found.items()]
    return comparable(
        t.spark.createDataFrame(rows, "column_name string, lower_bound double, median double, upper_bound double")
    )


@query(f"WITH {_BOUNDS} SELECT column_name, {base.r6('lower_bound', 'median', 'upper_bound')} FROM bounds")
def quantile_bounds_narrowing(t: Tables) -> DataFrame:
    """The same through a second narrowing round, forced by a low limit on gathered rows."""
    found = exact_quantiles(_train(_market(t)), MARKET_FEATURES, [0.01, 0.5, 0.99], gather_rows=10)
    rows = [(c, *map(float, q)) for c, q in found.items()]
    return comparable(
        t.spark.createDataFrame(rows, "column_name string, lower_bound double, median double, upper_bound double")
    )


def _clamped(c: str) -> str:
    lo, hi = (f"(SELECT {b} FROM bounds WHERE column_name = '{c}')" for b in ("lower_bound", "upper_bound"))
    return f"CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END"


@query(
    f"""WITH {_BOUNDS}
SELECT ticker, CAST(date AS VARCHAR) AS date, {", ".join(f"round({_clamped(c)}, 6) AS {c}" for c in MARKET_FEATURES)} FROM market"""
)
def winsorized_features(t: Tables) -> DataFrame:
    """Training quantiles applied to all rows; nulls stay null."""
    market = _market(t)
    fitted = modeling.fit_columns(_train(market), MARKET_FEATURES)
    return comparable(modeling.winsorize(market, fitted.bounds))


def _filled(c: str) -> str:
    return f"coalesce({_clamped(c)}, (SELECT median FROM bounds WHERE column_name = '{c}'))"


@query(
    f"""WITH {_BOUNDS},
filled AS (SELECT ticker, date, {", ".join(f"{_filled(c)} AS {c}" for c in MARKET_CORE)} FROM market),
scales AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in MARKET_CORE)}
  FROM filled WHERE date < (SELECT split_date FROM edge))
SELECT ticker, CAST(date AS VARCHAR) AS date, {", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in MARKET_CORE)}
FROM filled CROSS JOIN scales"""
)
def standardized_features(t: Tables) -> DataFrame:
    """Winsorised, median-filled and standardised by the training rows."""
    market = _market(t).select("ticker", "date", *MARKET_CORE)
    edge = modeling.split_date(market)
    fitted = modeling.fit_columns(modeling.time_split(market, edge)[0], MARKET_CORE)
    filled = modeling.impute(modeling.winsorize(market, fitted.bounds), fitted.medians)
    scales = modeling.scaling(modeling.time_split(filled, edge)[0], MARKET_CORE)
    return comparable(modeling.standardize(filled, scales))


@query(
    """
SELECT CAST(quality AS BIGINT) AS label, round((SELECT count(*) FROM labels) / (2.0 * count(*)), 6) AS weight FROM labels GROUP BY quality"""
)
def class_weights(t: Tables) -> DataFrame:
    weights = modeling.class_weights(t("labels"), "quality")
    rows = t("labels").select(F.col("quality").alias("label")).distinct()
    return comparable(rows.select("label", modeling.weight_column(weights).alias("weight")))


# A score per labelled document: the share of long words guesses quality, the share of digits does not.
_PREDICTIONS = """scored AS (
  SELECT doc_id, source, quality AS label, least(n_chars / 5000.0, 1.0) AS length_score,
         (CAST(substr(source, 4) AS INTEGER) + 1) / 21.0 AS source_score
  FROM documents JOIN labels USING (doc_id)),
predictions AS (
  SELECT doc_id, label, 'by_length' AS model_name, length_score AS predicted_probability, CAST(length_score > 0.2 AS INTEGER) AS predicted_label FROM scored
  UNION ALL
  SELECT doc_id, label, 'by_source', source_score, CAST(source_score > 0.5 AS INTEGER) FROM scored)"""


def _predictions(t: Tables) -> DataFrame:
    """Two simple scores of the labelled documents as predictions; one of them has many ties."""
    rows = t("documents").join(t("labels"), "doc_id").select(
        "doc_id", F.col("quality").alias("label"),
        F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0)).alias("by_length"),
        ((F.substring("source", 4, 10).cast("int") + 1) / F.lit(21.0)).alias("by_source"),
    )
    long = rows.unpivot(["doc_id", "label"], ["by_length", "by_source"], "model_name", "predicted_probability")
    bar = F.when(F.col("model_name") == "by_length", 0.2).otherwise(0.5)
    return long.withColumn("predicted_label", (F.col("predicted_probability") > bar).cast("int"))


_CONFUSION = f"""{_PREDICTIONS},
counts AS (
  SELECT model_name, count(*) FILTER (label = 0 AND predicted_label = 0) AS tn, count(*) FILTER (label = 0 AND predicted_label = 1) AS fp,
         count(*) FILTER (label = 1 AND predicted_label = 0) AS fn, count(*) FILTER (label = 1 AND predicted_label = 1) AS tp,
         avg(-ln(CASE WHEN label = 1 THEN least(greatest(predicted_probability, 2.220446049250313e-16), 1 - 2.220446049250313e-16)
                      ELSE 1 - least(greatest(predicted_probability, 2.220446049250313e-16), 1 - 2.220446049250313e-16) END)) AS log_loss
  FROM predictions GROUP BY 1)"""


@query(
    f"""WITH {_CONFUSION}
SELECT model_name, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
       round(log_loss, 6) AS log_loss, tn, fp, fn, tp
FROM counts"""
)
def confusion_metrics(t: Tables) -> DataFrame:
    return comparable(metrics.confusion(_predictions(t), ["model_name"]))


_AUC = f"""{_PREDICTIONS},
ranked AS (
  SELECT *, rank() OVER (PARTITION BY model_name ORDER BY predicted_probability)
            + (count(*) OVER (PARTITION BY model_name, predicted_probability) - 1) / 2.0 AS r FROM predictions),
auc AS (
  SELECT model_name, (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0)
                     / (sum(label) * (count(*) - sum(label))) AS auc_roc
  FROM ranked GROUP BY 1)"""


@query(f"WITH {_AUC} SELECT model_name, round(auc_roc, 6) AS auc_roc FROM auc")
def ranking_auc(t: Tables) -> DataFrame:
    return comparable(metrics.auc(_predictions(t), ["model_name"]))


@query(f"WITH {_AUC} SELECT model_name, round(auc_roc, 6) AS auc_roc FROM auc")
def ranking_auc_buckets(t: Tables) -> DataFrame:
    """The same through some fifty ranges of the score."""
    predictions = _predictions(t)
    return comparable(metrics.auc(predictions, ["model_name"], rows_per_bucket=max(40, predictions.count() // 50)))


@query(f"WITH {_AUC} SELECT 'scores' AS feature_setup, max_by(model_name, auc_roc) AS best_model, round(max(auc_roc), 6) AS best_auc_roc FROM auc")
def best_by_auc(t: Tables) -> DataFrame:
    table = metrics.auc(_predictions(t), ["model_name"]).withColumn("feature_setup", F.lit("scores"))
    return comparable(metrics.best_model(table, ["feature_setup"], ["by_length", "by_source"]))


@query(
    f"""WITH {_AUC}
SELECT doc_id, CAST(label AS BIGINT) AS label, model_name, CAST(predicted_label AS BIGINT) AS predicted_label, round(predicted_probability, 6) AS predicted_probability
FROM predictions WHERE model_name = (SELECT max_by(model_name, auc_roc) FROM auc)"""
)
def best_model_predictions(t: Tables) -> DataFrame:
    """Predictions of the better model, each row with its own keys."""
    predictions = _predictions(t)
    table = metrics.auc(predictions, ["model_name"]).withColumn("feature_setup", F.lit("scores"))
    best = metrics.best_model(table, ["feature_setup"], ["by_length", "by_source"])
    return comparable(predictions.join(best.select(F.col("best_model").alias("model_name")), "model_name"))


# Models have the sizes of the study, are fitted on all training rows and score all test rows.
# Fixed values in the next two functions: the names of the feature setups.
def _market_setups(t: Tables) -> dict[str, Setup]:
    kept = ["ticker", "date", "forward_return_5d", "label", "filing_date", *STATEMENT_FEATURES]
    panel = usable_rows(bars_to_panel(base.bars(t), _statements(t), keep=kept))
    return {
        "layer1_only": Setup(panel, STATEMENT_FEATURES),
        "layer1_plus_layer2_core": Setup(panel, STATEMENT_FEATURES + MARKET_CORE),
        "layer1_plus_layer2_full": Setup(panel, STATEMENT_FEATURES + MARKET_FEATURES),
    }


def _text_setups(t: Tables) -> dict[str, Setup]:
    market = market_features(text_bars(t), keep=["ticker", "date", "forward_return_5d", "label"])
    bars = cut_lineage(market.dropna(subset=["label"]))
    full = cut_lineage(text_features(filing_scores(t), "sec_"))
    part = cut_lineage(text_features(section_scores(t), "mda_", text_length="mda_text_length"))
    return {
        "layer1_only": Setup(bars, MARKET_FEATURES),
        "layer1_plus_layer3_full": Setup(text_panel(bars, full, "sec_"), MARKET_FEATURES + tuple(text_feature_names("sec_"))),
        "layer1_plus_layer3_mda": Setup(text_panel(bars, part, "mda_"), MARKET_FEATURES + tuple(text_feature_names("mda_"))),
    }


def _one_model(t: Tables, name: str) -> Comparison:
    setups = _market_setups(t)
    return compare({"layer1_plus_layer2_full": setups["layer1_plus_layer2_full"]}, models=[name])


@query()
def model_logistic_regression(t: Tables) -> DataFrame:
    return comparable(_one_model(t, "logistic_regression").predictions)


@query()
def model_random_forest(t: Tables) -> DataFrame:
    return comparable(_one_model(t, "random_forest").predictions)


@query()
def model_gradient_boosting(t: Tables) -> DataFrame:
    return comparable(_one_model(t, "gradient_boosting").predictions)


@query()
def compare_market_layers(t: Tables) -> DataFrame:
    """Metrics of the three models over three feature sets that share a panel and a split."""
    return comparable(compare(_market_setups(t)).metrics)


@query()
def compare_text_layers(t: Tables) -> DataFrame:
    """Best-model predictions over three panels that share the first one's split date."""
    return comparable(compare(_text_setups(t)).best_predictions())


_SUMMARY = f"""WITH {PANEL},
usable AS (SELECT * FROM panel WHERE filing_date IS NOT NULL AND label IS NOT NULL),
days AS (SELECT list(DISTINCT date ORDER BY date) AS d FROM usable),
edge AS (SELECT d[greatest(least(CAST(floor(len(d) * 0.8) AS BIGINT), len(d) - 1), 1) + 1] AS split_date FROM days),
parts AS (SELECT *, CASE WHEN date < (SELECT split_date FROM edge) THEN 'train' ELSE 'test' END AS part FROM usable),
columns AS (SELECT {" + ".join(f"CAST(count({c}) > 0 AND 100.0 * (count(*) - count({c})) / count(*) <= 20.0 AS BIGINT)" for c in STATEMENT_FEATURES)} AS n
            FROM parts WHERE part = 'train')
SELECT 'layer1_only' AS feature_setup, part, CAST((SELECT split_date FROM edge) AS VARCHAR) AS split_date, count(*) AS row_count,
       round(100.0 * count(*) FILTER (WHERE label = 0) / count(*), 6) AS class_0_pct,
       round(100.0 * count(*) FILTER (WHERE label = 1) / count(*), 6) AS class_1_pct,
       CAST((SELECT n FROM columns) AS BIGINT) AS usable_features, CAST({len(STATEMENT_FEATURES)} - (SELECT n FROM columns) AS BIGINT) AS dropped_features
FROM parts GROUP BY part"""


@query(_SUMMARY)
def training_summary(t: Tables) -> DataFrame:
    setups = _market_setups(t)
    return comparable(summarize({"layer1_only": setups["layer1_only"]}))
