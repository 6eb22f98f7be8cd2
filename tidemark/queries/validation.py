"""Folds over time, preparation per fold, and models that are fitted and judged per fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import foldmodels, importance, modeling, penalized, validation
from ..plans.features import MARKET_CORE, forward_labels, market_features
from ..session import cut_lineage
from . import common as base
from .market import FEATURES, LABELS
from .modeling import TRAIN, _market
from .registry import Tables, comparable, query

GAP, SPLITS, MONTHS = 5, 5, 6


def _rows(t: Tables) -> DataFrame:
    """Labelled bars with market features and the date that each label looks at, written once."""
    labelled = validation.label_ends(forward_labels(base.bars(t)))
    wide = market_features(labelled, keep=["ticker", "date", "forward_return_5d", "label", "label_end"])
    return cut_lineage(wide.dropna(subset=["label"]))


_ROWS = f"""{LABELS}, {FEATURES[FEATURES.index('moves AS'):]},
ends AS (SELECT ticker, date, label, forward_return_5d, lead(date, 5) OVER (PARTITION BY ticker ORDER BY date) AS label_end FROM labelled),
rows AS (SELECT e.label, e.forward_return_5d, e.label_end, m.* FROM ends e JOIN market m ON e.ticker = m.ticker AND e.date = m.date WHERE e.label IS NOT NULL),
days AS (SELECT list(DISTINCT date ORDER BY date) AS d FROM rows)"""

# walk forward: 500 dates first, then spans of 250 dates, five dates between training and test
_WALK = f"""{_ROWS},
folds AS (
  SELECT k + 1 AS fold, d[1] AS train_from, d[500 + 250 * k - 5 + 1] AS train_until, d[500 + 250 * k + 1] AS test_from, d[500 + 250 * (k + 1) + 1] AS test_until
  FROM days, (SELECT unnest(range(0, 40)) AS k) WHERE 500 + 250 * k < len(d)),
assigned AS (
  SELECT r.*, f.fold, CASE WHEN r.date >= train_from AND r.date < train_until THEN CASE WHEN label_end < test_from THEN 'train' ELSE 'purged' END ELSE 'test' END AS part
  FROM rows r JOIN folds f ON (r.date >= train_from AND r.date < train_until) OR (r.date >= test_from AND (test_until IS NULL OR r.date < test_until)))"""


def _walk(rows: DataFrame) -> list[validation.Fold]:
    return validation.walk_forward(validation.calendar(rows), 500, 250, gap=GAP)


@query(f"WITH {_WALK} SELECT ticker, CAST(date AS VARCHAR) AS date, CAST(fold AS BIGINT) AS fold, part FROM assigned")
def walk_forward_folds(t: Tables) -> DataFrame:
    """Every labelled bar in all folds that it trains or tests; labels that reach a test range are purged."""
    rows = _rows(t)
    return comparable(validation.assign_folds(rows, _walk(rows), label_end="label_end").select("ticker", "date", "fold", "part"))


_BINNED = f"""{_WALK},
chances AS (SELECT fold, coalesce(return_5d > 0, FALSE) AS up, avg(label) AS p FROM assigned WHERE part = 'train' GROUP BY ALL),
predictions AS (
  SELECT a.fold, a.label, c.p AS p, CAST(c.p > 0.5 AS INTEGER) AS predicted
  FROM assigned a JOIN chances c ON a.fold = c.fold AND coalesce(a.return_5d > 0, FALSE) = c.up WHERE part = 'test'),
counts AS (
  SELECT fold, count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
         count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 1 AND predicted = 1) AS tp,
         avg(-ln(CASE WHEN label = 1 THEN least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)
                      ELSE 1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) END)) AS log_loss
  FROM predictions GROUP BY fold),
ranked AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS r FROM predictions),
auc AS (
  SELECT fold, (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auc_roc
  FROM ranked GROUP BY fold),
measured AS (
  SELECT fold, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, log_loss, tn, fp, fn, tp, auc_roc
  FROM counts JOIN auc USING (fold))"""


def _binned_predictions(t: Tables) -> DataFrame:
    """Test rows of each fold with the chance that the fold's training rows show for a past rise or fall."""
    rows = _rows(t)
    assigned = validation.assign_folds(rows, _walk(rows), label_end="label_end").withColumn("up", F.coalesce(F.col("return_5d") > 0, F.lit(False)))
    # two rows per fold
    chances = assigned.where("part = 'train'").groupBy("fold", "up").agg(F.avg("label").alias("predicted_probability"))
    tested = assigned.where("part = 'test'").join(F.broadcast(chances), ["fold", "up"])
    return tested.select("fold", "label", "predicted_probability", (F.col("predicted_probability") > 0.5).cast("int").alias("predicted_label"))


@query(f"WITH {_BINNED} SELECT CAST(fold AS BIGINT) AS fold, {base.r6('accuracy', 'precision', 'recall', 'f1', 'log_loss')}, tn, fp, fn, tp, {base.r6('auc_roc')} FROM measured")
def walk_forward_metrics(t: Tables) -> DataFrame:
    """Metrics per fold of a rule that every fold learns on its own training rows; one pass for all folds."""
    return comparable(validation.fold_metrics(_binned_predictions(t)))


_METRICS = ("accuracy", "precision", "recall", "f1", "log_loss", "tn", "fp", "fn", "tp", "auc_roc")


@query(
    f"""WITH {_BINNED}
{" UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS deviation, count({m}) AS folds FROM measured" for m in _METRICS)}"""
)
def walk_forward_summary(t: Tables) -> DataFrame:
    """Mean and deviation of the metrics over the folds."""
    return comparable(validation.overall_metrics(validation.fold_metrics(_binned_predictions(t))))


_EXPANDING = f"""{_ROWS},
known AS (SELECT list_filter(d, lambda x: x <= d[len(d)] - INTERVAL {MONTHS} MONTH) AS k, list_filter(d, lambda x: x > d[len(d)] - INTERVAL {MONTHS} MONTH)[1] AS holdout FROM days),
sized AS (SELECT k, holdout, len(k) // {SPLITS + 1} AS size, len(k) - {SPLITS} * (len(k) // {SPLITS + 1}) AS first FROM known),
folds AS (
  SELECT i + 1 AS fold, k[1] AS train_from, k[first + i * size - {GAP} + 1] AS train_until, k[first + i * size + 1] AS test_from,
         coalesce(k[first + (i + 1) * size + 1], holdout) AS test_until
  FROM sized, (SELECT unnest(range(0, {SPLITS})) AS i)
  UNION ALL SELECT {SPLITS + 1}, k[1], k[len(k) - {GAP} + 1], holdout, NULL FROM sized),
assigned AS (
  SELECT r.*, f.fold, CASE WHEN r.date >= train_from AND r.date < train_until THEN CASE WHEN label_end < test_from THEN 'train' ELSE 'purged' END ELSE 'test' END AS part
  FROM rows r JOIN folds f ON (r.date >= train_from AND r.date < train_until) OR (r.date >= test_from AND (test_until IS NULL OR r.date < test_until)))"""


def _expanding(rows: DataFrame) -> list[validation.Fold]:
    folds, holdout = validation.folds_and_holdout(validation.calendar(rows), SPLITS, GAP, MONTHS)
    return [*folds, holdout]


@query(
    f"""WITH {_EXPANDING}
SELECT CAST(fold AS BIGINT) AS fold, count(*) FILTER (part = 'train') AS train_rows, count(*) FILTER (part = 'purged') AS purged_rows, count(*) FILTER (part = 'test') AS test_rows,
       CAST(min(date) FILTER (part = 'train') AS VARCHAR) AS first_train, CAST(max(date) FILTER (part = 'train') AS VARCHAR) AS last_train,
       CAST(min(date) FILTER (part = 'test') AS VARCHAR) AS first_test, CAST(max(date) FILTER (part = 'test') AS VARCHAR) AS last_test
FROM assigned GROUP BY fold"""
)
def expanding_folds(t: Tables) -> DataFrame:
    """Five expanding folds with a gap of five dates, and the last six months as the final holdout."""
    rows = _rows(t)
    return comparable(validation.fold_report(validation.assign_folds(rows, _expanding(rows), label_end="label_end")))


@query(
    f"""WITH {TRAIN}, gap AS (SELECT list_filter(d, lambda x: x < split_date) AS b, split_date FROM days, edge),
cut AS (SELECT b[len(b) - {GAP} + 1] AS embargo, split_date FROM gap)
SELECT CAST(embargo AS VARCHAR) AS embargo_date, CAST(split_date AS VARCHAR) AS split_date, (SELECT count(*) FROM market WHERE date < embargo) AS train_rows,
       (SELECT count(*) FROM market WHERE date >= embargo AND date < split_date) AS left_out, (SELECT count(*) FROM market WHERE date >= split_date) AS test_rows
FROM cut"""
)
def gapped_split(t: Tables) -> DataFrame:
    """The shared split with the last five training dates left out."""
    market = base.bars(t)
    split = modeling.split_date(market)
    embargo = validation.embargo_start(validation.calendar(market), split, GAP)
    train, test = validation.gapped_split(market, split, GAP)
    between = market.where((F.col("date") >= F.lit(embargo)) & (F.col("date") < F.lit(split)))
    parts = {"train_rows": train, "left_out": between, "test_rows": test}
    sides = None
    for name, part in parts.items():
        side = part.select(F.lit(name).alias("side"))
        sides = side if sides is None else sides.unionAll(side)
    counts = [F.count_if(F.col("side") == name).alias(name) for name in parts]
    return comparable(sides.agg(*counts).select(F.lit(embargo).alias("embargo_date"), F.lit(split).alias("split_date"), *parts))


_PROBS = {"low": 0.01, "median": 0.5, "high": 0.99}


def _fold_quantiles_sql() -> str:
    one = " UNION ALL ".join(
        f"SELECT fold, '{c}' AS column_name, {', '.join(f'quantile_cont({c}, {p}) AS {name}' for name, p in _PROBS.items())} FROM assigned WHERE part = 'train' GROUP BY fold" for c in MARKET_CORE
    )
    return f"WITH {_EXPANDING}, found AS ({one}) SELECT CAST(fold AS BIGINT) AS fold, column_name, {base.r6(*_PROBS)} FROM found"


def _fold_quantiles(t: Tables, **how) -> DataFrame:
    rows = _rows(t)
    folds = _expanding(rows)
    member = foldmodels.with_folds(rows, folds, label_end="label_end")
    groups = {f.number: F.array_contains(foldmodels.TRAINS, f.number) for f in folds}
    found = foldmodels.grouped_quantiles(member, groups, MARKET_CORE, list(_PROBS.values()), **how)
    table = [(n, c, *map(float, q)) for n, per_column in found.items() for c, q in per_column.items()]
    return comparable(t.spark.createDataFrame(table, f"fold int, column_name string, {', '.join(f'{p} double' for p in _PROBS)}"))


@query(_fold_quantiles_sql())
def fold_quantiles(t: Tables) -> DataFrame:
    """Exact quantiles of every feature on the training rows of every fold, in shared passes."""
    return _fold_quantiles(t)


@query(_fold_quantiles_sql())
def fold_quantiles_narrowing(t: Tables) -> DataFrame:
    """The same through a second narrowing round."""
    return _fold_quantiles(t, gather_rows=10)


_ROBUST = f"""WITH {TRAIN}, scales AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}" for c in MARKET_CORE)} FROM train)
SELECT ticker, CAST(date AS VARCHAR) AS date, {", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}" for c in MARKET_CORE)} FROM market CROSS JOIN scales"""


def _robust(t: Tables, **how) -> DataFrame:
    market = _market(t).select("ticker", "date", *MARKET_CORE)
    train, _ = modeling.time_split(market, modeling.split_date(market))
    return comparable(modeling.standardize(market, foldmodels.robust_scaling(train, MARKET_CORE, **how)))


@query(_ROBUST)
def robust_scaled(t: Tables) -> DataFrame:
    """Features less their training median, in units of the training quartile distance."""
    return _robust(t)


@query(_ROBUST)
def robust_scaled_narrowing(t: Tables) -> DataFrame:
    """The same through a second narrowing round of the quantiles."""
    return _robust(t, gather_rows=10)


def _fitted(t: Tables):
    rows = _rows(t)
    folds = _expanding(rows)
    member = cut_lineage(foldmodels.with_folds(rows, folds, label_end="label_end"))
    return member, foldmodels.fit_logistic(member, folds, MARKET_CORE)


@query(
    f"""WITH {_EXPANDING}, columns AS (SELECT unnest({['intercept', *MARKET_CORE]!r}) AS column_name)
SELECT CAST(fold AS BIGINT) AS fold, column_name, count(*) AS train_rows, CAST(0 AS DOUBLE) AS slope FROM assigned, columns WHERE part = 'train' GROUP BY fold, column_name"""
)
def logistic_optimality(t: Tables) -> DataFrame:
    """The slope of each fold's penalised loss at its fitted coefficients, per training row: zero where the fit is the best one.

    Predictions, preparation and slope are worked out in column expressions, apart from the fit.
    """
    member, models = _fitted(t)
    per_fold = []
    for n, model in models.items():
        values = [F.lit(1.0), *model.prepared.columns(MARKET_CORE)]
        score = sum((F.lit(float(b)) * v for b, v in zip(model.beta, values)), F.lit(0.0))
        miss = (F.lit(1.0) / (F.lit(1.0) + F.exp(-score)) - F.col("label")) * F.when(F.col("label") == 1, model.weights[1]).otherwise(model.weights[0])
        penalty = [0.0, *model.beta[1:].tolist()]
        slopes = [((F.sum(miss * v) + F.lit(p)) / F.count(F.lit(1))).alias(f"s{k}") for k, (v, p) in enumerate(zip(values, penalty))]
        one = member.where(F.array_contains(foldmodels.TRAINS, n)).agg(F.count(F.lit(1)).alias("train_rows"), *slopes)
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"s{k}").alias("slope")) for k, c in enumerate(["intercept", *MARKET_CORE])])
        per_fold.append(one.select(F.lit(n).alias("fold"), "train_rows", F.inline(pairs)))
    found = per_fold[0]
    for more in per_fold[1:]:
        found = found.unionByName(more)
    # six places, and no sign on a zero
    return comparable(found.withColumn("slope", F.round("slope", 6) + F.lit(0.0)))


@query()
def expanding_logistic(t: Tables) -> DataFrame:
    """Test metrics of a logistic regression per expanding fold and on the holdout, each fitted on its fold."""
    member, models = _fitted(t)
    return comparable(validation.fold_metrics(foldmodels.predict_folds(member, models, MARKET_CORE, ["ticker", "date"])))


# a fixed score of three features, and the rows it is judged on
_SCORED = {"return_5d": 0.6, "volatility_21d": -0.3, "return_21d": 0.1}


def _score_sql(swapped: str = "") -> str:
    return " + ".join(f"{w} * coalesce({'value' if c == swapped else c}, 0.0)" for c, w in _SCORED.items())


def _fall_sql() -> str:
    place = lambda salt: f"row_number() OVER (ORDER BY md5('{salt}|' || ticker || '|' || CAST(date AS VARCHAR)))"
    numbers = ", ".join(f"{place(f'0:{c}')} AS at_{c}" for c in _SCORED)
    scores = [f"SELECT '' AS column_name, label, {_score_sql()} AS p FROM base"]
    scores += [f"SELECT '{c}', label, {_score_sql(c)} FROM base JOIN (SELECT at_{c} AS spot, {c} AS value FROM base) o USING (spot)" for c in _SCORED]
    return f"""WITH {_ROWS}, base AS (SELECT *, {place('0')} AS spot, {numbers} FROM rows),
scores AS ({" UNION ALL ".join(scores)}),
ranked AS (SELECT *, rank() OVER (PARTITION BY column_name ORDER BY p) + (count(*) OVER (PARTITION BY column_name, p) - 1) / 2.0 AS r FROM scores),
auc AS (
  SELECT column_name, (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS a
  FROM ranked GROUP BY 1)
SELECT c.column_name, round(w.a, 6) AS auc_roc, round(c.a, 6) AS shuffled_auc, round(w.a - c.a, 6) AS importance FROM auc c, auc w WHERE c.column_name <> '' AND w.column_name = ''"""


@query(_fall_sql())
def permutation_importance(t: Tables) -> DataFrame:
    """The fall of a score's area when one of its columns is shuffled among the rows."""
    rows = _rows(t).select("ticker", "date", "label", *_SCORED)

    def score(value):
        total = None
        for c, w in _SCORED.items():
            term = F.lit(w) * F.coalesce(value(c), F.lit(0.0))
            total = term if total is None else total + term
        return total

    return comparable(importance.permutation_importance(rows, ["ticker", "date"], list(_SCORED), "label", score))


_PENALTIES = (0.01, 0.1, 1.0)


@query(
    f"""WITH {_ROWS},
used AS (SELECT return_5d AS a, volatility_21d AS b, forward_return_5d AS y FROM rows WHERE return_5d IS NOT NULL AND volatility_21d IS NOT NULL),
m AS (SELECT corr(a, b) AS r, covar_pop(a, y) / stddev_pop(a) AS ca, covar_pop(b, y) / stddev_pop(b) AS cb, avg(y) AS intercept FROM used),
p AS (SELECT CAST(unnest({list(_PENALTIES)}) AS DOUBLE) AS penalty),
solved AS (SELECT penalty, intercept, ((1 + penalty) * ca - r * cb) / ((1 + penalty) * (1 + penalty) - r * r) AS a, ((1 + penalty) * cb - r * ca) / ((1 + penalty) * (1 + penalty) - r * r) AS b FROM m, p)
SELECT round(penalty, 6) AS penalty, 'return_5d' AS column_name, round(a, 6) AS coefficient, round(intercept, 6) AS intercept FROM solved
UNION ALL SELECT round(penalty, 6), 'volatility_21d', round(b, 6), round(intercept, 6) FROM solved"""
)
def ridge_coefficients(t: Tables) -> DataFrame:
    """Ridge regressions of the forward return on two features, solved in closed form in SQL."""
    columns = ["return_5d", "volatility_21d"]
    found = penalized.ridge_path(penalized.moments(_rows(t), columns, "forward_return_5d"), _PENALTIES)
    rows = [(m.penalty, c, float(b), float(m.intercept)) for m in found for c, b in zip(columns, m.coefficients)]
    return comparable(t.spark.createDataFrame(rows, "penalty double, column_name string, coefficient double, intercept double"))


@query(
    f"""WITH {_ROWS}, used AS (SELECT * FROM rows WHERE {" AND ".join(f"{c} IS NOT NULL" for c in MARKET_CORE)}),
strength AS (SELECT greatest({", ".join(f"abs(covar_pop({c}, forward_return_5d) / stddev_pop({c}))" for c in MARKET_CORE)}) AS largest FROM used)
SELECT share, column_name, round(share * largest, 6) AS penalty, CAST(0 AS DOUBLE) AS violation, CASE WHEN share >= 1 THEN CAST(1 AS BIGINT) END AS zero_from_here
FROM strength, (SELECT CAST(unnest([0.05, 0.5, 1.0]) AS DOUBLE) AS share), (SELECT unnest({list(MARKET_CORE)!r}) AS column_name)"""
)
def lasso_optimality(t: Tables) -> DataFrame:
    """Lasso regressions at shares of the least penalty that leaves no column: how far each is from its optimality condition on all rows."""
    rows = cut_lineage(_rows(t).select("forward_return_5d", *MARKET_CORE))
    m = penalized.moments(rows, MARKET_CORE, "forward_return_5d")
    empty = penalized.lasso_path(m, [float("inf")])[0]
    largest = max(abs(m.products[:-1, -1] / empty.scales))
    shares = (0.05, 0.5, 1.0)
    models = penalized.lasso_path(m, [float(s * largest) for s in shares])
    slopes = penalized.slopes(rows, models, MARKET_CORE, "forward_return_5d")
    inactive = F.abs("coefficient") < 1e-9 * float(largest)
    gap = F.when(inactive, F.greatest(F.abs("slope") - F.col("penalty"), F.lit(0.0))).otherwise(F.abs(F.col("slope") - F.col("penalty") * F.signum("coefficient")))
    share = F.round(F.col("penalty") / F.lit(float(largest)), 6)
    out = slopes.select(share.alias("share"), "column_name", "penalty", (F.round(gap, 6) + F.lit(0.0)).alias("violation"), F.when(share >= 1, inactive.cast("int")).alias("zero_from_here"))
    return comparable(out)
