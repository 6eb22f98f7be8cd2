"""Ensembles from histograms: the first rounds, trees and samples, stated in SQL as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ensembles
from .registry import Tables, comparable, query
from .validation import _ROWS, _rows

_COLUMNS = ("return_5d", "volatility_21d", "volume_zscore_20d")
_CUTS = 8

# labelled rows with the bins of three features
_BINNED = f"""{_ROWS},
cuts AS (SELECT {", ".join(f"list_sort(list_distinct(quantile_cont({c}, {[k / _CUTS for k in range(1, _CUTS)]}))) AS q{i}" for i, c in enumerate(_COLUMNS))} FROM rows),
bins AS (
  SELECT ticker, date, label AS y, {", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 + len(list_filter(q{i}, lambda x: {c} > x)) END AS b{i}" for i, c in enumerate(_COLUMNS))}
  FROM rows, cuts)"""

_LONG = "SELECT *, unnest([0, 1, 2]) AS c, unnest([b0, b1, b2]) AS b"


def _binned(t: Tables) -> ensembles.Binned:
    return ensembles.binned(_rows(t), _COLUMNS, "label", ["ticker", "date"], bins=_CUTS)


def _adaboost_sql(rounds: int) -> str:
    steps, weight = [], "1.0"
    for r in range(rounds):
        steps.append(
            f"""w{r} AS (SELECT y, b0, b1, b2, {weight} AS w FROM bins{"".join(f", s{k}" for k in range(r))}),
h{r} AS (SELECT c, b, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS w1, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS w0 FROM ({_LONG} FROM w{r}) GROUP BY c, b),
l{r} AS (
  SELECT c, b AS last, sum(w1) OVER a AS left1, sum(w0) OVER a AS left0, sum(w1) OVER (PARTITION BY c) AS all1, sum(w0) OVER (PARTITION BY c) AS all0, lead(b) OVER a AS next
  FROM h{r} WINDOW a AS (PARTITION BY c ORDER BY b)),
e{r} AS (
  SELECT c, last, 1 AS above, (left1 + all0 - left0) / (all1 + all0) AS error FROM l{r} WHERE next IS NOT NULL
  UNION ALL SELECT c, last, 0, (left0 + all1 - left1) / (all1 + all0) FROM l{r} WHERE next IS NOT NULL),
s{r} AS (SELECT c AS c{r}, last AS last{r}, above AS above{r}, ln((1 - error) / error) AS vote{r} FROM e{r} ORDER BY round(error, 11), c, last, above DESC LIMIT 1)"""
        )
        missed = f"CASE WHEN (CASE WHEN CASE c{r} WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END > last{r} THEN above{r} ELSE 1 - above{r} END) <> y THEN vote{r} ELSE 0.0 END"
        weight = f"exp({missed})" if r == 0 else f"{weight} * exp({missed})"
    found = " UNION ALL ".join(f"SELECT CAST({r} AS BIGINT) AS round, {list(_COLUMNS)}[c{r} + 1] AS column_name, CAST(last{r} AS BIGINT) AS last_bin, CAST(above{r} AS BIGINT) AS above, round(vote{r}, 6) AS vote FROM s{r}" for r in range(rounds))
    return f"WITH {_BINNED}, {', '.join(steps)} {found}"


@query(_adaboost_sql(3))
def adaboost_rounds(t: Tables) -> DataFrame:
    """The stumps and votes of the first three rounds of AdaBoost."""
    found = [(r, _COLUMNS[s.column], s.last, s.above, s.vote) for r, s in enumerate(ensembles.adaboost(_binned(t), 3))]
    return comparable(t.spark.createDataFrame(found, "round int, column_name string, last_bin int, above int, vote double"))


_TREES = 4
_DRAWN = f"""{_BINNED},
placed AS (
  SELECT bins.*, t AS tree, CAST('0x' || substr(md5('bag|' || CAST(t AS VARCHAR) || '|' || ticker || '|' || CAST(date AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM bins, (SELECT unnest(range(0, {_TREES})) AS t)),
drawn AS (SELECT *, len(list_filter({[float(p) for p in ensembles._POISSON]}, lambda p: u >= p)) AS n FROM placed)"""


@query(f"WITH {_DRAWN} SELECT CAST(tree AS BIGINT) AS tree, CAST(y AS BIGINT) AS label, count(*) AS row_count, CAST(sum(n) AS BIGINT) AS drawn, count(*) FILTER (n = 0) AS left_out FROM drawn GROUP BY tree, y")
def bootstrap_draws(t: Tables) -> DataFrame:
    """How many rows of each class the bootstrap samples of four trees draw, and how many they leave out."""
    rows = _rows(t).select("ticker", "date", F.col("label"))
    spread = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(_TREES - 1)))).withColumn("n", ensembles.draws(["ticker", "date"], F.col("tree")))
    return comparable(spread.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("row_count"), F.sum("n").cast("long").alias("drawn"), F.count_if(F.col("n") == 0).alias("left_out")))


def _impurity(a: str, b: str) -> str:
    return f"coalesce(2 * ({a}) * ({b}) / nullif(({a}) + ({b}), 0), 0)"


@query(
    f"""WITH {_DRAWN},
totals AS (SELECT tree, sum(n) AS all_n, sum(n) FILTER (y = 1) AS n1, sum(n) FILTER (y = 0) AS n0 FROM drawn GROUP BY tree),
h AS (SELECT tree, c, b, sum(n) AS k, sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS k1, sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS k0 FROM ({_LONG} FROM drawn) GROUP BY tree, c, b),
l AS (
  SELECT h.tree, c, b AS last, sum(k) OVER a AS left_rows, all_n, sum(k1) OVER a * (all_n / (2.0 * n1)) AS l1, sum(k0) OVER a * (all_n / (2.0 * n0)) AS l0, all_n / 2.0 AS half
  FROM h JOIN totals ON h.tree = totals.tree WINDOW a AS (PARTITION BY h.tree, c ORDER BY b)),
g AS (SELECT *, {_impurity('half', 'half')} - {_impurity('l1', 'l0')} - {_impurity('half - l1', 'half - l0')} AS gain FROM l WHERE left_rows >= 20 AND all_n - left_rows >= 20)
SELECT CAST(tree AS BIGINT) AS tree, {list(_COLUMNS)}[c + 1] AS column_name, CAST(last AS BIGINT) AS last_bin, round(l1 / (l1 + l0), 6) AS left_share, round((half - l1) / (2 * half - l1 - l0), 6) AS right_share
FROM g QUALIFY row_number() OVER (PARTITION BY tree ORDER BY round(gain, 7) DESC, c, last) = 1"""
)
def balanced_roots(t: Tables) -> DataFrame:
    """Root splits of four trees whose classes weigh the same within each tree's own bootstrap sample."""
    grown = ensembles.grow_forest(_binned(t), trees=_TREES, depth=1)
    found = [(n, _COLUMNS[tree.splits[1][0]], tree.splits[1][1], tree.values[2], tree.values[3]) for n, tree in enumerate(grown)]
    return comparable(t.spark.createDataFrame(found, "tree int, column_name string, last_bin int, left_share double, right_share double"))


def _boost_sql(rounds: int) -> str:
    steps, margin = ["base AS (SELECT ln(sum(y) / (count(*) - sum(y))) AS base FROM bins)"], "base"
    for r in range(rounds):
        steps.append(
            f"""m{r} AS (SELECT y, b0, b1, b2, 1 / (1 + exp(-({margin}))) AS p FROM bins, base{"".join(f", s{k}" for k in range(r))}),
h{r} AS (SELECT c, b, sum(p - y) AS g, sum(p * (1 - p)) AS h FROM ({_LONG} FROM m{r}) GROUP BY c, b),
l{r} AS (SELECT c, b AS last, sum(g) OVER a AS lg, sum(h) OVER a AS lh, sum(g) OVER (PARTITION BY c) AS g, sum(h) OVER (PARTITION BY c) AS h FROM h{r} WINDOW a AS (PARTITION BY c ORDER BY b)),
s{r} AS (
  SELECT c AS c{r}, last AS last{r}, -0.1 * lg / (lh + 1) AS low{r}, -0.1 * (g - lg) / (h - lh + 1) AS high{r}, (lg * lg / (lh + 1) + (g - lg) * (g - lg) / (h - lh + 1) - g * g / (h + 1)) / 2 AS gain{r}
  FROM l{r} WHERE lh >= 1 AND h - lh >= 1 ORDER BY round(gain{r}, 7) DESC, c, last LIMIT 1)"""
        )
        margin += f" + CASE WHEN CASE c{r} WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END > last{r} THEN high{r} ELSE low{r} END"
    found = " UNION ALL ".join(f"SELECT CAST({r} AS BIGINT) AS tree, {list(_COLUMNS)}[c{r} + 1] AS column_name, CAST(last{r} AS BIGINT) AS last_bin, round(low{r}, 6) AS left_value, round(high{r}, 6) AS right_value FROM s{r}" for r in range(rounds))
    return f"WITH {_BINNED}, {', '.join(steps)} {found}"


@query(_boost_sql(3))
def boosted_trees(t: Tables) -> DataFrame:
    """The first three trees of depth one of second-order boosting."""
    _, trees = ensembles.boost(_binned(t), rounds=3, depth=1, settle=2)
    found = [(n, _COLUMNS[tree.splits[1][0]], tree.splits[1][1], tree.values[2], tree.values[3]) for n, tree in enumerate(trees)]
    return comparable(t.spark.createDataFrame(found, "tree int, column_name string, last_bin int, left_value double, right_value double"))
