"""Sources and sinks written to the checkpoint folder and read back, and the steps around a split."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, modeling
from ..plans.comparison import union_predictions
from ..session import ensure_checkpoint_dir
from ..sources.filings import read_texts
from ..sources.tables import scan, write_metrics, write_panel, write_table
from . import common as base
from .market import BARS_CONTRACT
from .modeling import _CONFUSION, _PREDICTIONS, _predictions
from .registry import Tables, comparable, query


#: texts in one file at most; a file is read back as one value
FILE_ROWS = 100


def _folder(t: Tables) -> str:
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/trip-{uuid.uuid4().hex}"


@query(f"WITH {base.BARS} SELECT ticker, {base.iso('date')}, adj_close, {base.r6('volume')} FROM bars")
def panel_round_trip(t: Tables) -> DataFrame:
    """A panel written by year and scanned under its contract."""
    path = _folder(t)
    write_panel(base.bars(t), path)
    return comparable(scan(t.spark, path, BARS_CONTRACT).select("ticker", "date", "adj_close", "volume"), exact=("adj_close",))


@query("SELECT nation.n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def table_round_trip(t: Tables) -> DataFrame:
    """A table written in folders by a column, and read with the columns it must have."""
    path = _folder(t)
    named = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    write_table(named.select("n_nationkey", "n_name", "n_regionkey", "r_name"), path, ["n_regionkey"])
    return comparable(scan(t.spark, path, columns=["n_nationkey", "n_name", "n_regionkey", "r_name"]).select("n_nationkey", "n_name", "n_regionkey", "r_name"))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders")
def orders_round_trip(t: Tables) -> DataFrame:
    """A table that grows, written in folders by a column of few values, and read with the columns it must have."""
    path, names = _folder(t), ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]
    write_table(t("orders").select(*names), path, ["o_orderstatus"])
    return comparable(scan(t.spark, path, columns=names).select(*names), exact=("o_totalprice",))


@query(
    f"""WITH {_CONFUSION}
SELECT model_name, metric, value FROM (SELECT model_name, CAST(tn AS DOUBLE) AS tn, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tp AS DOUBLE) AS tp FROM counts)
UNPIVOT (value FOR metric IN (tn, fp, fn, tp))"""
)
def metrics_round_trip(t: Tables) -> DataFrame:
    """Metrics written as JSON lines and read back."""
    path = _folder(t)
    counts = metrics.confusion(_predictions(t), ["model_name"]).select("model_name", "tn", "fp", "fn", "tp")
    write_metrics(metrics.tidy_metrics(counts, ["model_name"]), path)
    return comparable(t.spark.read.schema("model_name string, metric string, value double").json(path))


@query("SELECT source, CAST(sum(length(text)) + count(*) AS BIGINT) AS n_chars, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines FROM documents GROUP BY source")
def corpus_round_trip(t: Tables) -> DataFrame:
    """Texts written as files of bounded size in a folder per source and read file by file."""
    path = _folder(t)
    base.documents(t).select("source", "text").write.partitionBy("source").option("maxRecordsPerFile", FILE_ROWS).text(path)
    files = read_texts(t.spark, f"{path}/*/part-*").select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), "text")
    per_file = files.select("source", F.length("text").alias("n"), (F.length("text") - F.length(F.translate("text", "\n", ""))).alias("lines"))
    return per_file.groupBy("source").agg(F.sum("n").alias("n_chars"), F.sum("lines").alias("n_lines"))


@query(
    """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS ticker, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date,
       CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END::BIGINT AS label, o_totalprice AS price
FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 7 <> 0"""
)
def prepared_rows(t: Tables) -> DataFrame:
    """Text columns typed for modelling; rows without key, date or label go."""
    raw = t("orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("ticker"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("1996-02-31")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_orderstatus") == "F", "1").otherwise("0")).alias("label"),
        F.col("o_totalprice").cast("string").alias("price"),
    )
    return comparable(modeling.prepare(raw, ["price", "not_there"]), exact=("price",))


@query(
    """
WITH days AS (SELECT list(DISTINCT CAST(o_orderdate AS DATE) ORDER BY CAST(o_orderdate AS DATE)) AS d FROM orders),
edge AS (SELECT d[greatest(least(CAST(floor(len(d) * 0.8) AS BIGINT), len(d) - 1), 1) + 1] AS e FROM days)
SELECT CASE WHEN CAST(l_shipdate AS DATE) < (SELECT e FROM edge) THEN 'train' ELSE 'test' END AS part, count(*) AS n,
       CAST((SELECT e FROM edge) AS VARCHAR) AS split_date
FROM lineitem GROUP BY 1"""
)
def shared_split(t: Tables) -> DataFrame:
    """Item lines split at the date that the orders set."""
    edge = modeling.split_date(t("orders").select(F.to_date("o_orderdate").alias("date")))
    lines = t("lineitem").select(F.to_date("l_shipdate").alias("date"))
    parts = [d.groupBy(F.lit(part).alias("part")).agg(F.count("*").alias("n"), F.lit(edge).alias("split_date")) for part, d in zip(("train", "test"), modeling.time_split(lines, edge))]
    return comparable(union_predictions(parts))


@query(f"WITH {_PREDICTIONS} SELECT doc_id, CAST(label AS BIGINT) AS label, model_name, CAST(predicted_label AS BIGINT) AS predicted_label, round(predicted_probability, 6) AS predicted_probability FROM predictions")
def united_predictions(t: Tables) -> DataFrame:
    """Predictions of two models, one below the other."""
    both = _predictions(t)
    one, two = (both.where(F.col("model_name") == name) for name in ("by_length", "by_source"))
    return comparable(union_predictions([one, two.select(*reversed(two.columns))]))
