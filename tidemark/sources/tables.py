"""Parquet scans under a contract, parquet and JSON sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import Contract, enforce, require


def scan(spark: SparkSession, path: str, contract: Contract | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Read parquet; check the contract or the bare column list before any job runs."""
    df = spark.read.parquet(path)
    if columns:
        require(df, columns, path)
    return enforce(df, contract) if contract else df


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan with at least as many partitions as the session has slots.

    For costly per-row work on few files: a scan that already has enough partitions, the usual case
    on large data, is returned as it is. Pass a plain scan, since its partitions are counted here.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= slots:
        return scan
    return scan.repartition(slots, *keys)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_panel(df: DataFrame, path: str, date_column: str = "date") -> None:
    """Write a panel partitioned by year, so later date filters prune whole folders.

    The rebalance hint gathers a year's rows into files of the advisory size; adaptive execution
    splits a busy year over as many tasks as it needs.
    """
    write_table(df.withColumn("year", F.year(date_column)).hint("rebalance", "year"), path, ["year"])


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def metrics_document(metrics: DataFrame, by: Sequence[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """One JSON object per group from tidy (group, metric, value) rows; a group is a short metric list."""
    entry = F.map_from_entries(F.sort_array(F.collect_list(F.struct(metric, value))))
    return metrics.groupBy(*by).agg(F.to_json(entry).alias("metrics_json"))
