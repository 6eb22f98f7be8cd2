"""The registry, and the forms in which results are compared."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The shared tables of one folder, read lazily by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query under its function name."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        REGISTRY[build.__name__] = Query(build, sql)
        return build

    return add


def comparable(df: DataFrame, exact: tuple[str, ...] = ()) -> DataFrame:
    """Dates as ISO text, doubles at six places, counts and flags as bigint: equal across engines.

    ``exact`` names doubles that both engines compute by the same single operation; prices divided by
    a quantity often lie half way between two six-place numbers.
    """
    shaped = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        if dtype == "date":
            c = c.cast("string")
        elif dtype.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif dtype == "double" and name not in exact:
            c = F.round(c, 6)
        elif dtype in ("int", "smallint", "tinyint", "boolean"):
            c = c.cast("bigint")
        shaped.append(c.alias(name))
    return df.select(*shaped)
