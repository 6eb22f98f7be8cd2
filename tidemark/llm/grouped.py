"""Groups of sorted Arrow batches, and connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of equal (adjacent) integer keys, and the bounds of the groups in each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch), bool)
        for k in keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
            if held and values[0] != held[-1].column(k)[len(held[-1]) - 1].as_py():
                change[0] = True
        starts = np.flatnonzero(change)
        if not len(starts):
            held.append(batch)
            continue
        last = int(starts[-1])
        head = [*held, batch.slice(0, last)]
        held = [batch.slice(last)]
        if table := _table(head):
            yield table, group_bounds(table, keys)
    if held and (table := _table(held)):
        yield table, group_bounds(table, keys)


def _table(batches: list[pa.RecordBatch]) -> pa.Table | None:
    filled = [b for b in batches if len(b)]
    return pa.Table.from_batches(filled).combine_chunks() if filled else None


def group_bounds(table: pa.Table, keys: list[int]) -> np.ndarray:
    change = np.zeros(len(table), bool)
    for k in keys:
        values = table.column(k).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.concatenate([[0], np.flatnonzero(change), [len(table)]])


def hung_on_least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of numbers as stars: every number that is not the least one its pairs reach, and that least one."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, left, label[right])
        np.minimum.at(low, right, label[left])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node and component, the smallest node reachable, of every node of an edge table.

    Large-star and small-star steps alternate until the edges stay the same: each node's neighbours are
    joined to the smallest of them, which halves distances each time. A hub is aggregated before the
    shuffle and its edges are an ordinary skewed join.
    """
    current = cut_lineage(
        edges.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct()
    )
    nodes = current.select(F.col("u").alias("node")).union(current.select("v")).distinct()
    seen = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u != v")
        current = cut_lineage(small.union(smallest.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    # every node now hangs on its smallest one
    return nodes.join(current.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def fresh_name(wanted: str, taken: Iterable[str]) -> str:
    """A column name that no other column has, whatever its case."""
    known, name = {c.lower() for c in taken}, f"_{wanted}"
    while name.lower() in known:
        name = f"_{name}"
    return name


def looked_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], by: str, salts: int = 64) -> DataFrame:
    """``rows`` left-joined with a table of one row per key; a key that many rows share is dealt over ``salts`` tasks.

    ``by`` tells rows of a key apart. The table's row is repeated once per salt that the key's rows have.
    """
    salt = fresh_name("salt", [*rows.columns, *table.columns])
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)))
    spread = salted.select(*keys, salt).distinct().join(table, list(keys))
    return salted.join(spread, [*keys, salt], "left").drop(salt)
