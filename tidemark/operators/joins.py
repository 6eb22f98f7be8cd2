"""Equi-join helpers: lookups, per-entity source preference, coverage differences, keyed features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, mapping: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their mapped columns, and the distinct keys the mapping does not know.

    The join strategy is left to the size statistics: a small map is broadcast, a large one is not.
    """
    unmatched = df.select(*keys).distinct().join(mapping, list(keys), "left_anti")
    return df.join(mapping, list(keys), "inner"), unmatched


def prefer_source(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of ``first``, and rows of ``second`` only for entities ``first`` has no row of."""
    covered = first.select(*keys).distinct()
    return first.unionByName(second.join(covered, list(keys), "left_anti"), allowMissingColumns=True)


def missing_members(universe: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members of the universe that have no row in ``present``, each once, sorted."""
    have = present.select(*keys).dropna().distinct()
    return universe.select(*keys).distinct().join(have, list(keys), "left_anti").orderBy(*keys)


def missing_concepts(facts: DataFrame, entities: DataFrame, key: str, concept: str, concepts: Sequence[str]) -> DataFrame:
    """(entity, concept) pairs for which an entity has no fact. ``concepts`` is a short fixed list."""
    wanted = entities.select(key).distinct().withColumn(concept, F.explode(F.array(*[F.lit(c) for c in concepts])))
    return wanted.join(facts.select(key, concept).distinct(), [key, concept], "left_anti")


def attach(left: DataFrame, features: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join of chosen feature columns on a shared grain; right duplicates multiply rows."""
    return left.join(features.select(*on, *columns), list(on), "left")
