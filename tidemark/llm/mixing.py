"""Mixing sources to target weights, counted in words, by subset-sum budget fitting.

Every source gets a target number of words. Whole passes over a source's documents cover as much of it as
they can; the remaining budget is fitted exactly by length: documents are counted by size, each size gives
its proportional share, and a bounded-knapsack dynamic program over the sizes chooses the rest of the
budget to the word, or as near as the sizes allow. Which documents of a size are taken follows from a
seeded hash, so reruns agree.

Only counts travel: one row per source and size goes into the dynamic program (one group per source), and
the choice among equally long documents is made by rank within hash ranges of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .grouped import fresh_name

#: words left to the dynamic program, and documents of one size ranked together
CAPACITY, RANKED = 40_000, 1_000


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """source, source_size, target of each source; ``sizes`` has one row per source and its source_size.

    Weights repeat over the sources in code-point order, null last. The sources share ``share`` of all
    words; a target stops at ``limit`` times its source and the excess goes to the others by weight. The
    common level is found by one sorted pass over the sources: those with the least room per weight fill
    up first. Sources without words get 0.
    """
    everything = Window.partitionBy(F.lit(0))  # one row per source
    position = F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (position % len(weights) + 1).cast("int"))
    weighted = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(limit)))
    filling = everything.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    # the level per weight if all sources before this one are full and the rest share what remains
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    left = budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    full = F.col("level") * F.col("weight") >= F.col("most")
    levelled = weighted.withColumn("level", level)
    # full sources come first in this order; the first that is not full sets the level of all that follow
    common = F.min(F.when(~full, F.struct((F.col("most") / F.col("weight")).alias("room"), F.col("level").alias("level")))).over(everything)
    return levelled.withColumn("common", common["level"]).select(
        "source", "source_size", F.when(F.col("common").isNull(), F.col("most")).otherwise(F.least("most", F.col("common") * F.col("weight"))).alias("target")
    )


def choose(sizes: np.ndarray, counts: np.ndarray, budget: int, capacity: int = CAPACITY) -> np.ndarray:
    """How many documents of each size to take so that their words come as near to ``budget`` as possible.

    Sizes first give their proportional share of the budget but for its last ``capacity`` words, rounded
    down; those are chosen by a bounded knapsack over all sizes: reachable sums are a bit set, each size
    enters in binary multiples of what it has left, and the best sum is traced back.
    """
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    room = min(capacity, total)
    taken = np.floor(counts * (max(0, budget - room) / max(total, 1))).astype(np.int64)
    rest = budget - int((sizes * taken).sum())
    # more than the room is left after rounding down: fill up with the largest sizes first
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= room:
            break
        more = int(min(counts[i] - taken[i], (rest - room) // sizes[i]))
        if more > 0:
            taken[i] += more
            rest -= more * int(sizes[i])
    mask = (1 << (2 * rest + 1)) - 1
    reach, steps, found = 1, [], False
    for i in np.argsort(-sizes, kind="stable"):
        left, part, size = int(min(counts[i] - taken[i], 2 * rest // sizes[i])), 1, int(sizes[i])
        while left > 0 and not found:
            use = min(part, left)
            steps.append((i, use, reach))
            reach |= (reach << (use * size)) & mask
            left, part = left - use, part * 2
            found = bool(reach >> rest & 1)
    best = nearest_bit(reach, rest)
    for i, use, before in reversed(steps):
        if not before >> best & 1:
            taken[i] += use
            best -= use * int(sizes[i])
    return taken


def nearest_bit(bits: int, place: int) -> int:
    """The set bit nearest to ``place``, the lower one of two; bit 0 is set."""
    below = (bits & ((1 << (place + 1)) - 1)).bit_length() - 1
    above = bits >> (place + 1)
    if not above:
        return below
    up = place + (above & -above).bit_length()
    return up if up - place < place - below else below


def plan(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: int = 2, seed: int = 7
) -> DataFrame:
    """One row per document: doc_id, text_key (a hash of the text), source, size, source_size, target, copies.

    ``copies`` says how often the mix takes the document, 0 to ``limit`` times. A null text has size 0 and is taken 0
    times; a null source is a source of its own, last in order. Rows are documents of their own: where ids
    repeat or are null, the rows of one size and hash are interchangeable. An empty table stays empty.
    """
    narrow = documents.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size"), F.xxhash64(F.col(text_column)).alias("text_key"))
    sized = cut_lineage(narrow.withColumn("place", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))))
    per_size = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sources, weights, share, limit)

    def fit(source: pd.DataFrame) -> pd.DataFrame:
        goal, total = float(source["target"].iloc[0]), int(source["source_size"].iloc[0])
        passes = min(int(goal // total), limit) if total else 0
        lengths, counts = source["size"].to_numpy(np.int64), source["n"].to_numpy(np.int64)
        order = np.argsort(lengths, kind="stable")
        extra = np.zeros(len(lengths), np.int64)
        if passes < limit:
            extra[order] = choose(lengths[order], counts[order], math.floor(goal - passes * total + 0.5))
        return source.assign(passes=passes, extra=extra)[["source", "size", "n", "passes", "extra"]]

    joined = per_size.join(goals, per_size["source"].eqNullSafe(goals["source"])).select(per_size["source"], "size", "n", "target", "source_size")
    source_type = sized.schema["source"].dataType.simpleString()
    fitted = cut_lineage(joined.groupBy("source").applyInPandas(fit, f"source {source_type}, size long, n long, passes long, extra long"))
    # the first `extra` documents of a size by hash: whole hash ranges, and one range that is ranked
    ranges = F.ceil(F.col("n") / RANKED)
    bucket = F.floor((F.col("place") / 2.0**64 + 0.5) * ranges).cast("long")
    planned = fitted.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "n", "passes", "extra")
    dealt = sized.join(planned, sized["source"].eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")), "left").withColumn("bucket", bucket)
    keys = ["source", "size"]
    filled = dealt.where(F.col("extra") > 0).groupBy(*keys, "bucket").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = filled.select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"), before.alias("before"), "m")
    same = dealt["source"].eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b_bucket"))
    placed = dealt.join(first, same, "left")
    rank = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("place", "doc_id", "text_key"))
    ranked = placed.withColumn("copies", F.coalesce("passes", F.lit(0)) + F.when((F.col("extra") > F.col("before")) & (F.col("before") + rank <= F.col("extra")), 1).otherwise(0))
    named = goals.select(F.col("source").alias("g_source"), "source_size", "target")
    return ranked.join(named, ranked["source"].eqNullSafe(F.col("g_source"))).select(
        "doc_id", "text_key", "source", "size", "source_size", "target", F.col("copies").cast("int").alias("copies")
    )


def mix(documents: DataFrame, **options) -> DataFrame:
    """The planned mix in words: doc_id, size, source_size, target, taken (repeats counted)."""
    return plan(documents, **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken; columns as before.

    Documents without words are never taken. Rows that repeat id, text and source are all taken as often as
    the one that is taken least.
    """
    planned = plan(documents, id_column, text_column, source_column, **options)
    taken = documents.columns
    id_name, key_name, source_name, copies_name, hash_name, copy_name = (fresh_name(c, taken) for c in ("id", "key", "source", "copies", "text_key", "copy"))
    copies = planned.groupBy("doc_id", "text_key", "source").agg(F.min("copies").alias(copies_name)).where(F.col(copies_name) > 0)
    keys = copies.select(F.col("doc_id").alias(id_name), F.col("text_key").alias(key_name), F.col("source").alias(source_name), copies_name)
    own = documents.withColumn(hash_name, F.xxhash64(F.col(text_column)))
    same = own[id_column].eqNullSafe(F.col(id_name)) & (F.col(hash_name) == F.col(key_name)) & own[source_column].eqNullSafe(F.col(source_name))
    repeated = own.join(keys, same).withColumn(copy_name, F.explode(F.sequence(F.lit(1), F.col(copies_name))))
    return repeated.select(*documents.columns)
