"""Candidate links of operator 1: signature bands joined in Spark.

Signatures that agree in all components of a band are a bucket. Buckets up to ``BUCKET`` members compare all
their signatures; larger ones are cut into blocks that share pivots, and what their block does not connect with
the best pivot is compared with every block. Links are confirmed on full shingle sets by ``linking``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage
from .grouped import looked_up, whole_groups
from .linking import LIKELY, link_schema, near_duplicates, search, shared, signatures_of, undirected

#: bands and components of a band; a pair of similarity 0.75 shares no band with a chance below 1e-5
BANDS, ROWS = 32, 4
#: members of a bucket that compare all signatures; members of a block of a larger one, and how many all its blocks hold
BUCKET, BLOCK, PIVOTS = 256, 2_048, 4


def buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The buckets of every representative (bucket, node), and the sizes of those with more than one (bucket, n)."""
    digits = 2 * ROWS
    bands = F.explode(F.array(*[F.xxhash64(F.lit(t), F.substring("signature", t * digits + 1, digits)) for t in range(BANDS)]))
    rows = classes.select("node", bands.alias("bucket"))
    return rows, rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")


def likely_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect whatever shares a bucket and agrees in a share of LIKELY at least."""
    rows, found = buckets(classes)
    members = cut_lineage(shared(rows, cut_lineage(found), "bucket"))
    prints = classes.select("node", "signature")
    links = small_buckets(members.where(F.col("n") <= BUCKET).join(prints, "node"))
    crowded = members.where(F.col("n") > BUCKET)
    if not crowded.isEmpty():
        links = links.union(crowded_buckets(crowded, prints))
    return undirected(links)


def small_buckets(members: DataFrame) -> DataFrame:
    """Spanning forests of the likely links of each bucket: a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, [0]):
            nodes, prints = table.column(1).to_numpy(), signatures_of(table.column(2))
            pairs = []
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                pairs += [(start + i, start + j) for i, j in spanning_forest(prints[start:end])]
            if pairs:
                i, j = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j])], ["a", "b"])

    dealt = members.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.select("bucket", "node", "signature").mapInArrow(run, link_schema(members.schema["node"].dataType))


def crowded_buckets(crowded: DataFrame, prints: DataFrame) -> DataFrame:
    """Likely links that connect all likely pairs of each crowded bucket: a, b.

    A bucket is cut into blocks that all hold its pivots, a few members chosen by hash. Blocks are searched
    from member to member. What a block connects with the best pivot is connected across blocks; the
    others, the strays, are compared with every block, in tasks of bounded size. No pair is left out.
    """
    inside = crowded.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long"))
    first = [F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("at"), "node"))["node"] for k in range(PIVOTS)]
    pivots = cut_lineage(inside.groupBy("bucket", "blocks").agg(F.array_distinct(F.array(*first)).alias("node")).withColumn("node", F.explode("node")))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = inside.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "bucket", "node"), "blocks")).select("bucket", "block", "node")
    placed = own.union(pivots.withColumn("block", numbers("blocks")).select("bucket", "block", "node")).distinct()
    labels = cut_lineage(searched(placed.join(prints, "node")))
    links = labels.select(F.col("parent").alias("a"), F.col("node").alias("b"))
    # the pivot that the most members are connected with
    counts = labels.groupBy("bucket", "block", "label").agg(F.count("*").alias("members"))
    reach = labels.join(pivots.select("bucket", "node"), ["bucket", "node"]).select("bucket", "block", "label", "node").distinct().join(counts, ["bucket", "block", "label"])
    best = reach.groupBy("bucket", "node").agg(F.sum("members").alias("members")).groupBy("bucket").agg(F.max(F.struct("members", "node"))["node"].alias("node"))
    home = cut_lineage(labels.join(best, ["bucket", "node"]).select("bucket", "block", F.col("label").alias("home")).distinct())
    at_home = labels.join(home, (labels["bucket"] == home["bucket"]) & (labels["block"] == home["block"]) & (labels["label"] == home["home"]), "left_anti")
    blocks = pivots.select("bucket", "blocks").distinct().where("blocks > 1")
    strays = cut_lineage(at_home.join(blocks, "bucket", "left_semi").select("bucket", "node").distinct())
    if strays.isEmpty():
        return links
    parts = strays.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts")).join(blocks, "bucket")
    one = strays.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64(F.lit("stray"), "bucket", "node"), "parts")).withColumn("block", numbers("blocks"))
    other = labels.join(parts, "bucket").withColumn("part", numbers("parts"))
    shape = ["bucket", "part", "block", "is_stray", "label", "node"]
    pairs = one.withColumns({"is_stray": F.lit(1), "label": F.col("node")}).select(*shape).unionByName(other.withColumn("is_stray", F.lit(0)).select(*shape))
    return links.union(stray_links(pairs.join(prints, "node")))


def searched(placed: DataFrame) -> DataFrame:
    """Per member of a block the member it was reached from, and the first one of all that are connected: parent, label."""
    longs = ["bucket", "block", "node", "parent", "label"]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in longs])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, [0, 1]):
            nodes, prints = table.column(2).to_numpy(), signatures_of(table.column(3))
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own = nodes[start:end]
                parent, label = search(prints[start:end])
                part = table.slice(start, end - start)
                columns = [part.column(0).combine_chunks(), part.column(1).combine_chunks(), own, own[parent], own[label]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow)

    dealt = placed.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "node")
    return dealt.select("bucket", "block", "node", "signature").mapInArrow(run, schema)


def stray_links(pairs: DataFrame) -> DataFrame:
    """Of each stray and each connected part of a block one likely link, if there is any: a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, [0, 1, 2]):
            stray, labels, nodes = (table.column(k).to_numpy() for k in (3, 4, 5))
            prints, links = signatures_of(table.column(6)), []
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own = np.arange(start, end)
                members = own[stray[start:end] == 0]
                for s in own[stray[start:end] == 1].tolist():
                    found = members[(prints[members] == prints[s]).mean(axis=1) >= LIKELY]
                    links += [(s, m) for m in found[np.unique(labels[found], return_index=True)[1]].tolist()]
            if links:
                i, j = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j])], ["a", "b"])

    keys = ["bucket", "part", "block"]
    dealt = pairs.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "is_stray", "label", "node", "signature").mapInArrow(run, link_schema(pairs.schema["node"].dataType))


def spanning_forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Greatest spanning forest of the pairs whose signatures agree in a share of LIKELY at least."""
    n = len(prints)
    if n == 2:
        return [(0, 1)] if (prints[0] == prints[1]).mean() >= LIKELY else []
    best, parent, outside, out = np.full(n, -1.0), np.zeros(n, int), np.ones(n, bool), []
    at = 0
    while True:
        outside[at] = False
        rest = np.flatnonzero(outside)
        if not len(rest):
            return out
        agree = (prints[rest] == prints[at]).mean(axis=1)
        better = agree > best[rest]
        best[rest[better]], parent[rest[better]] = agree[better], at
        at = int(rest[best[rest].argmax()])
        if best[at] >= LIKELY:
            out.append((int(parent[at]), at))




def near_classes(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per id: doc_id, class_id, the smallest id that links reach, and n_linked, how many other ids they reach.

    Two documents are linked if their sets of 5-word shingles have a Jaccard similarity of 0.75 at least, verified on the full
    sets (``linking.near_duplicates``); a pair at the limit shares no band with a chance below 1e-5. Rows with a null id are left out.
    """
    found = near_duplicates(documents, likely_links, id_column, text_column).where(F.col("doc_id").isNotNull())
    of_doc = cut_lineage(found.groupBy("doc_id").agg(F.min("component_id").alias("class_id")))
    # of_doc is read here and by the caller, who reads one row per id
    several = of_doc.groupBy("class_id").agg((F.count("*") - 1).alias("n_linked")).where("n_linked > 0")
    return looked_up(of_doc, several, ["class_id"], by="doc_id").select("doc_id", "class_id", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"))
