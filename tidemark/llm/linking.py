"""Near-duplicate classes from candidate links, confirmed on full shingle sets.

Documents with equal shingle sets form a class, and one representative of each class goes on. Candidate links
between representatives come from signatures (``bands`` or ``forest``) and split them into clusters. Links are
confirmed inside the clusters on the full sets: a search from member to member visits each once and compares it with those
not yet reached, so a dense cluster costs few comparisons and no pair of different clusters any. Texts travel only
where a filter of fixed size does not rule out that their document is in a cluster.

A cluster too large for one task is cut into blocks that all hold its best-linked member. Members that
their block does not connect with it are compared with every block, in tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage, settled
from .fingerprints import shingles, signatures
from .grouped import components, fresh_name, looked_up, whole_groups
from .sieve import sieve
from .textbytes import distinct_per_row, mix, prefix_hashes, slices, span_hashes, utf8

PERMUTATIONS = 128
#: links are confirmed at this similarity; likely links reach LIKELY by signature, 4.5 deviations less
SIMILARITY, LIKELY = (75, 100), 0.58
#: shingles of a cluster, or of a block of one, in one task
CLUSTER_SHINGLES = 2_000_000
SLICE = 1 << 18


def signed(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, n_shingles, two hashes of the shingle set, and the signature of every row."""
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    longs = [T.StructField(c, T.LongType()) for c in ("n_shingles", "set_a", "set_b")]
    schema = T.StructType([source.schema["doc_id"], *longs, T.StructField("signature", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, SLICE):
                values, begin = distinct_per_row(*shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                sets = [span_hashes(prefix_hashes(x), begin[:-1], begin[1:]).view(np.int64) for x in (values, mix(values))]
                prints = [row.astype(">u2").tobytes() for row in signatures(values, begin, PERMUTATIONS)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(begin)), *map(pa.array, sets), pa.array(prints, pa.binary())], schema=arrow
                )

    return source.mapInArrow(run, schema)


def signatures_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").astype(np.uint16).reshape(len(column), -1)


def link_schema(node: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("a", node), T.StructField("b", node)])


def shared(rows: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``sizes``, joined with it; most rows have a key of their own and never travel."""
    maybe = sieve(sizes.select(key))
    return rows.where(maybe(F.col(key))).join(sizes, key)


def undirected(links: DataFrame) -> DataFrame:
    return links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def search(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents and first members by breadth-first search over the pairs that agree in a share of LIKELY at least."""
    n = len(prints)
    parent, label = np.arange(n), np.full(n, -1)
    rest = np.arange(n)
    for start in range(n):
        if label[start] >= 0:
            continue
        label[start], queue = start, [start]
        rest = rest[rest != start]
        while queue and len(rest):
            at = queue.pop()
            near = (prints[rest] == prints[at]).mean(axis=1) >= LIKELY
            found = rest[near]
            parent[found], label[found] = at, start
            rest = rest[~near]
            queue += found.tolist()
    return parent, label


def linked(shared: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """Whether sets with ``shared`` common elements reach the similarity."""
    return SIMILARITY[1] * shared >= SIMILARITY[0] * (size + sizes - shared)


class Sets:
    """Shingle sets of a group: distinct values numbered, members one after the other."""

    def __init__(self, texts: pa.ChunkedArray):
        values, counts = [], []
        for chunk in texts.chunks:
            data, offsets = utf8(chunk)
            for a, b in slices(offsets, SLICE):
                v, begin = distinct_per_row(*shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                values.append(v)
                counts.append(np.diff(begin))
        self.sizes = np.concatenate(counts)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        distinct, self.values = np.unique(np.concatenate(values), return_inverse=True)
        self.flags = np.zeros(len(distinct), bool)

    def neighbours(self, member: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` (ascending, not empty sets) that are linked with ``member``."""
        size = self.sizes[member]
        sizes = self.sizes[others]
        others = others[(SIMILARITY[1] * np.minimum(size, sizes) >= SIMILARITY[0] * np.maximum(size, sizes))]
        if not len(others):
            return others
        own = self.values[self.bounds[member] : self.bounds[member + 1]]
        self.flags[own] = True
        lengths = self.sizes[others]
        starts = np.cumsum(lengths) - lengths
        place = np.arange(lengths.sum()) - np.repeat(starts - self.bounds[others], lengths)
        shared = np.add.reduceat(self.flags[self.values[place]].astype(np.int64), starts)
        self.flags[own] = False
        return others[linked(shared, size, lengths)]


def reached(sets: Sets) -> np.ndarray:
    """A component number for each member: breadth-first search over confirmed links."""
    n = len(sets.sizes)
    label = np.full(n, -1)
    open_members = np.ones(n, bool)
    open_members[sets.sizes == 0] = False
    for start in range(n):
        if label[start] >= 0:
            continue
        label[start], open_members[start] = start, False
        queue = [start] if sets.sizes[start] else []
        while queue:
            found = sets.neighbours(queue.pop(), np.flatnonzero(open_members))
            label[found], open_members[found] = start, False
            queue += found.tolist()
    return label


def confirm(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, label: the smallest node that confirmed links reach inside the group.

    ``grouped`` has long keys, node and text; rows of one node are one document.
    """
    schema = T.StructType([*(grouped.schema[k] for k in keys), T.StructField("node", grouped.schema["node"].dataType), T.StructField("label", grouped.schema["node"].dataType)])
    arrow, count = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, list(range(count))):
            nodes = table.column(count).to_numpy()
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own = nodes[start:end]
                label = reached(Sets(table.column(count + 1).slice(start, end - start)))
                label = same_node(own, label)
                least = np.full(label.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, label, own)
                part = table.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*(part.column(k).combine_chunks() for k in range(count)), pa.array(own), pa.array(least[label])], schema=arrow)

    return grouped.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "node", "text").mapInArrow(run, schema)


def same_node(nodes: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after rows of one node are put into one component."""
    order = np.argsort(nodes, kind="stable")
    for i, j in zip(order[:-1], order[1:]):
        if nodes[i] == nodes[j] and label[i] != label[j]:
            label[label == label[j]] = label[i]
    return label


def cross_links(pairs: DataFrame) -> DataFrame:
    """Confirmed links between the strays and the members of a block, per task: a, b.

    ``pairs`` has cluster, stray_block, block, is_stray, node and text.
    """
    node = pairs.schema["node"].dataType
    schema = T.StructType([T.StructField("a", node), T.StructField("b", node)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, [0, 1, 2]):
            nodes, stray = table.column(4).to_numpy(), table.column(3).to_numpy().astype(bool)
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                sets, own = Sets(table.column(5).slice(start, end - start)), nodes[start:end]
                members = np.flatnonzero(~stray[start:end] & (sets.sizes > 0))
                for s in np.flatnonzero(stray[start:end] & (sets.sizes > 0)):
                    found = sets.neighbours(int(s), members)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), own[s])), pa.array(own[found])], ["a", "b"])

    keys = ["cluster", "stray_block", "block"]
    return pairs.repartition(*keys).sortWithinPartitions(*keys).select(*keys, F.col("is_stray").cast("int"), "node", "text").mapInArrow(run, schema)


def links_of_clusters(texts: DataFrame, clusters: DataFrame, degrees: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the confirmed components inside the clusters.

    ``texts`` has node and text, ``clusters`` node, cluster and n_shingles, ``degrees`` node and degree.
    """
    totals = clusters.groupBy("cluster").agg(F.sum("n_shingles").alias("total"))
    blocks = F.ceil(F.col("total") / CLUSTER_SHINGLES).cast("long")
    placed = clusters.join(totals, "cluster").withColumn("blocks", blocks)
    # texts are far larger than the clusters' table at any size: sorted and merged, never decided by a size
    maybe = sieve(clusters.select("node"))
    with_text = cut_lineage(placed.hint("merge").join(texts.where(maybe(F.col("node"))), "node").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")))
    small = confirm(with_text.where("blocks = 1"), ["cluster"])
    edges = small.select(F.col("node").alias("a"), F.col("label").alias("b"))
    large = with_text.where("blocks > 1")
    if large.isEmpty():
        return edges
    # the best-linked member of a large cluster is in all its blocks
    ranked = large.join(degrees, "node").groupBy("cluster").agg(F.max(F.struct("degree", "node"))["node"].alias("pivot"))
    pivots = large.join(ranked, "cluster").where("node = pivot").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    others = large.join(ranked, "cluster").where("node != pivot")
    columns = ["cluster", "blocks", "block", "pivot", "node", "text", "n_shingles"]
    blocked = cut_lineage(others.select(*columns).unionByName(pivots.select(*columns)))
    labels = cut_lineage(confirm(blocked, ["cluster", "block"]))
    edges = edges.union(labels.select("node", "label"))
    # labels that the pivot does not have: compare their members with every block
    home = labels.join(ranked, "cluster").where("node = pivot").select("cluster", "block", F.col("label").alias("home"))
    strays = cut_lineage(labels.join(home, ["cluster", "block"]).where("label != home").select("cluster", "node").distinct())
    if strays.isEmpty():
        return edges
    # tasks of bounded size: parts of the strays, by their own shingles, against each block
    stray_rows = blocked.where("node != pivot").join(strays, ["cluster", "node"], "left_semi")
    parts = stray_rows.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / CLUSTER_SHINGLES).cast("long").alias("parts"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = stray_rows.join(parts, "cluster").withColumn("stray_block", F.pmod(F.xxhash64(F.lit("stray"), F.col("node")), "parts")).withColumn("block", numbers("blocks"))
    other = blocked.join(parts, "cluster").withColumn("stray_block", numbers("parts"))
    shape = ["cluster", "stray_block", "block", "is_stray", "node", "text"]
    pairs = one.withColumn("is_stray", F.lit(True)).select(*shape).unionByName(other.withColumn("is_stray", F.lit(False)).select(*shape))
    return edges.union(cross_links(pairs))


def near_duplicates(documents: DataFrame, likely: Callable[[DataFrame], DataFrame], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept; ``likely`` makes candidate links of (node, signature).

    Two documents are linked if their sets of 5-word shingles (lower-cased in A-Z) have a Jaccard similarity
    of 0.75 at least; ``component_id`` is the smallest id that links reach, ``kept`` marks the document that
    has it. Texts that are null or without words are linked with nothing. Rows that repeat an id are one
    document. Ids are integers; a row with a null id has a null component and is kept. What is linked is exact; how
    many links the candidates miss is said where they are made.
    """
    return settled(lambda: _near_duplicates(documents, likely, id_column, text_column))


def _near_duplicates(documents: DataFrame, likely: Callable[[DataFrame], DataFrame], id_column: str, text_column: str) -> DataFrame:
    every = cut_lineage(signed(documents, id_column, text_column))
    sets = ["set_a", "set_b"]
    filled = every.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).withColumn("doc", F.col("doc_id").cast("long"))
    # documents that share a shingle set hang on the class's smallest id
    classes = cut_lineage(filled.groupBy(*sets).agg(F.min("doc").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")))
    links = cut_lineage(likely(classes))
    clusters = components(links)
    sized = classes.groupBy("node").agg(F.sum("n_shingles").alias("n_shingles"))
    clustered = cut_lineage(clusters.join(sized, "node").select("node", F.col("component").alias("cluster"), "n_shingles"))
    degrees = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
    texts = documents.select(F.col(id_column).cast("long").alias("node"), F.col(text_column).cast("string").alias("text"))
    confirmed = links_of_clusters(texts, clustered, degrees)
    # an id with several sets ties their classes together
    ranked = F.struct(*sets)
    several = filled.groupBy("doc").agg(F.min(ranked).alias("low"), F.max(ranked).alias("high")).where("low != high").select("doc")
    ties = filled.select("doc", *sets).join(several, "doc", "left_semi").join(classes.select(*sets, "node"), sets).select(F.col("doc").alias("a"), F.col("node").alias("b"))
    found = components(confirmed.union(ties))
    named = cut_lineage(classes.join(found, "node", "left").select(*sets, F.coalesce("component", "node").alias("component")))
    rows = every.select("doc_id", "n_shingles", *sets)
    own = looked_up(rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)), named, sets, by="doc_id").select("doc_id", "n_shingles", "component")
    # an empty text of an id that has others belongs to them
    bare = rows.where(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select("doc_id", "n_shingles")
    wanted = bare.select(F.col("doc_id").alias("doc")).distinct()
    elsewhere = own.join(wanted, own["doc_id"] == wanted["doc"], "left_semi").groupBy(F.col("doc_id").alias("doc")).agg(F.min("component").alias("component"))
    rest = bare.join(elsewhere, bare["doc_id"] == elsewhere["doc"], "left").select("doc_id", "n_shingles", F.coalesce("component", F.col("doc_id").cast("long")).alias("component"))
    component = F.col("component")
    return own.unionByName(rest).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_duplicates(documents: DataFrame, found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The documents that ``found`` (doc_id, kept) keeps, columns as before.

    Only documents that a filter of fixed size does not rule out are held against the ids that go.
    """
    gone = cut_lineage(found.where(~F.col("kept")).select(F.col("doc_id").alias(fresh_name("gone", documents.columns))).distinct())
    name = gone.columns[0]
    maybe = sieve(gone)
    suspect = F.coalesce(maybe(F.col(id_column).cast(gone.schema[name].dataType)), F.lit(False))
    flagged = documents.withColumn(fresh_name("suspect", documents.columns), suspect)
    flag = flagged.columns[-1]
    checked = flagged.where(F.col(flag)).join(gone.hint("merge"), F.col(id_column) == F.col(name), "left_anti")
    return flagged.where(~F.col(flag)).unionByName(checked).drop(flag)
