"""Near-duplicate candidates by an LSH forest: sorted signature orders, deepened where they are crowded.

A tree of the forest orders signatures by their components, each tree from components of its own. Signatures that share
the first ``DEPTH`` components of an order are a region of it; regions of one member are dropped by counting
before anything is sorted. What is left is sorted by region and by the components that follow.

- A region of at most ``REGION`` members compares all its signatures.
- A larger one is deepened: it is parted by its next component, and each part again, until the parts are small. Over
  the cuts each member is compared with its ``NEIGHBOURS`` next ones in the order, those with the longest
  common prefix. Parts that ``KEY`` further components do not part hold nearly equal signatures: they are searched from
  member to member, which compares a dense part little more than once with its first member.
- Members of crowded regions are sorted in ``FURTHER`` more orders, by other sequences of components, so
  that a pair that is parted in one order meets in others.

Two sets of similarity s share a region of a given depth d in one of t orders with a chance of 1 - (1 - s ** d) ** t. At
the limit of 0.75 that misses 5e-6 of the pairs outside crowded regions, and inside them, at the depth of 8 to which parts
of some thousands of members are deepened, below 1e-4; denser links and links over third documents are missed less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage
from . import linking
from .grouped import components, hung_on_least, whole_groups
from .linking import LIKELY, PERMUTATIONS, search, shared, signatures_of, undirected

#: orders, and the components that members of a region share; orders of members of crowded regions, and components shared there
TREES, DEPTH, FURTHER, FURTHER_DEPTH = 32, 4, 96, 6
#: members of a region that are all compared, components that can part it further, next members that are compared over the cuts
REGION, KEY, NEIGHBOURS = 1_024, 8, 8


def places(order: Column, first: int, count: int) -> list[Column]:
    """Which components stand at places ``first`` .. of an order: runs in the trees, steps of odd length in the further ones."""
    more = order - TREES
    start = F.when(order < TREES, order * DEPTH).otherwise(more * 37)
    step = F.when(order < TREES, F.lit(1)).otherwise(more * 2 + 3)
    return [(start + step * (first + k)) % PERMUTATIONS for k in range(count)]


def components_at(order: Column, first: int, count: int) -> Column:
    """The bytes of these components of ``signature``."""
    return F.concat(*[F.substring(F.col("signature"), (p * 2 + 1).cast("int"), F.lit(2)) for p in places(order, first, count)])


def regions(prints: DataFrame, orders: range, depth: int) -> DataFrame:
    """region, order, node and n, its members, of all that share a region with another of a different ``part``."""
    if depth == DEPTH:  # the trees: runs of components
        each = F.array(*[F.struct(F.lit(t).alias("order"), F.xxhash64(F.lit(t), F.substring("signature", 2 * DEPTH * t + 1, 2 * DEPTH)).alias("region")) for t in orders])
        rows = prints.select("node", "part", F.inline(each))
    else:
        spread = prints.select("node", "part", "signature", F.explode(F.sequence(F.lit(orders.start), F.lit(orders.stop - 1))).alias("order"))
        rows = spread.select("node", "part", "order", F.xxhash64("order", components_at(F.col("order"), 0, depth)).alias("region"))
    sizes = rows.groupBy("region").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("region", "n")
    return shared(rows.drop("part"), cut_lineage(sizes), "region")


def likely_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect representatives which meet in an order and agree in a share of LIKELY at least."""
    prints = classes.select("node", "signature", F.col("node").alias("part"))
    found = in_orders(regions(prints, range(TREES), DEPTH), prints, DEPTH)
    links = found.where("b IS NOT NULL").select("a", "b").union(over_ends(found))
    crowded = found.where("region IS NULL AND b IS NULL").select(F.col("a").alias("node")).distinct()
    if not crowded.isEmpty():
        # what is connected by now need not meet again
        links = cut_lineage(undirected(links))
        few = cut_lineage(prints.drop("part").join(crowded, "node").join(components(links), "node", "left").select("node", "signature", F.coalesce("component", "node").alias("part")))
        more = in_orders(regions(few, range(TREES, TREES + FURTHER), FURTHER_DEPTH), few, FURTHER_DEPTH)
        links = links.union(more.where("b IS NOT NULL").select("a", "b")).union(over_ends(more))
    return undirected(links)


FOUND = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("a", "b", "region")] + [T.StructField("part", T.IntegerType()), T.StructField("last", T.BooleanType()), T.StructField("signature", T.BinaryType())]
)


def in_orders(members: DataFrame, prints: DataFrame, depth: int) -> DataFrame:
    """What the sorted orders show: links (a, b), members of crowded regions (a) and the ends of their slices (region, part, ...).

    Small regions are never cut. A crowded one is dealt by ranges of its order, so a slice fits a task however large it is.
    """
    keyed = members.join(prints.select("node", "signature"), "node").withColumn("key", components_at(F.col("order"), depth, KEY))
    cut = F.when(F.col("n") > REGION, F.col("key"))
    tie = F.when(F.col("n") > REGION, F.xxhash64("node"))  # equal keys may be cut as well
    dealt = keyed.repartitionByRange("region", cut, tie).sortWithinPartitions("region", "key", F.xxhash64("node"))
    arrow = to_arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, [0]):
            nodes, crowded = table.column(1).to_numpy(), table.column(2).to_numpy() > REGION
            prints = signatures_of(table.column(3))
            starts, ends = bounds[:-1], bounds[1:]
            two = (ends - starts == 2) & ~crowded[starts]
            first = starts[two]
            like = (prints[first] == prints[first + 1]).mean(axis=1) >= LIKELY
            # all that a region connects hangs on its least node, which other orders find as well
            pairs = [np.column_stack([nodes[first[like]], nodes[first[like] + 1]])]
            for lo, hi in zip(starts[~two].tolist(), ends[~two].tolist()):
                if not crowded[lo]:
                    pairs.append(stars(nodes[lo:hi], spanning(prints[lo:hi])))
                    continue
                keys = np.frombuffer(b"".join(table.column(4).slice(lo, hi - lo).to_pylist()), ">u2").reshape(hi - lo, KEY)
                pairs.append(stars(nodes[lo:hi], descend(keys, prints[lo:hi])))
                part = TaskContext.get().partitionId()
                region = table.column(0)[lo].as_py()
                rows = [(int(n), None, None, None, None, None) for n in nodes[lo:hi]]
                rows += [(int(nodes[k]), None, region, part, k == hi - 1, prints[k].astype(">u2").tobytes()) for k in dict.fromkeys((lo, hi - 1))]
                if hi - lo == 1:  # one row at both ends
                    rows.append((*rows[-1][:4], False, rows[-1][5]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
            i, j = np.concatenate(pairs).astype(np.int64).T
            if len(i):
                gone = [pa.nulls(len(i), f.type) for f in list(arrow)[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *gone], schema=arrow)

    return cut_lineage(dealt.select("region", "node", "n", "signature", "key").mapInArrow(run, FOUND))


def spanning(prints: np.ndarray) -> np.ndarray:
    """Pairs (parent, member) of a search over all that are alike."""
    parent, _ = search(prints)
    child = np.flatnonzero(parent != np.arange(len(prints)))
    return np.column_stack([parent[child], child])


def stars(nodes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Pairs of places as pairs of nodes, each with the least node that it is connected with."""
    return np.column_stack(hung_on_least(nodes[pairs[:, 0]], nodes[pairs[:, 1]]))


def descend(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Pairs of a crowded region's slice, sorted by ``keys``: small parts as a whole, and neighbours over the cuts."""
    found = []
    for w in range(1, min(NEIGHBOURS, len(prints) - 1) + 1):
        i = np.flatnonzero((prints[:-w] == prints[w:]).mean(axis=1) >= LIKELY)
        found.append(np.column_stack([i, i + w]))
    parts = [(0, len(prints), 0)]
    while parts:
        lo, hi, depth = parts.pop()
        if hi - lo <= REGION or depth == keys.shape[1]:
            found.append(lo + spanning(prints[lo:hi]))
            continue
        edges = lo + np.flatnonzero(np.diff(keys[lo:hi, depth].astype(np.int64))) + 1
        parts += [(a, b, depth + 1) for a, b in zip([lo, *edges.tolist()], [*edges.tolist(), hi]) if b - a > 1]
    return np.concatenate([x.reshape(-1, 2) for x in found]) if found else np.zeros((0, 2), np.int64)


def over_ends(found: DataFrame) -> DataFrame:
    """Links between the last member of a slice and the first of the next; there are two ends per slice at most."""
    ends = found.where("region IS NOT NULL").select("region", "part", "last", F.col("a").alias("node"), "signature")
    order = Window.partitionBy("region").orderBy("part", "last")
    here = F.struct("last", "node", "signature")
    pairs = ends.withColumn("before", F.lag(here).over(order)).where("NOT last AND before.last").select(F.col("before.node").alias("a"), F.col("node").alias("b"), F.col("before.signature").alias("x"), F.col("signature").alias("y"))
    schema = linking.link_schema(T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (signatures_of(pa.chunked_array([batch.column(k)])) for k in (2, 3))
                like = pa.array((x == y).mean(axis=1) >= LIKELY)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(like), batch.column(1).filter(like)], ["a", "b"])

    return pairs.mapInArrow(run, schema)


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept; see ``linking.near_duplicates``."""
    return linking.near_duplicates(documents, likely_links, id_column, text_column)


def without_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that are kept, columns as before."""
    return linking.without_duplicates(documents, near_duplicates(documents, id_column, text_column), id_column)
