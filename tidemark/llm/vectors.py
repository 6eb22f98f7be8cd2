"""Near duplicates among vectors: spherical k-means cells, blocked cosine products within cells.

Vectors are compared where their labels (and lengths) are equal. A label with many vectors is split into cells by
spherical k-means, fitted on a bounded sample; a vector goes to the cell of its nearest centroid, its home, and
as a guest to every cell whose border is no farther than half the largest distance a link can have. The
middle of two linked vectors lies in some cell, and both are at most half their distance from it, so both
are members there: no link between cells is lost, whatever the centroids are. A pair that meets in
several cells counts in the first of them.

Equal vectors of one Arrow batch travel as one row. A cell of more than ``BLOCK`` rows is dealt in blocks, and each
pair of its blocks is one task's matrix product. A task hands on the number of links of each row and a
spanning forest of the links it found, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage
from .grouped import components, hung_on_least, whole_groups

#: rows of a cell that k-means aims at, cells of all labels together, sampled rows per cell in the fit, rounds of the fit
CELL, CELLS, SAMPLE, ROUNDS = 2_048, 1_024, 32, 8
#: rows of a block, and rows of one product
BLOCK, STRIPE = 4_096, 512
#: added to the border's distance, far above rounding
SLACK = 1e-9


def units(column: pa.Array) -> tuple[list[np.ndarray | None], np.ndarray, list[np.ndarray | None]]:
    """Each row's vector at length one in double precision, which rows have one, and the vectors as they are.

    Null and empty rows, rows with null or non-finite components and zero vectors have none.
    """
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)  # nulls become nan
    out, ok, plain = [None] * len(column), np.zeros(len(column), bool), [None] * len(column)
    valid = np.asarray(column.is_valid())
    for i in np.flatnonzero(valid & (np.diff(offsets) > 0)).tolist():
        v = values[offsets[i] : offsets[i + 1]]
        peak = np.abs(v).max()
        if np.isfinite(peak) and peak > 0:
            plain[i], ok[i] = v, True
            v = v / peak  # squares neither overflow nor vanish
            out[i] = v / np.sqrt(v @ v)
    return out, ok, plain


def normalised(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one in double precision."""
    points = vectors.astype(float)
    points /= np.abs(points).max(axis=1, keepdims=True)
    return points / np.sqrt((points * points).sum(axis=1, keepdims=True))


def label_key(label: Column, vector: Column) -> Column:
    """What two vectors must share to be compared, as text: length and label."""
    return F.concat(F.size(vector).cast("string"), F.lit(":"), label.cast("string"))


def spherical_means(points: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids at length one: distinct points spread over the sample, improved by ``rounds`` of k-means."""
    distinct = np.unique(points, axis=0)
    centroids = distinct[np.random.default_rng(7).permutation(len(distinct))[:count]]
    for _ in range(rounds):
        home = np.concatenate([(points[i : i + STRIPE] @ centroids.T).argmax(axis=1) for i in range(0, len(points), STRIPE)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, points)
        lengths = np.linalg.norm(sums, axis=1)
        moved = lengths > 1e-12
        centroids[moved] = sums[moved] / lengths[moved, None]
    return np.unique(centroids, axis=0)


def fit_cells(source: DataFrame, cell_rows: int, most_cells: int) -> dict[str, np.ndarray]:
    """Centroids of each label with more than ``cell_rows`` vectors, from ``SAMPLE`` rows per cell chosen by hash.

    At most ``most_cells`` cells are made in all, so what comes back has that many rows at most.
    """
    sized = cut_lineage(source.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")))
    total = sized.agg(F.sum("n")).first()[0] or 0
    share = F.least(F.col("n") / cell_rows, F.lit(float(most_cells)) * F.col("n") / F.lit(float(max(total, 1))))
    split = sized.withColumn("cells", F.ceil(share).cast("int")).where(F.col("n") > cell_rows).where("cells > 1").select("key", "cells", (F.col("cells") * SAMPLE / F.col("n")).alias("rate"))
    # a label is split if it has more than its share of one cell, so there are most_cells such labels at most
    chance = F.pmod(F.xxhash64(F.lit("cells"), "vec_id", "vector"), F.lit(1 << 40)) / float(1 << 40)
    sample = source.select("vec_id", "key", "vector").join(F.broadcast(split), "key").where(chance < F.col("rate")).select("key", "cells", "vector")
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("centroid", T.ArrayType(T.DoubleType()))])

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        made, ok, _ = units(table.column("vector").combine_chunks())
        points = np.array([made[i] for i in np.flatnonzero(ok)])
        found = spherical_means(points, table.column("cells")[0].as_py()) if len(points) else np.zeros((0, 1))
        return pa.table({"key": pa.array([key[0].as_py()] * len(found), pa.string()), "centroid": pa.array(found.tolist(), pa.list_(pa.float64()))}, schema=to_arrow_schema(schema))

    cells: dict[str, list] = {}
    for r in sample.groupBy("key").applyInArrow(fit, schema).collect():  # at most most_cells rows
        cells.setdefault(r["key"], []).append(r["centroid"])
    return {key: np.array(sorted(rows)) for key, rows in cells.items()}


def memberships(points: np.ndarray, centroids: np.ndarray | None, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and cells of all members: each row's home and the cells whose border is within ``reach``."""
    if centroids is None:
        return np.arange(len(points)), np.zeros(len(points), int)
    dots = points @ centroids.T
    home = dots.argmax(axis=1)
    between = np.sqrt(np.maximum(2 - 2 * (centroids @ centroids.T), 0))
    near = dots[np.arange(len(points)), home][:, None] - dots <= (reach + SLACK) * between[home] + SLACK
    near[np.arange(len(points)), home] = True
    return np.nonzero(near)


MEMBER = T.StructType(
    [
        T.StructField("key", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("least", T.LongType()),
        T.StructField("copies", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("before", T.ArrayType(T.IntegerType())), T.StructField("held", T.BinaryType()),
    ]
)


def kind_of(source: DataFrame) -> str:
    """The width in which vectors travel: single precision where they have no more."""
    return "<f4" if source.schema["vector"].dataType.elementType == T.FloatType() else "<f8"


def members(source: DataFrame, cells: dict[str, np.ndarray], reach: float) -> DataFrame:
    """A row per vector and cell it is a member of; equal vectors of a batch are one row with all their ids.

    Vectors that link with nothing have a null key. The ids go with a row's first cell; ``before`` lists its earlier ones.
    """
    arrow = to_arrow_schema(MEMBER)
    known = source.sparkSession.sparkContext.broadcast(cells)  # at most CELLS centroids
    kind = kind_of(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            numbers = batch.column(3).to_numpy()
            made, ok, plain = units(batch.column(2))
            groups: dict[str, dict[bytes, list[int]]] = {}
            alone = []
            for i, key in enumerate(keys):
                if key is None or not ok[i]:
                    alone.append(i)
                else:
                    groups.setdefault(key, {}).setdefault(made[i].tobytes(), []).append(i)
            if alone:
                columns = [[None] * len(alone), [-1] * len(alone), numbers[alone], [ids[i] for i in alone], [1] * len(alone), [[ids[i]] for i in alone], [[]] * len(alone), [None] * len(alone)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
            for key, copies in groups.items():
                points = np.array([made[rows[0]] for rows in copies.values()])
                owners = list(copies.values())
                held = [plain[rows[0]].astype(kind).tobytes() for rows in owners]  # as wide as it came
                row, cell = memberships(points, known.value.get(key), reach)
                first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])[np.unique(row, return_inverse=True)[1]]
                lists = [[ids[i] for i in rows] for rows in owners]
                lows = [min((i for i in x if i is not None), default=None) for x in lists]
                columns = [
                    [key] * len(row), cell, [int(numbers[owners[r][0]]) for r in row], [lows[r] for r in row], [len(owners[r]) for r in row],
                    [lists[r] if k == f else None for k, (r, f) in enumerate(zip(row, first))], [cell[f:k].tolist() for k, f in enumerate(first)], [held[r] for r in row],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return source.select("vec_id", "key", "vector", F.monotonically_increasing_id().alias("number")).mapInArrow(run, MEMBER)


NODE = T.StructType([T.StructField("least", T.LongType(), False), T.StructField("row", T.LongType(), False)])
FOUND = T.StructType([T.StructField("node", NODE), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("links", T.LongType()), T.StructField("other", NODE)])


def compared(dealt: DataFrame, cosine: float, kind: str) -> DataFrame:
    """Per row and task its ids (once) and the links found there, and the edges of a spanning forest (node, other)."""
    arrow = to_arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, [0, 1, 2, 3]):
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield from task(table.slice(start, end - start))

    def task(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = {name: table.column(name) for name in table.column_names}
        nobody = np.iinfo(np.int64).max
        least = columns["least"].fill_null(nobody).to_numpy()
        rows, copies, side = columns["row"].to_numpy(), columns["copies"].to_numpy(), columns["side"].to_numpy()
        # copies link with each other; they count once, where the row's ids are
        links, edges = np.where(np.asarray(columns["ids"].is_valid()), copies - 1, 0), []
        keys = columns["key"].combine_chunks().dictionary_encode()
        for code in range(len(keys.dictionary)):  # keys whose hashes are equal are told apart
            own = np.flatnonzero(keys.indices.fill_null(-1).to_numpy() == code)
            points = normalised(np.frombuffer(b"".join(columns["held"].take(pa.array(own)).to_pylist()), kind).reshape(len(own), -1))
            before = columns["before"].take(pa.array(own)).to_pylist()
            left, right = np.flatnonzero(side[own] == 0), np.flatnonzero(side[own] == 1)
            inner = not len(right) and table.column("first")[0].as_py() == table.column("second")[0].as_py()
            if inner:
                right = left
            for i, j in blocked(points, before, left, right, cosine):
                np.add.at(links, own[i], copies[own[j]])
                if not inner:
                    np.add.at(links, own[j], copies[own[i]])
                edges.append(hung_on_least(own[i], own[j]))
        nodes = pa.StructArray.from_arrays([pa.array(least), pa.array(rows)], fields=list(arrow.field("node").type))
        yield pa.RecordBatch.from_arrays([nodes, columns["ids"].combine_chunks(), pa.array(links), pa.nulls(len(rows), arrow.field("other").type)], schema=arrow)
        if edges:
            a, b = (np.concatenate(x) for x in zip(*edges))
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), pa.nulls(len(a), arrow.field("ids").type), pa.nulls(len(a), pa.int64()), nodes.take(pa.array(b))], schema=arrow)

    order = ["group", "cell", "first", "second"]
    columns = [*order, "side", "key", "row", "least", "copies", "ids", "before", "held"]
    return dealt.repartition(*order).sortWithinPartitions(*order).select(*columns).mapInArrow(run, FOUND)


def blocked(points: np.ndarray, before: list[list[int]], left: np.ndarray, right: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (i, j), a stripe of rows at a time; pairs that share an earlier cell and rows themselves are left out."""
    earlier = sorted({c for cells in before for c in cells})
    shared = np.zeros((len(before), len(earlier)), np.float32)
    for i, cells in enumerate(before):
        shared[i, np.searchsorted(earlier, cells)] = 1
    guests = shared.any(axis=1)
    for k in range(0, len(left), STRIPE):
        rows = left[k : k + STRIPE]
        linked = points[rows] @ points[right].T >= cosine
        if left is right:
            linked[np.arange(len(rows)), np.arange(k, k + len(rows))] = False
        a, b = np.flatnonzero(guests[rows]), np.flatnonzero(guests[right])
        if len(a) and len(b):
            linked[np.ix_(a, b)] &= shared[rows[a]] @ shared[right[b]].T == 0
        i, j = np.nonzero(linked)
        yield rows[i], right[j]


def dealt_blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows once per pair of blocks (first <= second) of their cell that they take part in; side 1 is the second block of two."""
    large = sizes.where(F.col("n") > BLOCK).select("key", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(large, ["key", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit("block"), "row"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("block")).alias("first"), F.greatest(o, F.col("block")).alias("second"), (o < F.col("block")).cast("int").alias("side"), (o == F.col("block")).alias("home")),
    )
    spread = placed.withColumn("block", own).withColumn("at", F.explode(pairs)).select("*", "at.*")
    # a row's ids travel with it once; rows that link with nothing are spread by their own number
    group = F.when(F.col("key").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("key"))
    return spread.withColumn("group", group).withColumn("ids", F.when(F.col("home"), F.col("ids")))


def near_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    cosine: float = 0.98, cell_rows: int = CELL, most_cells: int = CELLS,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Two vectors are linked if their labels are equal and not null, their lengths are equal and their cosine in double
    precision is ``cosine`` at least. Null and empty vectors, zero vectors and those with null or non-finite
    components are linked with nothing. ``n_links`` counts other rows, ``component_id`` is the smallest id that links
    reach (its own without links), ``kept`` marks the one with that id. Rows are vectors of their own also where ids
    repeat or are null; a null id is never the smallest of several, alone its component is null and it is
    kept. Every link is found. An empty table gives an empty result.
    """
    vector = F.col(vector_column)
    source = vectors.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"), label_key(F.col(label_column), vector).alias("key"))
    cells = fit_cells(source, cell_rows, most_cells)
    reach = float(np.sqrt(max(1 - cosine, 0) / 2))  # half the chord of two vectors at the least cosine
    rows = members(source, cells, reach)
    sizes = cut_lineage(rows.where("key IS NOT NULL").groupBy("key", "cell").agg(F.count("*").alias("n")))
    found = cut_lineage(compared(dealt_blocks(rows, sizes), cosine, kind_of(source)))
    edges = found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    reached = components(edges)
    own = found.where("other IS NULL")
    totals = own.groupBy("node").agg(F.sum("links").alias("n_links"), F.max("ids").alias("ids"))
    joined = totals.join(reached, "node", "left").select("n_links", F.coalesce("component", "node")["least"].alias("low"), F.explode("ids").alias("vec_id"))
    component = F.when(F.col("low") != F.lit(np.iinfo(np.int64).max), F.col("low"))
    return joined.select("vec_id", "n_links", component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
