import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import vectors

SCHEMA = "vec_id long, embedding array<double>, label string"


def unit(v):
    if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
        return None
    v = np.array(v, float) / max(abs(x) for x in v)
    return v / np.sqrt(v @ v)


def plain(rows, cosine=0.98):
    made = [unit(v) for _, v, _ in rows]
    linked = lambda i, j: i != j and made[i] is not None and made[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(made[i]) == len(made[j]) and made[i] @ made[j] >= cosine
    near = [[j for j in range(len(rows)) if linked(i, j)] for i in range(len(rows))]
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, queue = {i}, [i]
        while queue:
            for j in near[queue.pop()]:
                if j not in seen:
                    seen.add(j)
                    queue.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec_id, len(near[i]), low, vec_id == low))
    return sorted(out, key=str)


def found(spark, rows, partitions=3, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    for name in ("key", "row", "ids", "cell", "node", "links", "unit", "vector", "least", "number", "group", "_id"):
        frame = frame.withColumn(name, F.lit("x"))
    result = vectors.near_vectors(frame, **options)
    assert result.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in result.collect()), key=str)


def clumps(n, dim, seed, spread=0.12):
    """Clumps whose members are about as far apart as a link may be, chains, and lone vectors."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        center = rng.normal(size=dim)
        for _ in range(rng.integers(1, 12)):
            v = center + rng.normal(size=dim) * spread
            rows.append((len(rows) * 7 % 1009, v.tolist(), "ab"[k % 2]))
    return rows


@pytest.mark.parametrize("cell_rows,block", [(2_048, 4_096), (10, 4_096), (25, 7), (1_000, 16)])
@pytest.mark.parametrize("dim", [3, 24])
def test_every_link_is_found(spark, monkeypatch, cell_rows, block, dim):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "STRIPE", 5)
    rows = clumps(40, dim, 3)
    want = plain(rows)
    assert sum(r[1] for r in want) > 50
    assert found(spark, rows, cell_rows=cell_rows) == want


def test_odd_rows(spark):
    rows = [
        (1, None, "a"), (2, [], "a"), (3, [0.0, 0.0], "a"), (4, [1.0, None], "a"), (5, [float("nan"), 1.0], "a"), (6, [float("inf"), 1.0], "a"), (7, [1.0, 0.0], None), (8, [1.0, 0.0], None),
        (9, [1.0, 0.0], "a"), (10, [5.0, 0.1], "a"), (11, [1.0, 0.0], "b"), (12, [1.0, 0.0, 0.0], "a"), (9, [1.0, 0.0], "a"), (13, [1e300, 0.0], "a"), (14, [1e-300, 0.0], "a"),
        (None, [0.0, 1.0], "c"), (None, [1.0, 0.0], "b"), (None, None, None), (15, [-1.0, 0.0], "a"),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, partitions=1) == plain(rows)
    assert found(spark, []) == []


def test_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rows = [(i, [1.0, 2.0, 3.0], "a") for i in range(300)] + [(1_000 + i, [1.0, 2.0, 3.0 + i / 50], "a") for i in range(20)]
    assert found(spark, rows, partitions=7, cell_rows=20) == plain(rows)


def test_single_precision_gives_the_same_links(spark):
    rows = [(i, np.array(v, np.float32).astype(float).tolist(), label) for i, v, label in clumps(30, 16, 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(3)
    assert vectors.kind_of(frame.withColumnRenamed("embedding", "vector")) == "<f4"
    assert sorted((tuple(r) for r in vectors.near_vectors(frame, cell_rows=20).collect()), key=str) == plain(rows)


def test_means_are_unit_vectors_and_spread():
    rng = np.random.default_rng(1)
    points = np.repeat(np.eye(5), 20, axis=0) + rng.normal(size=(100, 5)) * 0.01
    points /= np.linalg.norm(points, axis=1)[:, None]
    centers = vectors.spherical_means(points, 5)
    assert np.allclose(np.linalg.norm(centers, axis=1), 1)
    row, cell = vectors.memberships(points, vectors.spherical_means(points, 1), 0.1)
    assert (row == np.arange(100)).all() and not cell.any()
