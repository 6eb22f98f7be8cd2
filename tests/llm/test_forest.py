import random

import numpy as np
import pytest
from plain import shingles

from tidemark.llm import bands, forest, linking
from tidemark.llm.grouped import components, fresh_name, looked_up
from tidemark.llm.sieve import sieve
from tidemark.llm.queries import QUERIES


def plain(rows):
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = []
    for d, t in rows:
        if d is None:
            continue
        own = shingles(t)
        for e, other in seen:
            shared = len(own & other)
            if own and 100 * shared >= 75 * (len(own) + len(other) - shared):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
        seen.append((d, own))
    return {d: root(d) for d in parent}


def compare(found, rows):
    want = plain(rows)
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def edited(n, edits, base=300, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(base)]
    rows = [(0, " ".join(words))]
    for i in range(1, n):
        w = list(words)
        for _ in range(edits):
            w[rng.randrange(base)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    return rows


def test_query_against_plain_python(spark, folder, texts):
    compare(QUERIES["op7_lsh_forest_near_duplicates"](spark, folder).collect(), texts)


def test_edges_and_star(frame):
    rows = edited(120, 8) + [(1000, None), (1001, ""), (1002, " "), (1003, "a b"), (1004, "A b"), (None, "a b"), (1005, "q r s t u v"), (1005, "a b"), (3, "z")]
    compare(forest.near_duplicates(frame(rows)).collect(), rows)


def test_large_clusters_in_blocks(frame, monkeypatch):
    monkeypatch.setattr(linking, "CLUSTER_SHINGLES", 5000)
    compare(forest.near_duplicates(frame(edited(120, 8))).collect(), edited(120, 8))
    without_hub = [r for r in edited(120, 7) if r[0]]  # no member is near all others: strays meet every block
    compare(forest.near_duplicates(frame(without_hub)).collect(), without_hub)


def test_empty_table_and_filter(frame):
    assert forest.near_duplicates(frame([])).collect() == []
    rows = [(2, "a b c d e f"), (1, "A b c d e f"), (3, None), (4, None), (None, "a b c d e f")]
    kept = forest.without_duplicates(frame(rows))
    assert kept.columns == frame(rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "None"]


def test_spanning_forest_joins_what_is_likely():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 60_000, 128).astype(np.uint16)
    b = a.copy()
    b[:20] = 0
    other = rng.integers(0, 60_000, 128).astype(np.uint16)
    assert bands.spanning_forest(np.stack([a, other, b])) == [(0, 2)]
    assert forest.spanning(np.stack([a, other, b])).tolist() == [[0, 2]]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def signature_table(spark, rows):
    return spark.createDataFrame([(i, bytearray(r.astype(">u2").tobytes())) for i, r in enumerate(rows)], "node long, signature binary")


def chains(seed, count=3, length=40, template=64, changed=32):
    """Signatures that differ step by step; the rest of each is a template's, so that regions are crowded."""
    rng, rows = np.random.default_rng(seed), []
    for _ in range(count):
        row = np.concatenate([np.arange(template), rng.integers(0, 60_000, 128 - template)]).astype(np.uint16)
        for _ in range(length):
            row = row.copy()
            row[template + rng.permutation(128 - template)[:changed]] = rng.integers(0, 60_000, changed)
            rows.append(row)
    return rows


def joined(rows, limit):
    parent = list(range(len(rows)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    edges = [(i, j) for j in range(len(rows)) for i in range(j) if (rows[i] == rows[j]).mean() >= limit]
    for i, j in edges:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    return edges, {i: root(i) for i in range(len(rows))}


@pytest.mark.parametrize("task", [8, 50, 1000])
def test_crowded_buckets_leave_no_pair_out(spark, monkeypatch, task):
    monkeypatch.setattr(bands, "BUCKET", 6)
    monkeypatch.setattr(bands, "BLOCK", task)
    rows = chains(3)
    found = {r["node"]: r["component"] for r in components(bands.likely_links(signature_table(spark, rows))).collect()}
    assert {i: found.get(i, i) for i in range(len(rows))} == joined(rows, linking.LIKELY)[1]


@pytest.mark.parametrize("region,partitions", [(4, 4), (16, 9), (1024, 4)])
def test_crowded_regions_are_deepened(spark, monkeypatch, region, partitions):
    """Pairs at the limit in regions that are far too crowded: nearly all of them end up connected."""
    monkeypatch.setattr(forest, "REGION", region)
    rows = [r for k in range(4) for r in chains(k, count=4, length=30, template=80, changed=16)]
    edges, _ = joined(rows, 0.75)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = forest.likely_links(signature_table(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = joined(rows, linking.LIKELY)[1]
    assert all(whole[r["a"]] == whole[r["b"]] for r in links)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        a, b = sorted((root(r["a"]), root(r["b"])))
        parent[b] = a
    met = sum(root(i) == root(j) for i, j in edges)
    assert len(edges) > 300 and met >= 0.99 * len(edges)


def test_equal_signatures_in_many_slices(spark, monkeypatch):
    """A region that nothing parts, dealt over several tasks, is one component."""
    monkeypatch.setattr(forest, "REGION", 10)
    monkeypatch.setattr(forest, "FURTHER", 1)
    row = np.random.default_rng(1).integers(0, 60_000, 128).astype(np.uint16)
    rows = [row] * 400
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components(forest.likely_links(signature_table(spark, rows))).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["component"] for r in found} == {0} and len(found) == 400


def test_whole_operator_with_small_regions(frame, monkeypatch):
    monkeypatch.setattr(forest, "REGION", 5)
    rows = edited(150, 9) + [(1000 + d, t) for d, t in edited(80, 12, seed=8)]
    compare(forest.near_duplicates(frame(rows)).collect(), rows)


def test_recall_on_a_larger_table(spark):
    """All links of the band join, which leaves out none that shares a band, are found in the orders too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, two = (sorted(map(tuple, f.select("doc_id", "component_id").collect())) for f in (forest.near_duplicates(docs), linking.near_duplicates(docs, bands.likely_links)))
    assert sum(a == b for a, b in zip(one, two)) >= 0.99 * len(one)


def test_sieve_lets_all_keys_through(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    passes = sieve(keys, bits=1 << 14)
    rows = spark.range(3000).selectExpr("id", "IF(id < 2990, id, NULL) AS x")
    found = {r["id"] for r in rows.where(passes(rows["x"])).collect()}
    assert {k for k in range(0, 2990, 3)} <= found and not {2990, 2991, 2999} & found
    assert len(found) < 1500
    assert rows.where(sieve(keys.limit(0))(rows["x"])).count() == 0


def test_looked_up_deals_hot_keys(spark):
    rows = spark.createDataFrame([(1, i, 0) for i in range(500)] + [(2, 0, 0), (3, 1, 0), (None, 1, 0)], "k long, id long, _salt int")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "k long, v string")
    found = looked_up(rows, table, ["k"], by="id")
    assert found.columns == ["k", "id", "_salt", "v"]
    assert sorted((r["k"] or 0, r["v"] or "") for r in found.collect()) == sorted([(1, "a")] * 500 + [(2, "b"), (3, ""), (0, "")])
    assert fresh_name("a", ["_A", "__a", "b"]) == "___a"
