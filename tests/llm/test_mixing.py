import itertools

import numpy as np
import pytest
from plain import words
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.queries import QUERIES


def levels(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = dict(zip(order, itertools.cycle([3, 1, 2])))
    target, free = {}, set(order)
    budget = 1.5 * sum(sizes.values())
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
    return target | {s: level * weight[s] for s in free}


def test_query_against_plain_python(spark, folder, documents):
    rows = {r["doc_id"]: r for r in documents.collect()}
    found = QUERIES["op4_subset_sum_mixing"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(rows)
    sizes, taken, target = {}, {}, {}
    for r in found:
        source = rows[r["doc_id"]]["source"]
        assert r["size"] == len(words(rows[r["doc_id"]]["text"])) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[source] = sizes.get(source, 0) + r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
        target[source] = r["target"]
    assert all(r["source_size"] == sizes[rows[r["doc_id"]]["source"]] for r in found)
    assert target == pytest.approx(levels(sizes))
    # a source of some ten documents has few sums; the largest size is as far as the fit can be off
    largest = {s: max(r["size"] for r in found if rows[r["doc_id"]]["source"] == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    again = QUERIES["op4_subset_sum_mixing"](spark, folder).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


@pytest.mark.parametrize("seed", range(40))
def test_choice_is_the_nearest_sum(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(1, 30, rng.integers(1, 6)))
    counts = rng.integers(0, 4, len(sizes))
    budget = int(rng.integers(0, (sizes * counts).sum() + 5))
    taken = mixing.choose(sizes, counts, budget)
    sums = {sum(a * n for a, n in zip(sizes, pick)) for pick in itertools.product(*[range(n + 1) for n in counts])}
    assert (taken >= 0).all() and (taken <= counts).all()
    assert abs(budget - (sizes * taken).sum()) == min(abs(budget - s) for s in sums)


def test_large_budgets_stay_near():
    rng = np.random.default_rng(1)
    sizes, counts = np.arange(1, 3000), rng.integers(0, 9, 2999)
    budget = int((sizes * counts).sum() // 3)
    assert abs((sizes * mixing.choose(sizes, counts, budget)).sum() - budget) <= 1


def sourced(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string, n int")
    for name in ("_text_key", "_id", "_key", "_source", "_copies", "_copy"):
        table = table.withColumn(name, F.lit("x"))
    return table


def test_edges(spark):
    rows = [(1, "a b", None), (1, "a b", None), (None, "x y z", "s"), (2, None, "s"), (3, "", "t")]
    found = mixing.mix(sourced(spark, [(*r, 9, "x", 1) for r in rows])).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"], r["taken"]) for r in found) == [("1", 2, 4, 2), ("1", 2, 4, 2), ("2", 0, 3, 0), ("3", 0, 0, 0), ("None", 3, 3, 6)]
    assert mixing.mix(sourced(spark, [])).collect() == []


def test_many_documents_of_one_size_are_ranked_exactly(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 7)
    rows = [(i, "a b", "s" if i < 90 else "t", 0, "", 0) for i in range(100)]
    found = mixing.mix(sourced(spark, rows)).collect()
    taken = {r["doc_id"]: r["taken"] for r in found}
    assert abs(sum(taken[i] for i in range(90)) - next(r["target"] for r in found if r["doc_id"] == 0)) <= 1


def test_mixed_documents(spark):
    rows = [(i, "a b c", "s" if i < 8 else "t", 0, "", 0) for i in range(12)]
    table = sourced(spark, rows)
    planned = {r["doc_id"]: r["taken"] // 3 for r in mixing.mix(table).collect()}
    mixed = mixing.mixed(table)
    assert mixed.columns == table.columns
    got = [r["doc_id"] for r in mixed.collect()]
    assert {d: got.count(d) for d in planned} == planned
