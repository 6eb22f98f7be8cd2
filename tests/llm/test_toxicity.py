import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.queries import QUERIES


def test_marginals_equal_the_plain_recursion():
    rng = np.random.default_rng(0)
    scores, bounds, moves = rng.normal(size=900), np.array([0, 3, 3, 10, 500, 900]), rng.normal(size=(2, 2))
    p, expected = toxicity.marginals(scores, bounds, moves)
    move, want, counts = np.exp(moves), [], np.zeros((2, 2))
    for a, b in zip(bounds[:-1], bounds[1:]):
        if a == b:
            continue
        own = np.stack([np.ones(b - a), np.exp(scores[a:b])], axis=1)
        forward, backward = [own[0] / own[0].sum()], [np.ones(2)]
        for t in range(1, b - a):
            x = (forward[-1] @ move) * own[t]
            forward.append(x / x.sum())
        for t in range(b - a - 1, 0, -1):
            x = move @ (own[t] * backward[0])
            backward.insert(0, x / x.sum())
        for t in range(b - a):
            x = forward[t] * backward[t]
            want.append(x[1] / x.sum())
        for t in range(1, b - a):
            x = forward[t - 1][:, None] * move * (own[t] * backward[t])[None]
            counts += x / x.sum()
    assert np.allclose(p, want) and np.allclose(expected, counts)


@pytest.fixture(scope="module")
def field(spark):
    rng = random.Random(4)
    common = [a + b for a in "bcdfglmnprst" for b in ("a", "eli", "oru", "ipo", "undo")] + ["nice", "day", "you", "hey"]
    insults = ["clown", "loser", "idiot", "moron"]
    rows = [(i, " ".join(rng.choice(insults) if i % 3 == 0 and k % 9 == 4 else rng.choice(common) for k in range(40))) for i in range(600)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = documents.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    return toxicity.fit(documents, labels, training=F.lit(True))


def test_scores_spans_and_edges(field, frame):
    rows = [(1, "hey, Clown! you LOSER"), (1, "hey, Clown! you LOSER"), (2, "a nice day"), (3, None), (4, ""), (5, "12 !!"), (None, "é clown"), (6, "a nice day " * 20_000)]
    found = toxicity.score(frame(rows), field).collect()
    assert len(found) == len(rows)
    score = {str(r["doc_id"]): r["score"] for r in found}
    assert score["1"] > 0.7 and score["None"] > 0.7 and max(score[k] for k in "23456") < 0.5
    spans = {str(r["doc_id"]): r["spans"] for r in found}
    assert spans["1"] == "5:10,16:21" and spans["None"] == "2:7" and spans["2"] == ""
    assert toxicity.score(frame([]), field).collect() == []
    kept = toxicity.without_toxic(frame(rows), field)
    assert kept.columns == frame(rows).columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 6]


def test_labels_of_one_class_or_none(spark, frame):
    documents = frame([(i, f"some text {i}") for i in range(6)])
    for rows in ([], [(1, 0), (2, 0)], [(1, 1), (None, 1), (2, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        found = toxicity.score(documents, toxicity.fit(documents, labels, training=F.lit(True))).collect()
        assert all(0 <= r["score"] <= 1 for r in found)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    found = QUERIES["op10_toxic_spans"](spark, folder)
    rows = found.where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    caught = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert len(rows) > 1000
    assert sum(r["predicted"] for r in caught) / len(caught) > 0.9 and sum(r["predicted"] for r in clean) / len(clean) < 0.02


def test_rare_toxic_words_are_learned(spark):
    rng = random.Random(7)
    common, rare = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"], ["zz" + a + b for a in "abcdefg" for b in "aeiou"]
    text = lambda *more: " ".join([*rng.choices(common, k=30), *more])
    rows = [(text(), 0) for _ in range(2000)] + [(text(rare[k % len(rare)]), 1) for k in range(3 * len(rare))]
    words, toxic = toxicity.vocabulary_of(spark.createDataFrame(rows, "text string, toxic int"))
    found = toxicity.words_of(np.frombuffer(" ".join(rare).encode(), np.uint8), np.array([0, len(" ".join(rare))])).hashes
    assert set(found.tolist()) <= set(words[toxic].tolist()) and toxic.sum() <= 1.2 * len(rare)


def test_stems_of_many_different_words_are_learned(spark):
    """No toxic word is frequent, but their beginning is; a clean document that uses it once is no toxic one."""
    rng = random.Random(5)
    parts = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "io", "un")]
    word = lambda start="": start + "".join(rng.choice(parts) for _ in range(3))
    clean = [" ".join(word() for _ in range(60)) + (f" {word('grubo')}" if k % 12 == 0 else "") for k in range(900)]
    toxic = [" ".join(word("grubo") if j % 15 == 3 else word() for j in range(60)) for k in range(90)]
    rows = [(k, t, int(k >= 900)) for k, t in enumerate(clean + toxic)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    field = toxicity.fit(documents, documents.select("doc_id", "toxic"), training=F.col("doc_id") % 5 != 0)
    assert len(field.stems.hashes) > 0
    judged = toxicity.score(documents.where("doc_id % 5 = 0"), field, keep=["toxic"]).collect()
    assert sum(r["score"] >= 0.7 for r in judged if r["toxic"]) >= 0.9 * sum(r["toxic"] for r in judged)
    assert sum(r["score"] >= 0.7 for r in judged if not r["toxic"]) <= 0.02 * len(judged)
    data = "a grubozz béa grub x grubo".encode()
    words = toxicity.words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]), field.stems)
    assert words.hashes[1] == words.hashes[5] and words.hashes[1] in field.stems.hashes and len(set(words.hashes.tolist())) >= 4


def test_names_in_the_way(frame, field):
    table = frame([(1, "hey Clown loser"), (2, "a nice day")]).withColumn("_judged_score", F.lit(0.0)).withColumn("_judged_spans", F.lit(""))
    kept = toxicity.without_toxic(table, field)
    assert kept.columns == table.columns and [r["doc_id"] for r in kept.collect()] == [2]
