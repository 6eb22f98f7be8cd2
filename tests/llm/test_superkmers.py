import collections
import hashlib
import random

from plain import counted, words

from tidemark.llm import repeats, superkmers
from tidemark.llm.queries import QUERIES


def plain(rows, width=35):
    every = [words(t) for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + width]) for w in every for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, every):
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


def rows_with_repeats():
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, " ".join(rng.choice(["a", "b", "é", passage, "c\n", "  d"]) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    return rows + [(None, passage), (5, passage), (5, passage), (6, None), (7, ""), (8, "w " * 3000)]


def test_query_against_plain_python(spark, folder, texts):
    assert counted(QUERIES["op9_super_kmer_dedup"](spark, folder).collect()) == plain(texts)


def test_edges(frame):
    rows = rows_with_repeats()
    assert counted(superkmers.remove_repeats(frame(rows), width=6, kmer=3).collect()) == plain(rows, 6)


def test_crowded_minimisers_and_many_buckets(frame, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 1500)
    rows = rows_with_repeats()
    assert counted(superkmers.remove_repeats(frame(rows), width=6, kmer=3, crowded=2).collect()) == plain(rows, 6)


def test_empty_table(frame):
    assert superkmers.remove_repeats(frame([])).collect() == []


def test_texts_are_shuffled_once(spark, folder):
    frame = QUERIES["op9_super_kmer_dedup"](spark, folder)
    frame.collect()
    assert frame._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 2
