import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from plain import lowered
from pyspark.sql import functions as F

from tidemark.llm import importance


def grams(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return [zlib.crc32(x.encode()) for x in runs], len(words)


def plain(rows, targets, longest=1, buckets=10_000, percent=10, least_words=20, seed=2024):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(g % buckets for g in grams(text, longest)[0])
    for text in targets:
        t.update(g % buckets for g in grams(text, longest)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for d, text in rows:
        found, words = grams(text, longest)
        weight = sum(gain(g % buckets) for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = able[: len(able) * percent // 100]
    ranks = {}
    for k, r in enumerate(drawn):
        ranks.setdefault(r, []).append(k + 1)
    taken = Counter()
    result = []
    for r in out:
        k = taken[r]
        taken[r] += 1
        result.append((*r[:4], ranks[r][k] if k < len(ranks.get(r, [])) else None))
    return sorted(result, key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 50)])
def test_against_plain_python(spark, folder, documents, texts, longest, buckets):
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    targets = [r["text"] for r in benchmark.collect()]
    assert rows_of(importance.resample(documents, benchmark, longest=longest, buckets=buckets)) == plain(texts, targets, longest, buckets)


ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "A b-c D9 É é\x00ñ x y!"), (4, "other words"), (None, "one two three"), (5, "word " * 30), (5, "word " * 30), (6, "word " * 30),
    (7, "x" * 300_000 + " tail"), (8, "...a,b...c;"), (None, None),
]


def test_nulls_ties_and_repeated_rows(spark, frame):
    target = spark.createDataFrame([("word word É", 1), (None, 2)], "text string, score int")
    found = importance.resample(frame(ODD), target, percent=50, least_words=2)
    assert rows_of(found) == plain(ODD, ["word word É", None], percent=50, least_words=2)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_empty_tables(spark, frame):
    empty = spark.createDataFrame([], "text string")
    assert importance.resample(frame([]), empty).collect() == []
    assert rows_of(importance.resample(frame(ODD), empty)) == plain(ODD, [])


def test_result_does_not_depend_on_partitions(frame):
    rows = [(i, f"w{i % 7} w{i % 3} " * 15) for i in range(200)]
    target = frame([(0, "w1 w2 w2")])
    assert rows_of(importance.resample(frame(rows, 1), target)) == rows_of(importance.resample(frame(rows, 7), target)) == plain(rows, ["w1 w2 w2"])


def test_runs_stay_inside_a_text():
    bucket, row, words = importance.buckets_of(pa.array(["a b", None, "c", "a b a b"]), 2, 1 << 40)
    spelled = [[b"a", b"b", b"a b"], [], [b"c"], [b"a", b"b", b"a", b"b", b"a b", b"b a", b"a b"]]
    for k, want in enumerate(spelled):
        assert sorted(bucket[row == k].tolist()) == sorted(zlib.crc32(x) for x in want)
    assert words.tolist() == [2, 0, 1, 4]
    assert importance.gains(np.zeros(4, int), np.zeros(4, int)).tolist() == [0] * 4


def test_noise_of_a_null_id(spark):
    found = spark.range(1).select(importance.noise(F.lit(None).cast("long"), 1).alias("x")).first()["x"]
    h = int(hashlib.sha256(b"1:").hexdigest()[:8], 16)
    assert found == math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
