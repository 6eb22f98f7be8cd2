import collections
import hashlib
import random

import numpy as np
from plain import counted

from tidemark.llm import repeats, suffixes
from tidemark.llm.queries import QUERIES


def plain(rows, width=100):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            string = data[i : i + width]
            if string in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(string)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for i in range(len(data)) if gone[i] and not (i and gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def rows_with_repeats():
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["a", "b", "é", "abcdefghijé", "c\n", "  d"]) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    return rows + [(None, "abcdefghijé"), (5, "abcdefghijé"), (5, "abcdefghijé"), (6, None), (7, ""), (8, "ab" * 3000)]


def test_query_against_plain_python(spark, folder, texts):
    assert counted(QUERIES["op2_suffix_array_dedup"](spark, folder).collect()) == plain(texts)


def test_edges(frame):
    rows = rows_with_repeats()
    assert counted(suffixes.remove_repeats(frame(rows), width=9, kmer=4).collect()) == plain(rows, 9)


def test_crowded_minimisers_and_many_buckets(frame, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 700)
    rows = rows_with_repeats()
    assert counted(suffixes.remove_repeats(frame(rows), width=9, kmer=4, crowded=2).collect()) == plain(rows, 9)


def test_empty_table(frame):
    assert suffixes.remove_repeats(frame([])).collect() == []


def test_sort_is_by_content():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 400, dtype=np.uint8)
    start = np.sort(rng.permutation(380)[:150])
    group = np.sort(rng.integers(0, 4, 150))
    order = suffixes.Suffixes(text, 12).sort(start, group)
    key = lambda i: (group[i], text[start[i] : start[i] + 12].tobytes(), i)
    assert order.tolist() == sorted(range(150), key=key)


def test_collisions_do_not_pass(monkeypatch):
    text = np.frombuffer(b"abcdeabcdfabcde", np.uint8)
    monkeypatch.setattr(suffixes.Suffixes, "same", lambda self, a, b, length: np.ones(len(a), bool))
    marks = suffixes.repeated_suffixes(text, np.array([0, 5, 10]), np.zeros(3, int), 5)
    assert marks.tolist() == [False, False, True]
