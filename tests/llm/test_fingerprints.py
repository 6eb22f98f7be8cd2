import hashlib
import itertools

import pytest
from plain import jaccard, shingles

from tidemark.llm import fingerprints
from tidemark.llm.queries import QUERIES


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out[doc] = (text, text[: len(text) - half] + following[:half], following)
    return out


def compare(found, rows):
    plain = expected(rows)
    assert len(found) == len(rows)
    for r in found:
        text, new, following = plain[r["doc_id"]]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert abs(r["near_edited"] - jaccard(shingles(text), shingles(new))) < 0.25
        assert abs(r["near_next"] - jaccard(shingles(text), shingles(following))) < 0.25


def test_query_against_plain_python(spark, folder, texts):
    compare(QUERIES["op1_minhash_fingerprints"](spark, folder).collect(), texts)


def test_nulls_empty_texts_and_order(frame):
    rows = [(3 * k, t) for k, t in enumerate(["a b c d e f", "", "x", "é ü 日本 c d e", None, "a b c d e f"])] + [(None, "zz top")]
    found = fingerprints.edit_report(frame(rows)).collect()
    compare(found, rows)
    prints = {r["doc_id"]: r["fingerprint"] for r in found}
    assert prints[0] == prints[15] != prints[6] and prints[3] == prints[12]


@pytest.mark.parametrize("rows", [[], [(1, "only one")], [(1, "a"), (1, "a"), (1, "b")]])
def test_small_tables(frame, rows):
    found = fingerprints.edit_report(frame(rows)).collect()
    assert sorted(r["n_chars"] for r in found) == sorted(len(t) for _, t in rows)


def test_query_links_near_documents(spark, folder, texts):
    sets, label = {d: shingles(t) for d, t in texts}, {d: d for d, _ in texts}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {d: low if x == high else x for d, x in label.items()}
    found = {r["doc_id"]: (r["class_id"], r["n_linked"]) for r in QUERIES["op1_minhash_fingerprints"](spark, folder).collect()}
    members = list(label.values())
    assert found == {d: (x, members.count(x) - 1) for d, x in label.items()}
    assert any(n for _, n in found.values())


def test_whole_query_on_odd_rows(spark, frame, tmp_path):
    """Nulls, repeated ids and rows, an empty text and columns in the way; every row comes back once."""
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (None, text), (None, None), (5, "a b"), (5, "c d"), (6, text + "eleven twelve")]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op1_minhash_fingerprints"](spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in found) == sorted((str(d), len(t or "")) for d, t in rows)
    classes = {r["doc_id"]: (r["class_id"], r["n_linked"]) for r in found}
    assert classes == {1: (1, 2), 2: (1, 2), 3: (3, 0), 4: (4, 0), None: (None, None), 5: (5, 0), 6: (1, 2)}
    frame([]).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op1_minhash_fingerprints"](spark, f"{tmp_path}/none").collect() == []
