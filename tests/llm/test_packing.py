import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.queries import QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(tokenizer_path())
    made.encode_special_tokens = True
    return made


def check(found, rows, tokenizer, capacity=1024):
    """Every id in one piece, the right ids, gapless windows of at most the capacity."""
    pieces, windows = {}, {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == {d for d, _ in rows}
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows_of in windows.values():
        at = 0
        for r in sorted(rows_of, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return sum(r["length"] for r in found) / (capacity * len(windows))


def test_query_against_tokenizers(spark, folder, texts, tokenizer):
    assert check(QUERIES["op8_karmarkar_karp_packing"](spark, folder).collect(), texts, tokenizer) > 0.97


def test_edges(frame, tokenizer):
    rng = random.Random(1)
    odd = [None, "", " ", "  ", "a", "a ", " a", "\n", "é b", "it's  ok  x <|endoftext|> 日本 語", "x" * 5000, "a b " * 3000]
    odd += ["".join(rng.choice(" ab\n\t.'s1é 日-") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    rows = list(enumerate(odd)) + [(None, "no id")]
    check(packing.pack(frame(rows), tokenizer_path()).collect(), rows, tokenizer)
    twice = packing.pack(frame([(1, "a b"), (1, "a b")]), tokenizer_path()).collect()
    assert len(twice) == 2 and {r["doc_tokens"] for r in twice} == {3}
    assert packing.pack(frame([]), tokenizer_path()).collect() == []


def test_long_texts_in_parts(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "TEXT_BYTES", 300)
    rows = [(i, "é naïve word, other\nwords " * n) for i, n in enumerate([1, 50, 200, 0, 3])] + [(9, "x" * 2000)]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows]), "text": pa.array([r[1] for r in rows])})
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(c, pa.int64()) for c in names])
    made = packing.packed(iter(table.to_batches()), packing.Encoder(tokenizer_path()), 64, 0, schema, 1)
    check(pa.Table.from_batches(made, schema).to_pylist(), rows, tokenizer, 64)


def test_ids_equal_for_all_code_points(tokenizer):
    encode = packing.Encoder(tokenizer_path()).encode
    for start in range(0, 0x110000, 0x4000):
        points = [chr(i) for i in range(start, start + 0x4000, 7) if not 0xD800 <= i <= 0xDFFF]
        texts = [f"a{c}{c}1{c}!{c} {c} b{c} x" for c in points]
        assert [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)] == [encode(t) for t in texts]


def test_chunk_collisions_do_not_pass(monkeypatch, tokenizer):
    encoder = packing.Encoder(tokenizer_path())
    real = packing.span_hashes
    monkeypatch.setattr(packing, "span_hashes", lambda *a: real(*a) & np.uint64(7))
    text = "one two three four five six seven eight nine ten one two".encode()
    ids, _ = encoder.ids(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert ids.tolist() == tokenizer.encode(text.decode(), add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(20))
def test_differencing(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 60))]
    m = rng.randint(1, 12)
    windows, largest = packing.differencing(sizes, m)
    assert len(windows) == m and sorted(i for w in windows for i in w) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) == largest and max(sums) - min(sums) <= max(sizes)
    assert all(sum(sizes[i] for i in w) <= 120 for w in packing.near_equal_windows(sizes, 120))
