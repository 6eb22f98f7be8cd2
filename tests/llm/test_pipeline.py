import collections
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from plain import shingles, words
from pyspark.sql import functions as F
from test_mixing import levels
from test_secrets import BASE, plain
from tokenizers import Tokenizer

from tidemark.llm import toxicity


@pytest.fixture(scope="module")
def tables(spark, folder):
    """The rows that every stage gets, and those of the last one."""
    docs, path = spark.read.parquet(f"{folder}/documents.parquet"), corpus_pipeline.ensure_checkpoint_dir(spark) + "/stages"
    found, columns = [docs], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, found[-1], folder).write.mode("overwrite").parquet(f"{path}/{k}")
        found.append(spark.read.parquet(f"{path}/{k}"))
        assert k == 4 or found[-1].columns == columns, name
    return found


def rows_of(table):
    return sorted(map(tuple, table.collect()), key=lambda r: (r[0], str(r)))


def test_toxic_documents_go_and_others_stay(spark, folder, tables):
    """The field is learned, so it is shared; what is dropped follows from its scores alone."""
    field = toxicity.fit(tables[0], spark.read.parquet(f"{folder}/labels.parquet"), training=~toxicity.held_out(F.col("doc_id")))
    gone = {r["doc_id"] for r in toxicity.score(tables[0], field).where("score >= 0.7").collect()}
    assert rows_of(tables[1]) == [r for r in rows_of(tables[0]) if r[0] not in gone]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    assert len(gone - toxic) <= 0.02 * tables[0].count()


def test_the_first_of_each_near_class_stays(tables):
    before = rows_of(tables[1])
    sets, parent = {r[0]: shingles(r[1]) for r in before}, {r[0]: r[0] for r in before}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    assert rows_of(tables[2]) == [r for r in before if root(r[0]) == r[0]]
    assert len(rows_of(tables[2])) < len(before)


def masked_texts(old_table, new_table):
    """How many texts were masked, after every row has been held against what it was."""
    before, after = ({r[0]: r for r in rows_of(t)} for t in (old_table, new_table))
    columns = old_table.columns
    text, chars = columns.index("text"), columns.index("n_chars")
    assert sorted(before) == sorted(after)
    masked = 0
    for doc, old in before.items():
        new = after[doc]
        assert [x for k, x in enumerate(old) if k not in (text, chars)] == [x for k, x in enumerate(new) if k not in (text, chars)]
        counts, _ = plain(old[text])
        if "[secret]" not in (new[text] or "") or old[text] == new[text]:
            assert old == new and counts == (0, 0, 0)
            continue
        masked += 1
        assert new[chars] == len(new[text])
        # what is left stands in the old text, in order, from its beginning to its end; every base secret is behind a mask
        pieces = new[text].split("[secret]")
        pattern = "(.+?)".join(re.escape(p) for p in pieces)
        hidden = re.fullmatch(pattern, old[text], re.DOTALL)
        assert hidden and old[text].startswith(pieces[0]) and old[text].endswith(pieces[-1])
        for kind, expression in BASE.items():
            for m in expression.finditer(new[text]):
                assert not ((len(m[2]) >= 6) if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24)) or "[secret" in m[0]
    return masked


def test_secrets_are_masked_and_nothing_else(spark, tables):
    masked_texts(tables[2], tables[3])  # this small table may have none
    larger = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert masked_texts(larger, corpus_pipeline.mask_secrets(spark, larger, "")) > 5


def test_sources_come_near_their_targets(tables):
    before, source, text = rows_of(tables[3]), tables[3].columns.index("source"), tables[3].columns.index("text")
    times = collections.Counter(r[0] for r in rows_of(tables[4]))
    whole = {r[0]: r for r in before}
    assert set(times) <= set(whole) and set(rows_of(tables[4])) <= set(before) and max(times.values()) <= 2
    size = {d: len(words(r[text])) for d, r in whole.items()}
    sizes, taken, largest = collections.Counter(), collections.Counter(), {}
    for d, r in whole.items():
        sizes[r[source]] += size[d]
        taken[r[source]] += size[d] * times[d]
        largest[r[source]] = max(largest.get(r[source], 0), size[d])
    target = levels(dict(sizes))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)


def check_packed(found, rows):
    """Pieces of every document as often as it is there: its ids, gapless windows of at most 1024."""
    tokenizer = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    tokenizer.encode_special_tokens = True
    times = collections.Counter(rows)
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    assert set(pieces) == {d for d, _ in times}
    for (doc, text), n in times.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = pieces[doc]
        assert sum(r["length"] for r in own) == n * len(ids) and {r["doc_tokens"] for r in own} == {len(ids)}
        covered = collections.Counter(k for r in own for k in range(r["start"], r["start"] + r["length"]))
        assert covered == {k: n for k in range(len(ids))}
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_windows_hold_every_id_once(tables):
    check_packed(tables[5].collect(), [(r["doc_id"], r["text"]) for r in tables[4].collect()])


def test_run_packs_what_the_stages_leave(spark, folder, tables):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_packed(found.collect(), [(r["doc_id"], r["text"]) for r in tables[4].collect()])
