import collections

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language
from tidemark.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op6_language_bitmasks"](spark, folder)
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 250 and found.count() == 1000
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def training(frame):
    rows = [(i, t) for i, t in enumerate(["the quick brown fox and the dog", "der schnelle braune fuchs und der hund"] * 30)]
    return frame(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))


def test_edges(frame):
    table = training(frame)
    model = language.fit(table, training=F.lit(True))
    assert model.languages == ("de", "en")
    rows = [(1, "the dog"), (1, "the dog"), (2, None), (3, ""), (4, "123 !? \x00"), (None, "der Hund"), (5, "DER HUND " * 5000), (6, "日本")]
    found = language.predict(frame(rows), model).collect()
    got = sorted((str(r["doc_id"]), r["lang_pred"]) for r in found)
    assert got == sorted([("1", "en"), ("1", "en"), ("2", "und"), ("3", "und"), ("4", "und"), ("None", "de"), ("5", "de"), ("6", "de")])
    assert {r["score"] for r in found if r["lang_pred"] == "und"} == {0.0}
    assert language.predict(frame([]), model).collect() == []


def test_no_training_rows(frame):
    table = training(frame)
    model = language.fit(table, training=F.lit(False))
    assert model.languages == ()
    assert {r["lang_pred"] for r in language.predict(table, model).collect()} == {"und"}


def test_false_positives_are_corrected(frame):
    model = language.fit(training(frame), training=F.lit(True), slots=64)  # far too small: most n-grams seem known
    assert model.false_positive_rate().min() > 0.01
    found = language.predict(frame([(1, "the quick brown fox"), (2, "der braune hund")]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == {1: "en", 2: "de"}


def plain_grams(text, width=3):
    """Runs of letters in lower case with one blank around and between them; n-grams with a blank inside are left out."""
    spaced = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(spaced.split()) + " "
    return [g for i in range(len(padded) - width + 1) if " " not in (g := padded[i : i + width])[1:-1] and g.strip()]


def test_masks_hold_the_exact_sets(spark, folder, documents):
    """Shares of known n-grams against exact sets per language, built from the same training rows in plain Python."""
    test = language.held_out(F.col("doc_id"))
    model = language.fit(documents, training=~test, sample_rows=1 << 40)  # no row is left out of the fit
    rows = documents.select("doc_id", "text", "lang", test.alias("held_out")).collect()
    uses, docs, found = {}, {}, {}
    for r in rows:
        if not r["held_out"] and r["lang"] is not None and r["text"] is not None:
            grams = plain_grams(r["text"])
            uses.setdefault(r["lang"], collections.Counter()).update(grams)
            docs.setdefault(r["lang"], collections.Counter()).update(set(grams))
            found[r["lang"]] = found.get(r["lang"], 0) + 1
    assert model.languages == tuple(sorted(found))
    total = {k: sum(c.values()) for k, c in uses.items()}
    most = {g: max(uses[k][g] / total[k] for k in uses) for k in uses for g in uses[k]}
    known = {k: {g for g, n in uses[k].items() if docs[k][g] >= max(min(2, found[k]), 0.003 * found[k]) and n / total[k] >= 0.25 * most[g]} for k in uses}
    rates = model.false_positive_rate()
    assert rates.max() < 0.001
    for r in rows[:120]:
        grams = plain_grams(r["text"] or "")
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        hashes, row, has_letter = language.ngrams(data, np.array([0, len(data)]), 3)
        assert len(hashes) == len(grams) and bool(has_letter[0]) == any(c.isalpha() for c in r["text"] or "")
        if grams:
            share = language.shares(model, hashes, row, 1, rates)[0]
            want = [sum(g in known[k] for g in grams) / len(grams) for k in model.languages]
            assert np.abs(share - want).max() < 0.01
