import random

import numpy as np
import pytest
from helpers import day
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import scoring
from tidemark.plans.features import text_feature_names, text_features
from tidemark.plans.filings import merge_scored, resume, score_filings, score_sections
from tidemark.plans.panels import text_panel


def one(spark, rows, expr, schema="t string"):
    return [r.y for r in spark.createDataFrame([(x,) for x in rows], schema).select(expr.alias("y")).collect()]


def by_runs(text):
    """Each run of whitespace by itself: with a line break one break; a lone odd blank as it is; else a blank."""
    out, run = [], ""
    for c in text.replace("\x00", " ").replace("\r", " ") + "\0":
        if c.isspace():
            run += c
            continue
        if run:
            out.append("\n" if "\n" in run else run if len(run) == 1 and run != "\t" else " ")
            run = ""
        out.append(c)
    return "".join(out[:-1]).strip()


def test_whitespace_runs(spark):
    random.seed(2)
    alphabet = ["a", "b", " ", "\t", "\n", "\r", "\x00", "\x0b", " ", " ", "\x1c", "é"]
    texts = ["".join(random.choices(alphabet, k=random.randrange(14))) for _ in range(3000)]
    assert one(spark, texts, tx.normalize_whitespace("t")) == [by_runs(t) for t in texts]


def test_long_blank_runs_are_linear(spark):
    assert one(spark, ["a" + " " * 300_000 + "b"], tx.normalize_whitespace("t")) == ["a b"]


def test_typography(spark):
    assert one(spark, ["‘a’ “b” c–d—e"], tx.plain_typography("t")) == ["'a' \"b\" c-d-e"]


OPEN = "Item 2. Management’s Discussion and Analysis of Financial Condition and Results of Operations"
CLOSE = "ITEM 3. QUANTITATIVE AND QUALITATIVE DISCLOSURES ABOUT MARKET RISK"


@pytest.mark.parametrize(
    "text, status, length",
    [
        ("nothing here", "section_not_found", None),
        (f"{OPEN} words", "section_end_not_found", None),
        (f"{CLOSE} then {OPEN}", "section_end_not_found", None),
        (f"{OPEN} short {CLOSE} {OPEN} {'long ' * 40}{CLOSE}", "scored", len(OPEN) + 200),
        (f"{OPEN} x {CLOSE} {OPEN} xyz {CLOSE}", "section_too_short", len(OPEN) + 4),
        (f"{OPEN} abc {CLOSE} {OPEN} xyz {CLOSE}", "section_too_short", len(OPEN) + 4),
        ("item 2.\n management's\tDISCUSSION  and analysis of financial condition and results of operations " + "w " * 120 + "Item 4. controls and procedures", "scored", None),
    ],
)
def test_sections(spark, text, status, length):
    s = one(spark, [text], tx.discussion_section("t", F.lit("10-Q"), 200))[0]
    assert (s.status, s.method) == (status, "item2_to_item3_or_item4")
    if length is not None:
        assert len(s.text) == length
    if status == "section_too_short" and "abc" in text:
        assert s.text.endswith("abc")


def test_annual_headings(spark):
    text = "ITEM 7. Management and discussion and analysis " + "w " * 300 + "item 8 financial statements and supplementary data"
    s = one(spark, [text], tx.discussion_section("t", F.lit("10-K")))[0]
    assert (s.status, s.method) == ("scored", "item7_to_item7a_or_item8")
    assert one(spark, [text], tx.discussion_section("t", F.lit("10-Q")))[0].status == "section_not_found"


def test_chunks(spark):
    texts = ["", " ", "a b c", "a b c d", None]
    cut = one(spark, texts, tx.chunks(tx.words("t"), 3))
    assert cut == [[], [], ["a b c"], ["a b c", "d"], None] or cut[:4] == [[], [], ["a b c"], ["a b c", "d"]]
    assert one(spark, texts, tx.chunks(tx.words("t"), 3, max_chunks=1))[3] == ["a b c"]


FILINGS = """ticker string, cik string, company_name string, form_type string, filing_date date, period_end date,
             accession_number string, text_file_path string, text_length bigint, source string, text string"""
LEXICON = scoring.Lexicon(("good",), ("bad",))


def filing(n, text, form="10-Q", at=None):
    return ("a", "1", "A", form, day(n if at is None else at), day(n - 30), f"x{n}", f"p{n}", len(text), "s", text)


def test_whole_filing_scores(spark):
    df = spark.createDataFrame([filing(1, "good good  fine\nfine"), filing(2, " \n "), filing(3, "bad " * 9)], FILINGS)
    got = {r.accession_number: r for r in score_filings(df, LEXICON, scoring.word_chunks(4)).collect()}
    assert set(got) == {"x1", "x3"}
    assert (got["x1"].chunk_count, got["x1"].clean_text_length, got["x1"].dominant_sentiment) == (1, 19, "positive")
    assert got["x3"].chunk_count == 3 and got["x3"].sentiment_score == pytest.approx(-1.0)
    probabilities = [got["x1"][c + "_prob"] for c in scoring.CLASSES]
    assert sum(probabilities) == pytest.approx(1.0)


def test_section_scores_keep_unusable_filings(spark):
    body = f"{OPEN} {'good ' * 50}{CLOSE}"
    df = spark.createDataFrame([filing(1, body), filing(2, "none"), filing(3, f"{OPEN} a {CLOSE}")], FILINGS)
    got = {r.accession_number: r for r in score_sections(df, LEXICON, scoring.word_chunks(20), min_chars=200).collect()}
    assert {k: (r.extraction_status, r.mda_found) for k, r in got.items()} == {
        "x1": ("scored", 1), "x2": ("section_not_found", 0), "x3": ("section_too_short", 0),
    }
    assert got["x3"].mda_text_length == len(OPEN) + 2 and got["x3"].chunk_count is None and got["x3"].positive_prob is None
    assert got["x1"].raw_text_length == len(body)


def test_model_scorer_isolates_failures(spark):
    def load():
        def predict(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("no score")
            return np.array([[0.0, np.log(2.0), np.log(5.0)] for _ in texts])

        return predict

    scorer = scoring.model_scorer(load, {0: "Neutral", 1: "Positive", 2: "NEGATIVE"}, batch_size=2)
    df = spark.createDataFrame([filing(i, t) for i, t in enumerate(["a b", "c boom", "d e f", "g"])], FILINGS)
    scored = score_filings(df, scorer, scoring.word_chunks(2))
    good, bad = scoring.split_failures(scored)
    assert sorted(r.accession_number for r in good.collect()) == ["x0", "x2", "x3"]
    assert {r.chunk_count for r in good.collect()} == {1, 2}
    for r in good.collect():
        assert (r.positive_prob, r.negative_prob, r.neutral_prob) == pytest.approx((2 / 8, 5 / 8, 1 / 8))
    failed = bad.collect()
    assert [r.accession_number for r in failed] == ["x1"] and "no score" in failed[0].scoring_error and failed[0].positive_prob is None


def test_model_tokens(spark):
    def load():
        return (lambda text: [ord(c) for c in text]), (lambda ids: "".join(map(chr, ids)))

    df = spark.createDataFrame([(1, "abcdefgh"), (2, ""), (3, None), (4, "ab    ")], "id int, t string")
    cut = scoring.to_chunks(df, "t", ["id"], scoring.tokenizer_chunks(load, 3)).collect()
    assert [(r.id, r.chunk_no, r.chunk) for r in cut if r.chunk] == [(1, 0, "abc"), (1, 1, "def"), (1, 2, "gh"), (4, 0, "ab")]
    assert sorted(r.id for r in cut if r.chunk is None) == [2, 3]
    first = scoring.to_chunks(df, "t", ["id"], scoring.tokenizer_chunks(load, 3, max_chunks=1))
    assert first.where("id = 1").count() == 1


def test_resume_and_merge(spark):
    df = spark.createDataFrame([filing(i, f"good text {i}") for i in range(3)], FILINGS)
    old = score_filings(df.where("accession_number = 'x0'"), LEXICON)
    todo = resume(df, old)
    assert sorted(r.accession_number for r in todo.collect()) == ["x1", "x2"]
    assert resume(df, old, rescore=True).count() == 3
    merged = merge_scored(old.drop("model_name"), score_filings(df, LEXICON))
    assert merged.count() == 3
    assert {r.accession_number: r.model_name for r in merged.collect()} == {"x0": None, "x1": "lexicon", "x2": "lexicon"}


def test_text_features_and_panel(spark):
    df = spark.createDataFrame([filing(1, "good fine", "10-K"), filing(2, "bad fine", at=1), filing(9, "fine fine")], FILINGS)
    scored = score_filings(df, LEXICON)
    for rows in (None, 1):
        made = text_features(scored, "sec_", rows_per_segment=rows)
        got = {r.accession_number: r for r in made.collect()}
        assert got["x1"].sec_sentiment_change_prev is None
        assert got["x2"].sec_sentiment_change_prev == pytest.approx(got["x2"].sec_sentiment_score - got["x1"].sec_sentiment_score)
        assert got["x9"].sec_positive_change_prev == pytest.approx(got["x9"].sec_positive_prob - got["x2"].sec_positive_prob)
        assert (got["x1"].sec_is_10k, got["x1"].sec_is_10q, got["x2"].sec_is_10q) == (1, 0, 1)
    assert made.columns[-len(text_feature_names("sec_")):] == text_feature_names("sec_")
    assert len(text_feature_names("sec_")) == 12 and len(text_feature_names("mda_")) == 14
    bars = spark.createDataFrame([("a", day(i), 0.0, 1) for i in (0, 1, 5, 20)], "ticker string, date date, forward_return_5d double, label int")
    panel = text_panel(bars, made, "sec_").orderBy("date").collect()
    assert [r.sent_accession_number for r in panel] == [None, "x2", "x2", "x9"]


@pytest.mark.parametrize("least, found", [(3, ("AA x AA", "scored")), (10, ("AABB yyy", "section_too_short"))])
def test_a_start_heading_that_abuts_an_end_heading_goes_on_to_the_next(spark, least, found):
    rule = tx.SectionRule("marks", ("AA",), ("BB",), least)
    got = spark.createDataFrame([("AA x AABB yyy BB",)], "t string").select(tx.section("t", rule).alias("s")).first().s
    assert (got.text, got.status) == found
