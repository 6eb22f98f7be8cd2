import random
import re

from pyspark.sql import functions as F

from tidemark.functions.scalars import WS_CHARACTERS
from tidemark.functions.text import discussion_section, heading_spans, normalize_whitespace, words


def _texts(n=400, seed=5):
    rng = random.Random(seed)
    alphabet = [*WS_CHARACTERS, "\x00", "\r", "\n", "\n", " ", " ", "\t", "a", "Z", "é", "\x7f", "\xad", "​", "😀", "~", "!"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(n)] + ["", None, " " * 5000 + "\n" * 5000 + "x"]


def test_clean_up_and_words_of_odd_white_space(spark):
    blank = "[" + re.escape(WS_CHARACTERS.replace("\n", "") + "\x00") + "]"
    ws = "[" + re.escape(WS_CHARACTERS) + "]"

    def clean(text):
        c = re.sub(f"{blank}{{2,}}|[\t\r\x00]", " ", text)
        return re.sub(f"{blank}?\n{ws}*", "\n", c).strip(WS_CHARACTERS)

    frame = spark.createDataFrame([(t,) for t in _texts()], "t string")
    for r in frame.select("t", normalize_whitespace("t").alias("c"), words("t").alias("w")).collect():
        assert (r.c, r.w) == ((None, None) if r.t is None else (clean(r.t), [w for w in re.split(f"{ws}+", r.t) if w])), repr(r.t)


def test_spans_of_matches_at_the_ends_side_by_side_and_around_the_mark(spark):
    texts = ["", "abab", "xabyabz", "\x01ab\x01", "ab\x01\x01ab", "\x01", "é😀ab", "AB ab", "none"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    for r in frame.select("t", heading_spans(F.col("t"), "(?isu)(?:ab)").alias("s")).collect():
        assert [tuple(x) for x in r.s] == [m.span() for m in re.finditer("(?i)ab", r.t)], repr(r.t)


def test_a_text_is_cleaned_once_and_searched_once_for_each_heading(spark):
    frame = spark.createDataFrame([("x", "10-K")], "t string, f string")
    plan = frame.select(discussion_section("t", "f").alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(") == 2 and "regexp_like(" not in plan  # one each of the annual and the quarterly rule
