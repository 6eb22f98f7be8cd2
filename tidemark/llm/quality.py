"""Quality rules whose cutoffs are chosen under a bound on false rejection.

Statistics of a text are column expressions over its words and lines; nothing is exploded or shuffled.
Each rule compares one ratio with a cutoff. Cutoffs come from a fixed list, strictest last, and are tried
per stratum on the labelled good documents: a cutoff is taken only while the exact binomial tail shows
that it rejects at most ``risk`` of them. The confidence is split over strata and rules (Bonferroni), the
list of a rule is walked in fixed order and ends at the first failure, and ``risk`` is split over the
rules, so with confidence ``1 - error`` no stratum loses more than ``risk`` of its good documents. A
stratum without enough labels to prove any cutoff keeps everything the base rules keep.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bind
from ..session import cut_lineage

#: white space between words
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: rule -> (numerator, denominator, cutoffs from the most lenient); a document fails above the cutoff
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "word_chars", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06)),
    "duplicate_lines": ("n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "repeated_words": ("n_repeat_words", "n_words", (0.48, 0.45, 0.42, 0.4, 0.38, 0.35, 0.32, 0.3, 0.25, 0.2)),
    "long_words": ("word_chars", "n_words", (30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0)),
    "short_words": ("n_words", "word_chars", (1.0, 0.8, 0.67, 0.5, 0.45, 0.4, 0.35, 0.3)),
}
_POSITION_BITS = 28


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window found twice or more.

    Windows are sorted as one long each, part hash and part position; neighbours with equal parts are
    then sorted by the full 64-bit hash of their three words.
    """

    def window_hash(w: Column, i: Column) -> Column:
        return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def neighbours(sorted_values: Column, same) -> Column:
        return F.filter(sorted_values, lambda x, i: F.coalesce(same(x, F.get(sorted_values, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(sorted_values, i + 1)), F.lit(False)))

    def covered(w: Column) -> Column:
        high = F.lit(-(1 << _POSITION_BITS))
        packed = F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long")),
        )
        part = lambda x: F.shiftright(x, _POSITION_BITS)
        maybe = bind(F.array_sort(packed), lambda s: neighbours(s, lambda x, y: part(x) == part(y)))
        positions = F.transform(maybe, lambda x: x.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int"))
        exact = F.array_sort(F.transform(positions, lambda p: F.struct(window_hash(w, p).alias("h"), p.alias("p"))))
        found = bind(exact, lambda s: neighbours(s, lambda x, y: x["h"] == y["h"]))
        ordered = F.array_sort(F.transform(found, lambda x: x["p"]))
        steps = bind(ordered, lambda s: F.transform(s, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - p, F.lit(3)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    return bind(words, covered)


def statistics(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """The input rows with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words instead of the text.

    n_lines counts the lines with a word. A null text counts as empty; then all are 0.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    long = lambda c: c.cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0)
    of_lines = bind(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct")))
    of_words = bind(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated")))
    measured = documents.select(
        *[F.col(c) for c in documents.columns if c != text_column],
        long(F.length(F.translate(text, SPACE, ""))).alias("word_chars"),
        long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        of_lines.alias("_lines"),
        of_words.alias("_words"),
    )
    return measured.select(
        *[F.col(c) for c in documents.columns if c != text_column],
        long(F.col("_words.n")).alias("n_words"),
        "word_chars",
        "n_symbols",
        long(F.col("_lines.all")).alias("n_lines"),
        long(F.col("_lines.all") - F.col("_lines.distinct")).alias("n_dup_lines"),
        F.col("_words.repeated").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def log_gamma(z: Column) -> Column:
    """ln gamma(z) for z >= 1: the Stirling series eight steps up."""
    shifted = z + 8.0
    series = (shifted - 0.5) * F.log(shifted) - shifted + 0.5 * math.log(2 * math.pi) + 1 / (12 * shifted) - 1 / (360 * F.pow(shifted, F.lit(3)))
    product = F.lit(1.0)
    for k in range(8):
        product = product * (z + float(k))
    return series - F.log(product)


def binomial_tail(x: Column, n: Column, p: float, terms: int = 10_000) -> Column:
    """P(X <= x) for X ~ Bin(n, p): the exact sum from x downwards; 1 where x reaches the mean.

    Beyond ``terms`` terms the rest is replaced by a geometric bound from above.
    """
    x, n = x.cast("double"), n.cast("double")
    log_first = log_gamma(n + 1) - log_gamma(x + 1) - log_gamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p)
    ratio = lambda k: (x - k) * (1 - p) / ((n - x + k + 1) * p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * ratio(k.cast("double"))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.least(x, F.lit(float(terms))).cast("int")
    numbers = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(numbers, start, add, lambda acc: acc["sum"] + F.when(x > terms, acc["term"] * ratio(F.lit(float(terms))) / (1 - ratio(F.lit(float(terms))))).otherwise(0.0))
    return F.when(x >= n * p, F.lit(1.0)).otherwise(F.exp(log_first + F.log(total)))


def rule_value(rule: str) -> Column:
    """The ratio of a rule; 0 where the denominator is 0."""
    numerator, denominator, _ = RULES[rule]
    return F.when(F.col(denominator) > 0, F.col(numerator) / F.col(denominator)).otherwise(0.0)


def cutoffs(good: DataFrame, stratum: str, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """One row per stratum: the proven cutoff of each rule, null where none is proven, and the labels used.

    ``good`` holds the statistics of labelled good documents that pass the base rules.
    """
    counts = good.groupBy(stratum).agg(
        F.count("*").alias("n_good"),
        *[
            F.array(*[F.count_if(rule_value(rule) > cut) for cut in cuts]).alias(rule)
            for rule, (_, _, cuts) in RULES.items()
        ],
    )
    counts = counts.withColumn("n_strata", F.count("*").over(Window.partitionBy(F.lit(0))))  # one row per stratum
    tried = counts.select(
        stratum,
        "n_good",
        "n_strata",
        F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.arrays_zip(F.array(*map(F.lit, cuts)).alias("cut"), F.col(rule).alias("x")).alias("tries")) for rule, (_, _, cuts) in RULES.items()])).alias("r"),
    ).select(stratum, "n_good", "n_strata", F.col("r.rule").alias("rule"), F.posexplode("r.tries").alias("step", "try"))
    proven = binomial_tail(F.col("try.x"), F.col("n_good"), risk / len(RULES)) <= F.lit(error) / (F.col("n_strata") * len(RULES))
    so_far = F.min(proven.cast("int")).over(Window.partitionBy(stratum, "rule").orderBy("step"))
    passed = tried.select(stratum, "n_good", "rule", F.col("try.cut").alias("cut"), so_far.alias("passed"))
    return passed.groupBy(stratum).agg(
        F.first("n_good").alias("n_good"),
        *[F.min(F.when((F.col("rule") == rule) & (F.col("passed") == 1), F.col("cut"))).alias(f"cut_{rule}") for rule in RULES],
    )


def judge(
    documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum_column: str = "lang",
    good_column: str = "quality", risk: float = 0.02, error: float = 0.05,
) -> DataFrame:
    """One row per input row: doc_id, the statistics, base_failed, kept, and the rules that rejected it.

    Strata are the values of ``stratum_column``; null is a stratum of its own. A document labelled more
    than once is good if any label says so; rows without id or label set no cutoff. Rows are judged one by
    one, so repeated ids stay repeated. No labels: the base rules alone decide.
    """
    narrow = documents.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(stratum_column).cast("string"), F.lit("")).alias("stratum"), F.col(text_column).alias("text")
    )
    measured = cut_lineage(statistics(narrow).withColumn("base_failed", base_failed()))
    good = labels.where(F.col(good_column) == 1).select(F.col(id_column).alias("doc_id")).distinct()
    limits = cutoffs(measured.where(~F.col("base_failed")).join(good, "doc_id", "left_semi"), "stratum", risk, error)
    rejected = F.array_compact(F.array(*[F.when(rule_value(rule) > F.col(f"cut_{rule}"), F.lit(rule)) for rule in RULES]))
    judged = measured.join(limits.drop("n_good"), "stratum", "left").withColumn("failed_rules", F.array_join(rejected, ","))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"), "failed_rules",
    )
