"""Text: clean-up, sections, chunks, scores, filing features, text panels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dominant_class, softmax
from ..functions.text import (
    WS,
    SectionRule,
    discussion_section,
    normalize_whitespace,
    plain_typography,
    section,
    words,
)
from ..operators.rolling import trailing_counts
from ..operators.scoring import CLASSES, Lexicon, lexicon_scores, model_scorer, score_texts, split_failures, to_chunks, word_chunks
from ..plans.features import forward_labels, sentiment_momentum, text_feature_names, text_features
from ..plans.filings import score_filings, score_sections
from ..plans.panels import text_panel
from ..session import cut_lineage
from ..sources.filings import choose_text, original_filings
from . import common as base
from .registry import Tables, comparable, query

# Frequent words of the invented corpus stand in for sentiment vocabulary.
LEXICON = Lexicon(("the", "que", "der", "los", "with", "les"), ("and", "des", "die", "del", "that", "und"))
CHUNK = 64
CHUNKER = word_chunks(CHUNK)


def sql_ws(expr: str) -> str:
    """SQL for the whitespace clean-up of an expression."""
    steps = (
        (r"\n+", "chr(10)"), (r"[ \t]+", "' '"), (rf"[{WS}]+\n", "chr(10)"), (rf"\n[{WS}]+", "chr(10)"),
        (rf"[{WS}]{{2,}}", "' '"), (rf"^[{WS}]+", "''"), (rf"[{WS}]+\z", "''"),
    )
    out = f"replace({expr}, chr(13), ' ')"
    for pattern, replacement in steps:
        out = f"regexp_replace({out}, '{pattern}', {replacement}, 'g')"
    return out


def sql_words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '[{WS}]+'), lambda w: w <> '')"


@query(f"SELECT doc_id, {sql_ws('text')} AS clean FROM documents")
def normalized_text(t: Tables) -> DataFrame:
    return comparable(base.documents(t).select("doc_id", normalize_whitespace("text").alias("clean")))


_DRESS = "replace(replace(replace(text, '.', chr(8217)), ',', chr(8212)), ' the ', chr(160) || 'the' || chr(8220))"


@query(
    f"""WITH d AS (SELECT doc_id, {_DRESS} AS text FROM documents)
SELECT doc_id, translate(text, chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(160) || chr(8211) || chr(8212),
                         '''''""" + '""' + """ --') AS plain FROM d"""
)
def plain_text(t: Tables) -> DataFrame:
    """Typographic quotes, dashes and hard spaces back to ASCII."""
    dressed = F.col("text")
    for old, new in ((".", "’"), (",", "—"), (" the ", " the“")):
        dressed = F.replace(dressed, F.lit(old), F.lit(new))
    return comparable(base.documents(t).select("doc_id", plain_typography(dressed).alias("plain")))


@query(
    r"""
WITH s AS (SELECT page_id, regexp_extract_all(html, '(?is)(<nav>.+?)</nav>', 1) AS spans FROM pages)
SELECT page_id, CASE WHEN len(spans) > 0 THEN 'scored' ELSE 'section_not_found' END AS status,
       """ + sql_ws("spans[1]") + r""" AS body FROM s"""
)
def page_navigation(t: Tables) -> DataFrame:
    """A section between two fixed marks of a page."""
    rule = SectionRule("nav", (r"<nav>",), (r"</nav>",), min_chars=1)
    s = t("pages").select("page_id", section("html", rule).alias("s"))
    return comparable(s.select("page_id", "s.status", F.col("s.text").alias("body")))


# Reports made of a document between discussion headings. French ones have a table of contents
# entry first and a start heading that ends where an end heading begins, German ones lack the closing
# heading, Spanish ones have no headings.
_OPEN_10Q = "Item 2. Management’s Discussion and Analysis of Financial Condition and Results of Operations"
_CLOSE_10Q = "ITEM 4. Controls and Procedures"
_OPEN_10K = "ITEM 7. Management discussion and discussion and analysis"
_CLOSE_10K = "Item 7A. Quantitative and Qualitative Disclosures about Market Risk"


def reports(t: Tables) -> DataFrame:
    body = F.col("text")
    text = (
        F.when(F.col("lang") == "en", F.concat_ws(" ", F.lit("Part I"), F.lit(_OPEN_10Q), body, F.lit(_CLOSE_10Q), body))
        .when(F.col("lang") == "fr", F.concat_ws(" ", F.lit(_OPEN_10K), F.lit("page 12"), F.lit(_OPEN_10K + _CLOSE_10K), F.lit(_OPEN_10K), body, F.lit(_CLOSE_10K)))
        .when(F.col("lang") == "de", F.concat_ws(" ", F.lit(_OPEN_10K), body))
        .otherwise(body)
    )
    return base.filings(t).withColumn("text", text)


REPORTS = f"""{base.FILINGS},
reports AS (
  SELECT * REPLACE (CASE lang
    WHEN 'en' THEN concat_ws(' ', 'Part I', '{_OPEN_10Q}', text, '{_CLOSE_10Q}', text)
    WHEN 'fr' THEN concat_ws(' ', '{_OPEN_10K}', 'page 12', '{_OPEN_10K}{_CLOSE_10K}', '{_OPEN_10K}', text, '{_CLOSE_10K}')
    WHEN 'de' THEN concat_ws(' ', '{_OPEN_10K}', text)
    ELSE text END AS text) FROM filings)"""

_S = f"[{WS}]"
_START_K = rf"ITEM{_S}*7\.?{_S}+MANAGEMENT.{{0,40}}DISCUSSION{_S}+AND{_S}+ANALYSIS"
_END_K = rf"ITEM{_S}*7A\.?{_S}+QUANTITATIVE{_S}+AND{_S}+QUALITATIVE{_S}+DISCLOSURES{_S}+ABOUT{_S}+MARKET{_S}+RISK"
_START_Q = rf"ITEM{_S}*2\.?{_S}+MANAGEMENT.{{0,40}}DISCUSSION{_S}+AND{_S}+ANALYSIS"
_END_Q = rf"ITEM{_S}*4\.?{_S}+CONTROLS{_S}+AND{_S}+PROCEDURES"

def sql_marks(pattern: str) -> str:
    """Start and end of every match of a pattern in ``text``."""
    gaps, hits = f"string_split_regex(text, '(?is){pattern}')", f"regexp_extract_all(text, '(?is){pattern}', 0)"
    long = "lambda x: length(x)"
    end = f"list_sum(list_transform({gaps}[1:i], {long})) + list_sum(list_transform({hits}[1:i], {long}))"
    return f"list_transform(range(1, len({hits}) + 1), lambda i: {{'s': {end} - length({hits}[i]), 'e': {end}}})"


SECTIONS = f"""{REPORTS},
plain AS (SELECT * REPLACE (replace(replace(text, chr(8217), ''''), chr(160), ' ') AS text) FROM reports),
marked AS (
  SELECT *, CASE WHEN form_type = '10-K' THEN {sql_marks(_START_K)} ELSE {sql_marks(_START_Q)} END AS starts,
    CASE WHEN form_type = '10-K' THEN {sql_marks(_END_K)} ELSE {sql_marks(_END_Q)} END AS ends FROM plain),
found AS (
  SELECT * EXCLUDE (starts, ends), list_filter(list_transform(list_transform(starts, lambda x: substr(text, CAST(x.s AS BIGINT) + 1,
      CAST(list_min(list_transform(list_filter(ends, lambda y: y.s > x.e), lambda y: y.s)) - x.s AS BIGINT))),
      lambda s: {sql_ws('s')}), lambda s: length(s) > 0) AS spans, len(starts) > 0 AS opened
  FROM marked),
ranked AS (
  SELECT *, list_filter(spans, lambda s: length(s) >= 500) AS enough,
    list_filter(spans, lambda s: length(s) = list_max(list_transform(spans, lambda x: length(x))))[1] AS longest FROM found),
sections AS (
  SELECT * EXCLUDE (text, spans, enough, longest, opened),
    CASE WHEN len(enough) > 0 THEN enough[1] ELSE longest END AS section_text,
    CASE WHEN len(enough) > 0 THEN 'scored' WHEN len(spans) > 0 THEN 'section_too_short'
         WHEN opened THEN 'section_end_not_found' ELSE 'section_not_found' END AS status,
    CASE WHEN form_type = '10-K' THEN 'item7_to_item7a_or_item8' ELSE 'item2_to_item3_or_item4' END AS method,
    length(text) AS raw_text_length
  FROM ranked)"""


@query(f"WITH {SECTIONS} SELECT accession_number, status, method, section_text FROM sections")
def report_sections(t: Tables) -> DataFrame:
    cut = reports(t).select("accession_number", discussion_section("text", "form_type").alias("s"))
    return comparable(
        cut.select("accession_number", "s.status", "s.method", F.col("s.text").alias("section_text"))
    )


_CHUNKS = f"""tokens AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
cut AS (
  SELECT doc_id, i AS chunk_no, w[i * {CHUNK} + 1 : (i + 1) * {CHUNK}] AS piece
  FROM (SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / {CHUNK}.0) AS BIGINT))) AS i FROM tokens WHERE len(w) > 0))"""


@query(f"WITH {_CHUNKS} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, array_to_string(piece, ' ') AS chunk FROM cut")
def text_chunks(t: Tables) -> DataFrame:
    pieces = to_chunks(base.documents(t), "text", ["doc_id"], CHUNKER).where(F.col("chunk").isNotNull())
    return comparable(pieces.select("doc_id", "chunk_no", "chunk"))


@query(
    f"""WITH {_CHUNKS},
marked AS (SELECT doc_id, count(*) AS n, bool_or(contains(array_to_string(piece, ' '), '|')) AS bad FROM cut GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS chunk_count, CASE WHEN bad THEN 'unreadable mark' END AS scoring_error,
       CAST(coalesce(n, 0) = 0 OR coalesce(bad, false) AS BIGINT) AS unscored
FROM documents LEFT JOIN marked USING (doc_id)"""
)
def failed_scores(t: Tables) -> DataFrame:
    """A scorer that fails on some chunks: their texts carry the reason, all others are scored."""

    def scorer(chunk: Column) -> Column:
        failure = F.struct(*[F.lit(None).cast("double").alias(c) for c in CLASSES], F.lit("unreadable mark").alias("error"))
        return F.when(chunk.contains("|"), failure).otherwise(LEXICON(chunk))

    scored, failed = split_failures(score_texts(base.documents(t), "text", ["doc_id"], scorer, CHUNKER))
    both = scored.withColumn("scoring_error", F.lit(None).cast("string")).unionByName(failed)
    return comparable(both.select("doc_id", "chunk_count", "scoring_error", F.col("positive_prob").isNull().alias("unscored")))


@query(
    f"""WITH {_CHUNKS}
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, array_to_string(piece, ' ') AS chunk FROM cut WHERE chunk_no < 3"""
)
def leading_chunks(t: Tables) -> DataFrame:
    """A cap on chunks per text, as an option of chunking."""
    cut = base.documents(t).select("doc_id", F.posexplode(word_chunks(CHUNK, max_chunks=3)(F.col("text"))).alias("chunk_no", "chunk"))
    return comparable(cut)


def sql_scores(piece: str) -> str:
    """SQL for the lexicon probabilities of a token list: columns positive, negative, neutral."""
    def share(vocabulary: tuple[str, ...]) -> str:
        known = ", ".join(f"'{w}'" for w in vocabulary)
        return f"100.0 * len(list_filter({piece}, lambda x: lower(x) IN ({known}))) / greatest(len({piece}), 1)"

    p, n = share(LEXICON.positive), share(LEXICON.negative)
    total = f"(exp({p}) + exp({n}) + exp(1.0))"
    return f"exp({p}) / {total} AS positive, exp({n}) / {total} AS negative, exp(1.0) / {total} AS neutral"


@query(f"WITH {_CHUNKS} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, round(positive, 6) AS positive, round(negative, 6) AS negative, round(neutral, 6) AS neutral FROM (SELECT doc_id, chunk_no, {sql_scores('piece')} FROM cut)")
def chunk_scores(t: Tables) -> DataFrame:
    pieces = to_chunks(base.documents(t), "text", ["doc_id"], CHUNKER).where(F.col("chunk").isNotNull())
    scored = pieces.select("doc_id", "chunk_no", lexicon_scores(words(F.lower("chunk")), LEXICON).alias("s"))
    return comparable(scored.select("doc_id", "chunk_no", "s.positive", "s.negative", "s.neutral"))


def _sentiment(source: str, text: str, ids: str) -> str:
    """SQL chain from a table with a text column to mean chunk scores (CTE ``scored``)."""
    return f"""tokens AS (SELECT {ids}, {sql_words(text)} AS w FROM {source}),
cut AS (
  SELECT {ids}, w[i * {CHUNK} + 1 : (i + 1) * {CHUNK}] AS piece
  FROM (SELECT {ids}, w, unnest(range(CAST(ceil(len(w) / {CHUNK}.0) AS BIGINT))) AS i FROM tokens WHERE len(w) > 0)),
means AS (
  SELECT {ids}, count(*) AS chunk_count, avg(positive) AS positive_prob, avg(negative) AS negative_prob, avg(neutral) AS neutral_prob
  FROM (SELECT {ids}, {sql_scores('piece')} FROM cut) GROUP BY ALL),
scored AS (
  SELECT *, positive_prob - negative_prob AS sentiment_score,
    CASE WHEN positive_prob >= negative_prob AND positive_prob >= neutral_prob THEN 'positive'
         WHEN negative_prob >= positive_prob AND negative_prob >= neutral_prob THEN 'negative' ELSE 'neutral' END AS dominant_sentiment
  FROM means)"""


_IDS = "ticker, cik, company_name, form_type, filing_date, period_end, accession_number, text_length"
FULL = f"""{base.FILINGS},
clean AS (SELECT * REPLACE ({sql_ws('text')} AS text) FROM filings),
clean_length AS (SELECT accession_number, length(text) AS clean_text_length FROM clean),
{_sentiment('clean', 'text', _IDS)}"""


@query(
    f"""WITH {FULL}
SELECT accession_number, text_length, clean_text_length, chunk_count,
       {base.r6('positive_prob', 'negative_prob', 'neutral_prob', 'sentiment_score')}, dominant_sentiment
FROM scored JOIN clean_length USING (accession_number)"""
)
def filing_sentiment(t: Tables) -> DataFrame:
    """Whole-filing sentiment: clean, chunk, score, average."""
    scored = score_filings(base.filings(t), LEXICON, CHUNKER)
    return comparable(
        scored.select("accession_number", "text_length", "clean_text_length", "chunk_count", "positive_prob",
                      "negative_prob", "neutral_prob", "sentiment_score", "dominant_sentiment")
    )


_SECTION_IDS = "accession_number, ticker, cik, company_name, form_type, filing_date, period_end, raw_text_length, method"
SECTION_SCORES = f"""{SECTIONS},
usable AS (SELECT * FROM sections WHERE status = 'scored'),
{_sentiment('usable', 'section_text', _SECTION_IDS)},
section_sentiment AS (
  SELECT s.ticker, s.cik, s.company_name, s.form_type, s.filing_date, s.period_end, s.accession_number,
         s.raw_text_length, length(s.section_text) AS mda_text_length, s.status AS extraction_status, s.method AS extraction_method,
         CASE WHEN c.accession_number IS NULL THEN 0 ELSE 1 END AS mda_found, c.chunk_count,
         c.positive_prob, c.negative_prob, c.neutral_prob, c.sentiment_score, c.dominant_sentiment
  FROM sections s LEFT JOIN scored c ON s.accession_number = c.accession_number)"""


@query(
    f"""WITH {SECTION_SCORES}
SELECT accession_number, raw_text_length, mda_text_length, extraction_status, extraction_method,
       CAST(mda_found AS BIGINT) AS mda_found, chunk_count,
       {base.r6('positive_prob', 'negative_prob', 'neutral_prob', 'sentiment_score')}, dominant_sentiment
FROM section_sentiment"""
)
def section_sentiment(t: Tables) -> DataFrame:
    """Section sentiment; reports without a usable section stay, with their status."""
    scored = score_sections(reports(t), LEXICON, CHUNKER)
    return comparable(
        scored.select("accession_number", "raw_text_length", "mda_text_length", "extraction_status", "extraction_method",
                      "mda_found", "chunk_count", "positive_prob", "negative_prob", "neutral_prob", "sentiment_score",
                      "dominant_sentiment")
    )


@query(
    f"""WITH {SECTION_SCORES}
SELECT extraction_status, count(*) AS n, round(avg(chunk_count), 6) AS mean_chunks, round(avg(mda_text_length), 6) AS mean_chars
FROM section_sentiment GROUP BY 1"""
)
def section_status_counts(t: Tables) -> DataFrame:
    scored = score_sections(reports(t), LEXICON, CHUNKER)
    return comparable(
        scored.groupBy("extraction_status").agg(
            F.count(F.lit(1)).alias("n"), F.avg("chunk_count").alias("mean_chunks"), F.avg("mda_text_length").alias("mean_chars")
        )
    )


def _text_feature_sql(prefix: str, source: str, section_variant: bool) -> str:
    change = {"sentiment_change_prev": "sentiment_score", "positive_change_prev": "positive_prob", "negative_change_prev": "negative_prob"}
    made = {
        "sentiment_abs": "abs(sentiment_score)", "log_chunk_count": "ln(1 + chunk_count)",
        "text_length": "mda_text_length", "log_text_length": "ln(1 + mda_text_length)",
        "is_10k": "CAST(form_type = '10-K' AS BIGINT)", "is_10q": "CAST(form_type = '10-Q' AS BIGINT)",
        **{k: f"{v} - lag({v}) OVER w" for k, v in change.items()},
    }
    columns = ", ".join(f"{made.get(n.removeprefix(prefix), n.removeprefix(prefix))} AS {n}" for n in text_feature_names(prefix))
    where = "WHERE mda_found = 1" if section_variant else ""
    return f"""(SELECT ticker, form_type, filing_date, accession_number, {columns} FROM {source} {where}
  WINDOW w AS (PARTITION BY ticker ORDER BY filing_date, form_type, accession_number))"""


def filing_scores(t: Tables) -> DataFrame:
    """Whole-filing sentiment as a written table: the steps after it read it several times."""
    return cut_lineage(score_filings(base.filings(t), LEXICON, CHUNKER))


def section_scores(t: Tables) -> DataFrame:
    return cut_lineage(score_sections(reports(t), LEXICON, CHUNKER))


def _rounded(prefix: str) -> str:
    whole = {prefix + n for n in ("chunk_count", "text_length", "is_10k", "is_10q")}
    return ", ".join(n if n in whole else f"round({n}, 6) AS {n}" for n in text_feature_names(prefix))


@query(
    f"""WITH {FULL}, features AS {_text_feature_sql('sec_', 'scored', False)}
SELECT ticker, form_type, CAST(filing_date AS VARCHAR) AS filing_date, accession_number, {_rounded('sec_')} FROM features"""
)
def filing_text_features(t: Tables) -> DataFrame:
    made = text_features(filing_scores(t), "sec_")
    return comparable(made.drop("cik", "company_name", "period_end"))


@query(
    f"""WITH {SECTION_SCORES}, features AS {_text_feature_sql('mda_', 'section_sentiment', True)}
SELECT ticker, form_type, CAST(filing_date AS VARCHAR) AS filing_date, accession_number, {_rounded('mda_')} FROM features"""
)
def section_text_features(t: Tables) -> DataFrame:
    made = text_features(section_scores(t), "mda_", text_length="mda_text_length")
    return comparable(made.drop("cik", "company_name", "period_end", "extraction_status"))


@query(
    f"""WITH {base.FILINGS}
SELECT ticker, accession_number, form_type, CAST(filing_date AS VARCHAR) AS filing_date FROM filings
WHERE form_type IN ('10-K', '10-Q') AND filing_date BETWEEN DATE '1995-06-01' AND DATE '2001-12-31'"""
)
def original_filing_rows(t: Tables) -> DataFrame:
    kept = original_filings(base.filings(t), horizon=("1995-06-01", "2001-12-31"))
    return comparable(kept.select("ticker", "accession_number", "form_type", "filing_date"))


@query(
    f"""WITH {base.FILINGS}
SELECT ticker, accession_number, form_type, CAST(filing_date AS VARCHAR) AS filing_date FROM filings
WHERE form_type IN ('10-K', '10-Q') AND filing_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'
ORDER BY ticker, filing_date, form_type, accession_number LIMIT 25"""
)
def first_filings(t: Tables) -> DataFrame:
    """The small-run option: the first filings in sorted order."""
    kept = original_filings(base.filings(t), horizon=base.HORIZON, max_filings=25)
    return comparable(kept.select("ticker", "accession_number", "form_type", "filing_date"))


@query(
    """
SELECT doc_id, CASE WHEN toxic = 1 THEN coalesce(nullif(source, 'src0'), '') ELSE coalesce(text, '') END AS chosen
FROM (SELECT doc_id, text, source, toxic FROM documents LEFT JOIN labels USING (doc_id))"""
)
def chosen_text(t: Tables) -> DataFrame:
    """First non-blank of two candidate texts."""
    rows = t("documents").join(t("labels"), "doc_id", "left")
    plain = F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, F.lit(" \n ")).otherwise(F.col("text"))
    other = F.when(F.col("source") != "src0", F.col("source"))
    return comparable(rows.select("doc_id", choose_text(plain, other).alias("chosen")))


@query(
    """
WITH e AS (SELECT event_id, exp(value / 100) AS a, exp(CAST(json_extract(props, '$.k') AS DOUBLE) / 100) AS b, exp(0.3) AS c FROM events),
p AS (SELECT event_id, a / (a + b + c) AS positive, b / (a + b + c) AS negative, c / (a + b + c) AS neutral FROM e)
SELECT event_id, round(positive, 6) AS positive, round(negative, 6) AS negative, round(neutral, 6) AS neutral,
  CASE WHEN positive >= negative AND positive >= neutral THEN 'positive'
       WHEN negative >= positive AND negative >= neutral THEN 'negative' ELSE 'neutral' END AS label
FROM p"""
)
def softmax_classes(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    p, n, u = softmax(F.col("value") / 100.0, k / 100.0, F.lit(0.3))
    rows = t("events").select("event_id", p.alias("positive"), n.alias("negative"), u.alias("neutral"))
    return comparable(rows.withColumn("label", dominant_class("positive", "negative", "neutral")))


TEXT_BARS = """priced AS (
  SELECT 'src' || CAST(s_nationkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
         max(l_extendedprice / l_quantity) AS adj_close, sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
text_bars AS (
  SELECT *, lead(adj_close, 5) OVER (PARTITION BY ticker ORDER BY date) / adj_close - 1 AS forward_return_5d FROM priced)"""


def text_bars(t: Tables) -> DataFrame:
    """Labelled bars per nation, named like the document sources; five of them have no filings."""
    lines = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    priced = lines.groupBy(
        F.concat(F.lit("src"), F.col("s_nationkey").cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("date")
    ).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("adj_close"), F.sum("l_quantity").alias("volume"))
    return forward_labels(priced)


def _panel_sql(prefix: str, chain: str, source: str, section_variant: bool) -> str:
    return f"""WITH {chain}, features AS {_text_feature_sql(prefix, source, section_variant)}, {TEXT_BARS},
newest AS (SELECT * FROM features
  QUALIFY row_number() OVER (PARTITION BY ticker, filing_date ORDER BY accession_number DESC) = 1)
SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, round(b.forward_return_5d, 6) AS forward_return_5d,
       CAST(f.filing_date AS VARCHAR) AS sent_filing_date, f.accession_number AS sent_accession_number,
       f.form_type AS sent_form_type, {_rounded(prefix)}
FROM text_bars b ASOF LEFT JOIN newest f ON b.ticker = f.ticker AND b.date >= f.filing_date"""


def _text_panel(t: Tables, features: DataFrame, prefix: str) -> DataFrame:
    panel = text_panel(text_bars(t), cut_lineage(features), prefix)
    return comparable(panel.drop("adj_close", "volume", "label"))


@query(_panel_sql("sec_", FULL, "scored", False))
def filing_text_panel(t: Tables) -> DataFrame:
    """Daily rows with the newest whole-filing features."""
    return _text_panel(t, text_features(filing_scores(t), "sec_"), "sec_")


@query(_panel_sql("mda_", SECTION_SCORES, "section_sentiment", True))
def section_text_panel(t: Tables) -> DataFrame:
    """Daily rows with the newest section features."""
    made = text_features(section_scores(t), "mda_", text_length="mda_text_length")
    return _text_panel(t, made, "mda_")


_MOMENTUM = f"""WITH {FULL}, features AS {_text_feature_sql("sec_", "scored", False)}, {TEXT_BARS},
newest AS (SELECT * FROM features
  QUALIFY row_number() OVER (PARTITION BY ticker, filing_date ORDER BY accession_number DESC) = 1),
panel AS (SELECT b.ticker, b.date, f.sec_sentiment_score AS s FROM text_bars b ASOF LEFT JOIN newest f ON b.ticker = f.ticker AND b.date >= f.filing_date),
rolled AS (
  SELECT *, s - lag(s, 5) OVER w AS change, CASE WHEN count(s) OVER f = 5 THEN avg(s) OVER f END AS mean
  FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
delta AS (SELECT *, mean - lag(mean, 5) OVER (PARTITION BY ticker ORDER BY date) AS momentum FROM rolled)
SELECT ticker, CAST(date AS VARCHAR) AS date, round(s, 6) AS sec_sentiment_score, round(change, 6) AS sentiment_change_5d, round(momentum, 6) AS sentiment_momentum_5d FROM delta"""


def _momentum(t: Tables, **how) -> DataFrame:
    panel = text_panel(text_bars(t).select("ticker", "date"), cut_lineage(text_features(filing_scores(t), "sec_")), "sec_")
    wide = sentiment_momentum(panel.select("ticker", "date", "sec_sentiment_score"), **how)
    # differences of equal scores are zero on both sides, up to the last bit
    return comparable(wide.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("sentiment_change_5d", "sentiment_momentum_5d")}))


@query(_MOMENTUM)
def sentiment_momentum_5d(t: Tables) -> DataFrame:
    """The change of the newest known score over five bars, as it is and of its trailing mean."""
    return _momentum(t)


@query(_MOMENTUM)
def sentiment_momentum_5d_split(t: Tables) -> DataFrame:
    """The same in segments of some hundred bars."""
    return _momentum(t, rows_per_segment=500)


_VOLUME = f"""WITH {base.FILINGS}, {TEXT_BARS}
SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, count(f.accession_number) AS news_volume
FROM text_bars b LEFT JOIN filings f ON b.ticker = f.ticker AND f.filing_date <= b.date AND f.filing_date > b.date - 30
GROUP BY b.ticker, b.date"""


@query(_VOLUME)
def news_volume(t: Tables) -> DataFrame:
    """Filings of the 30 days up to each bar."""
    filings = base.filings(t).select("ticker", "filing_date")
    return comparable(trailing_counts(text_bars(t).select("ticker", "date"), filings, ["ticker"], "date", "filing_date", 30, "news_volume", rows_per_segment=None))


_EVENT_VOLUME = """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, event_id AS view_id FROM events WHERE event_type = 'view')
SELECT l.event_id, l.user_id, count(r.view_id) AS views_2d FROM l LEFT JOIN r ON l.user_id = r.user_id AND r.ts <= l.ts AND r.ts > l.ts - INTERVAL 60 HOUR GROUP BY l.event_id, l.user_id"""


def _event_volume(t: Tables, **how) -> DataFrame:
    events = t("events").select("event_id", "user_id", "ts", "event_type")
    bought, seen = (events.where(F.col("event_type") == kind).drop("event_type") for kind in ("purchase", "view"))
    return comparable(trailing_counts(bought, seen.select("user_id", "ts"), ["user_id"], "ts", "ts", 2.5, "views_2d", **how).drop("ts"))


@query(_EVENT_VOLUME)
def event_volume(t: Tables) -> DataFrame:
    """Views of the two and a half days before each purchase."""
    return _event_volume(t)


@query(_EVENT_VOLUME)
def event_volume_split(t: Tables) -> DataFrame:
    """The same with every user taken for hot, and the histories cut at some hundred places."""
    return _event_volume(t, rows_per_segment=max(25, t("events").count() // 100), hot_rows=0)


# a model of one seeded matrix: shares of vowels, blanks and capitals of a chunk, and a constant, to the logits of three classes
_MATRIX = [[round(float(x), 3) for x in row] for row in np.random.default_rng(5).normal(scale=4.0, size=(4, 3))]
_LABELS = {0: "Neutral", 1: "Positive", 2: "Negative"}


def _matrix_model():
    weights = np.array(_MATRIX)

    def logits(texts: Sequence[str]) -> np.ndarray:
        shares = [[sum(c in kind for c in x) / len(x) for kind in ("aeiou", " ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")] for x in texts]
        return np.column_stack([shares, np.ones(len(texts))]) @ weights

    return logits


def _matrix_sql() -> str:
    shares = [f"length(regexp_replace(chunk, '[^{kind}]', '', 'g')) / length(chunk)" for kind in ("aeiou", " ", "A-Z")]
    logits = ", ".join(" + ".join([*(f"{_MATRIX[k][c]} * {x}" for k, x in enumerate(shares)), str(_MATRIX[3][c])]) + f" AS z{c}" for c in range(3))
    return f"""WITH {_CHUNKS},
pieces AS (SELECT doc_id, array_to_string(piece, ' ') AS chunk FROM cut),
logits AS (SELECT doc_id, {logits} FROM pieces),
scored AS (SELECT doc_id, exp(z1) / (exp(z0) + exp(z1) + exp(z2)) AS p, exp(z2) / (exp(z0) + exp(z1) + exp(z2)) AS n, exp(z0) / (exp(z0) + exp(z1) + exp(z2)) AS u FROM logits),
means AS (SELECT doc_id, count(*) AS chunk_count, avg(p) AS p, avg(n) AS n, avg(u) AS u FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(chunk_count, 0) AS chunk_count, round(p, 6) AS positive_prob, round(n, 6) AS negative_prob, round(u, 6) AS neutral_prob, round(p - n, 6) AS sentiment_score,
  CASE WHEN p IS NULL THEN NULL WHEN p >= n AND p >= u THEN 'positive' WHEN n >= u THEN 'negative' ELSE 'neutral' END AS dominant_sentiment
FROM documents d LEFT JOIN means m ON d.doc_id = m.doc_id"""


@query(_matrix_sql())
def model_scored_texts(t: Tables) -> DataFrame:
    """Documents scored by a model in Arrow batches: chunks, logits, mean class probabilities, net score."""
    scored = score_texts(base.documents(t), "text", ["doc_id"], model_scorer(_matrix_model, _LABELS, batch_size=64), CHUNKER)
    return comparable(scored.drop("scoring_error"))
