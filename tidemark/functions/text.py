"""Text expressions: whitespace and typography clean-up, section extraction, chunking, word counts.

All of it is built-in expressions on a text column, so it runs inside the scan stage with no
shuffle. Heading patterns avoid look-around and possessive syntax, so an SQL engine can run the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import WS_CHARACTERS, as_col, bind

# The characters that count as whitespace (Unicode white space and the four
# information separators), as the inside of a character class.
WS = (
    r"\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Typographic characters and their ASCII stand-ins.
TYPOGRAPHIC = "‘’“” –—"
ASCII = "''\"\" --"

# The same class, tested for the usual characters by one comparison.
_UNUSUAL = r"\x00- \x7f-\x{d7ff}"
_WS_CLASS = f"[{_UNUSUAL}&&[{WS}]]"
_MARK = "\x01"  # set around matches

MIN_SECTION_CHARS = 500
CHUNK_TOKENS = 510


def normalize_whitespace(text: Column | str) -> Column:
    """Collapse whitespace: a run with a line break becomes one line break, any other run one blank,
    and the ends are stripped. NUL and carriage return count as blanks; a lone unusual blank stays.

    Blanks are collapsed first, so that no pattern can scan a long run of them more than once.
    """
    blank = f"[{_UNUSUAL}&&[{WS.replace(chr(92) + 'n', '')}\\x00]]"
    c = as_col(text)
    # both patterns begin with one class, which most characters fail at once
    collapsed = F.regexp_replace(c, f"{blank}(?:(?<=[\\t\\r\\x00]){blank}*|{blank}+)", " ")
    broken = F.regexp_replace(collapsed, f"{_WS_CLASS}(?:(?<=\\n)|\\n){_WS_CLASS}*", "\n")
    return F.btrim(F.when(F.contains(c, F.lit("\n")), broken).otherwise(collapsed), F.lit(WS_CHARACTERS))


def plain_typography(text: Column | str) -> Column:
    return F.translate(as_col(text), TYPOGRAPHIC, ASCII)


@dataclass(frozen=True)
class SectionRule:
    """Headings that open and close a section. ``\\s`` in a pattern means any whitespace of ``WS``."""

    method: str
    starts: tuple[str, ...]
    ends: tuple[str, ...]
    min_chars: int = MIN_SECTION_CHARS

    @staticmethod
    def _any(patterns: Sequence[str]) -> str:
        return "|".join(p.replace(r"\s", f"[{WS}]") for p in patterns)

    @property
    def start_pattern(self) -> str:
        return f"(?isu)(?:{self._any(self.starts)})"

    @property
    def end_pattern(self) -> str:
        return f"(?isu)(?:{self._any(self.ends)})"


# Headings around the discussion section of annual and quarterly reports.
ANNUAL_DISCUSSION = SectionRule(
    "item7_to_item7a_or_item8",
    (
        r"ITEM\s*7\.?\s+MANAGEMENT(?:['`]\s*|\s+)S\s+DISCUSSION\s+AND\s+ANALYSIS\s+OF\s+FINANCIAL\s+CONDITION\s+AND\s+RESULTS\s+OF\s+OPERATIONS",
        r"ITEM\s*7\.?\s+MANAGEMENT.{0,40}DISCUSSION\s+AND\s+ANALYSIS",
    ),
    (
        r"ITEM\s*7A\.?\s+QUANTITATIVE\s+AND\s+QUALITATIVE\s+DISCLOSURES\s+ABOUT\s+MARKET\s+RISK",
        r"ITEM\s*8\.?\s+FINANCIAL\s+STATEMENTS\s+AND\s+SUPPLEMENTARY\s+DATA",
    ),
)
QUARTERLY_DISCUSSION = SectionRule(
    "item2_to_item3_or_item4",
    (
        r"ITEM\s*2\.?\s+MANAGEMENT(?:['`]\s*|\s+)S\s+DISCUSSION\s+AND\s+ANALYSIS\s+OF\s+FINANCIAL\s+CONDITION\s+AND\s+RESULTS\s+OF\s+OPERATIONS",
        r"ITEM\s*2\.?\s+MANAGEMENT.{0,40}DISCUSSION\s+AND\s+ANALYSIS",
    ),
    (
        r"ITEM\s*3\.?\s+QUANTITATIVE\s+AND\s+QUALITATIVE\s+DISCLOSURES\s+ABOUT\s+MARKET\s+RISK",
        r"ITEM\s*4\.?\s+CONTROLS\s+AND\s+PROCEDURES",
    ),
)


def heading_spans(text: Column, pattern: str) -> Column:
    """Start and end of every match, in order: array of struct (s, e), counted in characters.

    One search sets a mark on both sides of every match; what lies between the marks is by turns outside and inside of
    matches. Texts that hold the mark themselves are searched for the gaps and for the matches.
    """
    marked = F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}")
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    by_turns = F.flatten(F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda m: F.array(m["gap"], m["hit"])))
    pieces = F.when(F.contains(text, F.lit(_MARK)), F.filter(by_turns, lambda p: p.isNotNull())).otherwise(F.split(marked, _MARK, -1))
    none = F.array().cast("array<struct<s:int,e:int>>")

    def add(found: Column, length: Column) -> Column:
        end = found["at"] + length
        here = F.when(found["inside"], F.array(F.struct(found["at"].alias("s"), end.alias("e")))).otherwise(none)
        return F.struct(end.alias("at"), (~found["inside"]).alias("inside"), F.concat(found["spans"], here).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("spans"))
    return F.aggregate(F.transform(pieces, F.length), start, add, lambda found: found["spans"])


def section(text: Column | str, rule: SectionRule) -> Column:
    """Struct (text, status, method) of the section a rule marks.

    Each start heading opens a span that runs up to the first end heading after it; an end heading that
    begins where the start heading ends does not close it. The first cleaned span of at least
    ``min_chars`` wins with status ``scored``; else the longest (first on a tie) with
    ``section_too_short``. Without one the status says which heading was missing.

    Every step is bound, so that the text is cleaned and searched once; end headings only behind a start heading.
    """

    def opened(c: Column) -> Column:
        return F.struct(c.alias("text"), heading_spans(c, rule.start_pattern).alias("starts"))

    def closed(m: Column) -> Column:
        ends = F.when(F.size(m["starts"]) > 0, heading_spans(m["text"], rule.end_pattern))
        return F.struct(m["text"].alias("text"), m["starts"].alias("starts"), ends.alias("ends"))

    def cut(marks: Column) -> Column:
        def body(start: Column) -> Column:
            end = F.array_min(F.transform(F.filter(marks["ends"], lambda e: e["s"] > start["e"]), lambda e: e["s"]))
            return F.when(end.isNotNull(), marks["text"].substr(start["s"] + 1, end - start["s"]))

        spans = F.filter(F.transform(F.transform(marks["starts"], body), normalize_whitespace), lambda s: F.length(s) > 0)
        return F.struct(spans.alias("spans"), (F.size(marks["starts"]) > 0).alias("opened"))

    def choose(m: Column) -> Column:
        found = m["spans"]
        enough = F.filter(found, lambda s: F.length(s) >= rule.min_chars)
        # fold keeps the earlier span unless a later one is longer
        longest = F.aggregate(
            found,
            F.lit(None).cast("string"),
            lambda best, s: F.when(best.isNull() | (F.length(s) > F.length(best)), s).otherwise(best),
        )
        status = (
            F.when(F.size(enough) > 0, "scored")
            .when(F.size(found) > 0, "section_too_short")
            .when(m["opened"], "section_end_not_found")
            .otherwise("section_not_found")
        )
        return F.struct(
            F.when(F.size(enough) > 0, F.try_element_at(enough, F.lit(1))).otherwise(longest).alias("text"),
            status.alias("status"),
            F.lit(rule.method).alias("method"),
        )

    return bind(bind(bind(bind(plain_typography(text), opened), closed), cut), choose)


def discussion_section(text: Column | str, form: Column | str, min_chars: int = MIN_SECTION_CHARS) -> Column:
    """Discussion section of a report; annual headings for 10-K, quarterly ones for any other form."""
    annual, quarterly = (
        SectionRule(r.method, r.starts, r.ends, min_chars) for r in (ANNUAL_DISCUSSION, QUARTERLY_DISCUSSION)
    )
    return F.when(as_col(form) == "10-K", section(text, annual)).otherwise(section(text, quarterly))


def words(text: Column | str) -> Column:
    """Whitespace-separated tokens; empty array for blank text."""
    return F.filter(F.split(as_col(text), f"{_WS_CLASS}+"), lambda w: w != "")


def chunks(tokens: Column | str, size: int = CHUNK_TOKENS, max_chunks: int | None = None) -> Column:
    """Array of chunk texts of ``size`` tokens each, the last one shorter; optionally the first few."""
    def cut(t: Column) -> Column:
        n = F.ceil(F.size(t) / F.lit(float(size))).cast("int")
        if max_chunks is not None:
            n = F.least(n, F.lit(max_chunks))
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        pieces = F.transform(starts, lambda i: F.array_join(F.slice(t, i * size + 1, size), " "))
        return F.filter(pieces, lambda p: F.trim(p) != "")

    return bind(as_col(tokens), cut)


def count_words(tokens: Column, vocabulary: Sequence[str]) -> Column:
    """How many of the tokens are in a short word list."""
    return F.size(F.filter(tokens, lambda w: w.isin(*vocabulary)))
