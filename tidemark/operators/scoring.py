"""Chunk scoring: cut texts into chunks, score every chunk, average per text.

Chunks are rows, so a long text is spread over batches like any other and a model sees full
batches. The scores of a text are averaged by a grouped aggregation that also carries the
text's metadata: its chunks sit in one task, so each text crosses the shuffle as one short row and
the text itself never does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import bind, dominant_class, net_score, softmax
from ..functions.text import CHUNK_TOKENS, chunks, count_words, words

CLASSES = ("positive", "negative", "neutral")
SCORE_TYPE = T.StructType(
    [*[T.StructField(c, T.DoubleType()) for c in CLASSES], T.StructField("error", T.StringType())]
)

# A scorer maps a chunk-text column to a struct of SCORE_TYPE.
Scorer = Callable[[Column], Column]


@dataclass(frozen=True)
class Lexicon:
    """Two short word lists. The default scorer: no model weights, no Python, fully inside the JVM."""

    positive: tuple[str, ...]
    negative: tuple[str, ...]
    can_fail = False

    def __call__(self, chunk: Column) -> Column:
        return lexicon_scores(words(F.lower(chunk)), self)


# Our own short default lists; callers bring the vocabulary of their corpus.
DEFAULT_LEXICON = Lexicon(
    ("gain", "gains", "growth", "improved", "increase", "increased", "profit", "strong", "success", "record"),
    ("decline", "declined", "decrease", "decreased", "impairment", "loss", "losses", "risk", "weak", "adverse"),
)


def lexicon_scores(tokens: Column, lexicon: Lexicon) -> Column:
    """Class probabilities from word shares: a softmax over 100 times the positive and negative share, and 1."""

    def count(t: Column) -> Column:
        return F.struct(
            F.greatest(F.size(t), F.lit(1)).cast("double").alias("n"),
            count_words(t, lexicon.positive).alias("p"),
            count_words(t, lexicon.negative).alias("u"),
        )

    def logits(c: Column) -> Column:
        return F.struct((100.0 * c["p"] / c["n"]).alias("p"), (100.0 * c["u"] / c["n"]).alias("u"))

    def probabilities(x: Column) -> Column:
        p, u, z = softmax(x["p"], x["u"], F.lit(1.0))
        return F.struct(
            p.alias("positive"), u.alias("negative"), z.alias("neutral"), F.lit(None).cast("string").alias("error")
        )

    return bind(bind(bind(tokens, count), logits), probabilities)


def label_positions(id2label: Mapping[int, str]) -> dict[str, int]:
    """Class name in lower case to its place in a model's output."""
    return {str(label).lower(): int(i) for i, label in id2label.items()}


def model_scorer(
    load: Callable[[], Callable[[Sequence[str]], np.ndarray]],
    id2label: Mapping[int, str],
    batch_size: int = 8,
    is_probability: bool = False,
) -> Scorer:
    """Scorer around a model. ``load`` runs once per Python worker and returns texts -> (n, classes) logits.

    A batch that fails is retried text by text; a text that fails alone carries its error message
    and null scores instead of failing the job.
    """
    at = label_positions(id2label)
    pick = [at[c] for c in CLASSES]

    def probabilities(raw: np.ndarray) -> np.ndarray:
        if is_probability:
            return raw[:, pick]
        shifted = np.exp(raw - raw.max(axis=1, keepdims=True))
        return (shifted / shifted.sum(axis=1, keepdims=True))[:, pick]

    def score(texts: pd.Series, predict: Callable[[Sequence[str]], np.ndarray]) -> pd.DataFrame:
        out = pd.DataFrame({c: np.full(len(texts), np.nan) for c in CLASSES})
        errors: list[str | None] = [None] * len(texts)
        present = np.flatnonzero(texts.notna().to_numpy())

        def run(places: np.ndarray) -> None:
            got = probabilities(np.asarray(predict([texts.iloc[i] for i in places]), dtype=float))
            out.iloc[places, : len(CLASSES)] = got

        for start in range(0, len(present), batch_size):
            places = present[start : start + batch_size]
            try:
                run(places)
            except Exception:
                for i in places:
                    try:
                        run(np.array([i]))
                    except Exception as problem:
                        errors[i] = f"{type(problem).__name__}: {problem}"
        out["error"] = errors
        return out.astype(object).where(out.notna(), None)

    @F.pandas_udf(SCORE_TYPE)
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = load()
        for texts in batches:
            yield score(texts, predict)

    return scores


# A chunker maps a text column to an array of chunk texts.
Chunker = Callable[[Column], Column]


def word_chunks(size: int = CHUNK_TOKENS, max_chunks: int | None = None) -> Chunker:
    """Chunks of whitespace-separated words, inside the JVM."""
    return lambda text: chunks(words(text), size, max_chunks)


def tokenizer_chunks(
    load: Callable[[], tuple[Callable[[str], Sequence[int]], Callable[[Sequence[int]], str]]],
    size: int = CHUNK_TOKENS,
    max_chunks: int | None = None,
) -> Chunker:
    """Chunks by a model's own tokens. ``load`` runs once per Python worker and returns (encode, decode)."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, decode = load()

        def pieces(text: str | None) -> list[str]:
            ids = encode(text) if text else []
            starts = range(0, len(ids), size)[:max_chunks]
            return [p for p in (decode(ids[at : at + size]).strip() for at in starts) if p]

        for texts in batches:
            yield texts.map(pieces)

    return cut


def to_chunks(df: DataFrame, text: str, keep: Sequence[str], chunker: Chunker) -> DataFrame:
    """One row per chunk (``chunk_no`` from 0, ``chunk``) with the kept columns; a text without chunks keeps one null row."""
    return df.select(*keep, F.posexplode_outer(chunker(F.col(text))).alias("chunk_no", "chunk"))


def score_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    scorer: Scorer = DEFAULT_LEXICON,
    chunker: Chunker = word_chunks(),
) -> DataFrame:
    """Kept columns (they must identify a text) plus chunk count, mean class probabilities, net score,
    dominant class and the first scoring error. Texts without chunks have count 0 and null scores."""
    scored = to_chunks(df, text, keep, chunker).select(
        *keep, "chunk", F.when(F.col("chunk").isNotNull(), scorer(F.col("chunk"))).alias("s")
    )
    # a text-valued maximum would force a sort-based aggregation, so only scorers that can fail have it
    can_fail = getattr(scorer, "can_fail", True)
    means = scored.groupBy(*keep).agg(
        F.count("chunk").alias("chunk_count"),
        *[F.avg(f"s.{c}").alias(f"{c}_prob") for c in CLASSES],
        *([F.max("s.error").alias("scoring_error")] if can_fail else []),
    )
    if not can_fail:
        means = means.withColumn("scoring_error", F.lit(None).cast("string"))
    failed = F.col("scoring_error").isNotNull()
    for c in CLASSES:
        means = means.withColumn(f"{c}_prob", F.when(~failed, F.col(f"{c}_prob")))
    return means.select(
        *keep,
        "chunk_count",
        *[f"{c}_prob" for c in CLASSES],
        net_score("positive_prob", "negative_prob").alias("sentiment_score"),
        dominant_class("positive_prob", "negative_prob", "neutral_prob").alias("dominant_sentiment"),
        "scoring_error",
    )


def split_failures(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored texts, and texts whose scoring failed with the reason."""
    bad = F.col("scoring_error").isNotNull()
    return scored.where(~bad).drop("scoring_error"), scored.where(bad)
