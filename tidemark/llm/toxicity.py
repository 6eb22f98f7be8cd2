"""Toxic spans and document scores from a linear-chain conditional random field over words.

Two states per word, toxic or not. Labelled tokens come from labelled documents: a word of a toxic
document is labelled toxic if it, or its stem, is far more frequent in toxic documents than in clean ones, every other
word is clean. Stems are beginnings of words (``STEMS`` bytes of letters): a small group of documents repeats the beginning
of its toxic words far more often than any one word. A word with a marked stem counts as that stem. The field has a weight for each known word at and beside a place and one per transition; it
is fitted by full gradient steps, each a Spark job over the training sample. Forward-backward marginals of
all words give a document's expected and greatest toxicity, which a logistic curve fitted on other
labelled documents turns into a score.

Training uses a bounded sample: at most ``sample_rows`` labelled documents of each class, the first by a
hash of the id, without near copies of one another. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage
from .textbytes import BYTE_VALUES, IS_SPACE, LOWER, mix, prefix_hashes, shingle_hashes, slices, span_hashes, utf8, word_bounds, word_hashes

SLICE = 1 << 19
#: steps of a lane in the forward and backward recursions
LANE = 256
FIT_TASKS = 4
#: marginals below this say nothing
DOUBTFUL = 0.25
#: lengths of the beginnings of words that may be stems, in bytes
STEMS = range(4, 9)
KEPT = IS_SPACE | (np.arange(256) >= 0x80) | ((np.arange(256) >= ord("a")) & (np.arange(256) <= ord("z")))


@dataclass(frozen=True)
class Stems:
    """Marked beginnings of words: sorted hashes, and how strong the evidence for each is."""

    hashes: np.ndarray
    evidence: np.ndarray


NO_STEMS = Stems(np.zeros(0, np.uint64), np.zeros(0))


@dataclass(frozen=True)
class Field:
    stems: Stems
    vocabulary: np.ndarray  # sorted hashes of the known words
    weights: np.ndarray  # log-odds of toxic by place (the word, the one before, the one after) and word
    transitions: np.ndarray  # 2 x 2 log-potentials, from and to
    curve: np.ndarray  # intercept, weight of the expected count, weight of the greatest marginal


def held_out(doc_id: Column) -> Column:
    """True for the rows of the test fold: crc32 of the id as text modulo 3 is 1. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass(frozen=True)
class Words:
    """The words of a slice: letters only, lower-cased in A-Z; a word without letters is left out."""

    hashes: np.ndarray
    bounds: np.ndarray  # where each row's words begin
    starts: np.ndarray  # in bytes of the slice
    ends: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray, stems: Stems = NO_STEMS) -> Words:
    """The words of a slice; a word with a marked beginning has the hash of its stem."""
    letters, starts, ends, bounds, place = letters_of(data, offsets)
    hashed = prefix_hashes(BYTE_VALUES[letters])
    hashes = span_hashes(hashed, starts, ends)
    best = np.zeros(len(hashes))
    for length in STEMS if len(stems.hashes) else ():
        long = np.flatnonzero(ends - starts >= length)
        found = beginnings(hashed, starts[long], length)
        at = np.minimum(np.searchsorted(stems.hashes, found), len(stems.hashes) - 1)
        better = (stems.hashes[at] == found) & (stems.evidence[at] > best[long])
        hashes[long[better]], best[long[better]] = found[better], stems.evidence[at[better]]
    return Words(hashes, bounds, place[starts] if len(starts) else starts, place[ends - 1] + 1 if len(ends) else ends)


def letters_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters and white space of a slice, starts and ends of its words in them, where rows begin, and where each letter stood."""
    lowered = LOWER[data]
    kept = KEPT[lowered]
    place = np.flatnonzero(kept)
    letters = lowered[place]
    shifted = np.concatenate([[0], np.cumsum(kept)])[offsets]
    return letters, *word_bounds(letters, shifted), place


def beginnings(hashed: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the first ``length`` bytes; scrambled once more, so that no whole word has the same."""
    return mix(span_hashes(hashed, starts, starts + length) + np.uint64(1))


def features(words: Words, vocabulary: np.ndarray) -> np.ndarray:
    """Words x 3 places of numbers in the vocabulary: the word, the one before, the one after.

    One number past the vocabulary is an unknown word, the next one no word at all.
    """
    number = np.full(len(words.hashes), len(vocabulary))
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, words.hashes), len(vocabulary) - 1)
        number = np.where(vocabulary[at] == words.hashes, at, number)
    first, last = edges(words.bounds, len(number))
    before, after = np.roll(number, 1), np.roll(number, -1)
    before[first] = after[last] = len(vocabulary) + 1
    return np.stack([number, before, after], axis=1)


def edges(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the first and of the last words of the rows."""
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    filled = np.diff(bounds) > 0
    first[bounds[:-1][filled]] = True
    last[bounds[1:][filled] - 1] = True
    return first, last


def log_odds(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[0, found[:, 0]] + weights[1, found[:, 1]] + weights[2, found[:, 2]]


def messages(odds: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Normalised forward messages (words x 2) of all chains at once.

    ``odds`` are the words' potentials for the toxic state, ``first`` marks the first word of a chain,
    ``move[a, b]`` is the potential from a to b. The words are laid out in lanes; each lane's product of
    transfer matrices is built lane-parallel, the lanes are linked one after the other, and a second
    lane-parallel pass fills in the messages.
    """
    n = len(odds)
    lanes = max(1, -(-n // LANE))
    padded = lanes * LANE
    o, f = np.ones(padded), np.ones(padded, bool)
    o[:n], f[:n] = odds, first
    o, f = o.reshape(lanes, LANE).T.copy(), f.reshape(lanes, LANE).T.copy()

    def step(p: np.ndarray, q: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        clean = np.where(f[t], p + q, move[0, 0] * p + move[1, 0] * q)
        toxic = o[t] * np.where(f[t], p + q, move[0, 1] * p + move[1, 1] * q)
        return clean, toxic

    p, q = np.ones((2, lanes)), np.zeros((2, lanes))
    p[1], q[1] = 0.0, 1.0
    for t in range(LANE):
        p, q = step(p, q, t)
        scale = p.sum(axis=0) + q.sum(axis=0)
        p, q = p / scale, q / scale
    start = np.empty((2, lanes))
    x, y = 0.5, 0.5
    for lane in range(lanes):
        start[:, lane] = x, y
        x, y = p[0, lane] * x + p[1, lane] * y, q[0, lane] * x + q[1, lane] * y
        x, y = x / (x + y), y / (x + y)
    out = np.empty((LANE, lanes, 2))
    p, q = start
    for t in range(LANE):
        p, q = step(p, q, t)
        total = p + q
        p, q = p / total, q / total
        out[t, :, 0], out[t, :, 1] = p, q
    return out.transpose(1, 0, 2).reshape(padded, 2)[:n]


def marginals(scores: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word the probability of the toxic state, and the expected transition counts (2 x 2)."""
    if not len(scores):
        return np.zeros(0), np.zeros((2, 2))
    odds = np.exp(np.clip(scores, -30, 30))
    move = np.exp(transitions)
    first, last = edges(bounds, len(odds))
    forward = messages(odds, first, move)
    backward = messages(odds[::-1], last[::-1], move.T)[::-1]
    both = forward * backward
    toxic, clean = both[:, 1] / odds, both[:, 0]
    inner = np.flatnonzero(~first)
    pair = forward[inner - 1][:, :, None] * move[None] * backward[inner][:, None, :]
    return toxic / (toxic + clean), (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def gradient(words: Words, toxic: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Observed minus expected counts of features and of transitions, and how often each feature occurs."""
    found, shape = features(words, field.vocabulary), field.weights.shape
    p, expected = marginals(log_odds(found, field.weights), words.bounds, field.transitions)
    slots = (found + np.arange(3) * shape[1]).ravel()
    slope = np.bincount(slots, weights=np.repeat(toxic - p, 3), minlength=field.weights.size)
    inner = np.flatnonzero(~edges(words.bounds, len(p))[0])
    observed = np.bincount((toxic[inner - 1] * 2 + toxic[inner]).astype(int), minlength=4).reshape(2, 2)
    return slope, observed - expected, np.bincount(slots, minlength=field.weights.size)


def summaries(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows x (log of one plus the expected number of toxic words, greatest marginal).

    Words below ``DOUBTFUL`` do not count, or a long clean text would add up to a toxic one.
    """
    out = np.zeros((len(bounds) - 1, 2))
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        out[filled, 0] = np.log1p(np.add.reduceat(np.where(p >= DOUBTFUL, p, 0.0), bounds[:-1][filled]))
        out[filled, 1] = np.maximum.reduceat(p, bounds[:-1][filled])
    return out


def over_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        for a, b in slices(offsets, SLICE):
            yield batch, a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def sample(documents: DataFrame, labels: DataFrame, training: Column, id_column: str, text_column: str, label_column: str, sample_rows: int) -> DataFrame:
    """Text, toxic, and part (0: the field, three quarters; 1: the curve) of the training sample."""
    labelled = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & training).groupBy(F.col(id_column).alias("doc_id")).agg(F.max(label_column).cast("int").alias("toxic"))
    order = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    chosen = labelled.where("toxic = 0").orderBy(order, "doc_id").limit(sample_rows).union(labelled.where("toxic = 1").orderBy(order, "doc_id").limit(sample_rows))
    chosen = chosen.withColumn("part", (F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(4)) == 0).cast("int"))
    # the chosen ids are at most 2 x sample_rows
    joined = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return without_copies(joined.select("text", "toxic", "part", order.alias("order")), "order").select("text", "toxic", "part")


def without_copies(rows: DataFrame, order: str, minima: int = 3) -> DataFrame:
    """The sample without near copies, whose words would otherwise count once per copy.

    Of the rows that share one of ``minima`` MinHash values of their shingles the first by ``order`` stays.
    """
    names = [f"minimum_{k}" for k in range(minima)]
    schema = T.StructType([*rows.schema, *(T.StructField(c, T.LongType()) for c in names)])
    arrow = to_arrow_schema(schema)
    text, width = rows.columns.index("text"), len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, data, offsets in over_slices(batches, text):
            lowered = LOWER[data]
            starts, ends, bounds = word_bounds(lowered, offsets)
            hashes, begin = shingle_hashes(word_hashes(lowered, starts, ends), bounds)
            filled, least = np.flatnonzero(np.diff(begin)), np.zeros((minima, b - a), np.int64)
            for k in range(minima if len(filled) else 0):
                least[k, filled] = np.minimum.reduceat(mix(hashes + np.uint64(k + 1)), begin[filled]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(width)] + [pa.array(x) for x in least], schema=arrow)

    kept = cut_lineage(rows.mapInArrow(run, schema))
    for name in names:
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(name).orderBy(order))).where("rank = 1").drop("rank")
    return kept.drop(*names)


def counted(rows: DataFrame, items: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Per item the toxic and clean documents that have it, and how often they do: word, toxic, clean, toxic_uses, clean_uses.

    ``items`` gives the items of a slice of texts and where each row's begin.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, data, offsets in over_slices(batches, 0):
            hashes, bounds = items(data, offsets)
            row = np.repeat(np.arange(b - a), np.diff(bounds))
            values, which = np.unique(hashes, return_inverse=True)
            if not len(values):
                continue
            toxic = batch.column(1).to_numpy()[a:b] == 1
            pairs = np.unique(row * len(values) + which)
            word = pairs % len(values)
            marked, uses = toxic[pairs // len(values)], toxic[row]
            counts = [np.bincount(word[marked == flag], minlength=len(values)) for flag in (True, False)]
            counts += [np.bincount(which[uses == flag], minlength=len(values)) for flag in (True, False)]
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *map(pa.array, counts)], ["word", *COUNTS])

    schema = ", ".join(f"{c} long" for c in ("word", *COUNTS))
    return rows.select("text", "toxic").mapInArrow(count, schema).groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS])


COUNTS = ("toxic", "clean", "toxic_uses", "clean_uses")


def classes_of(rows: DataFrame) -> tuple[float, float]:
    """Toxic and clean documents of the sample."""
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return float(n.get(1, 0)), float(n.get(0, 0))


def evidence_of(n1: float, n0: float) -> Column:
    """Likelihood-ratio statistic of an item's share of toxic and of clean documents being different."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    docs = F.col("toxic") + F.col("clean")
    return sum(
        (part(side, docs * m / (n1 + n0)) + part(m - side, (n1 + n0 - docs) * m / (n1 + n0)) for side, m in ((F.col("toxic"), n1), (F.col("clean"), n0))), F.lit(0.0)
    )


def stems_of(rows: DataFrame, least_documents: int = 10, chance: float = 0.05, least_ratio: float = 6.0) -> Stems:
    """Beginnings of words that mark toxic documents.

    At least ``least_documents`` toxic documents have it, they use it ``least_ratio`` times as often per document as clean ones
    do (one half added to both counts), and more of them have it by the test of :func:`vocabulary_of`. Of
    beginnings of one word the one with the strongest evidence counts.
    """
    n1, n0 = classes_of(rows)
    if not n1 or not n0:
        return NO_STEMS

    def items(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        letters, starts, ends, bounds, _ = letters_of(data, offsets)
        hashed, row = prefix_hashes(BYTE_VALUES[letters]), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        long = [np.flatnonzero(ends - starts >= length) for length in STEMS]
        found = np.concatenate([beginnings(hashed, starts[at], length) for at, length in zip(long, STEMS)])
        rows = np.concatenate([row[at] for at in long])
        order = np.argsort(rows, kind="stable")
        return found[order], np.searchsorted(rows[order], np.arange(len(bounds)))

    candidates = cut_lineage(counted(rows, items).where(F.col("toxic") >= least_documents))
    frequent = (F.col("toxic_uses") + 0.5) / n1 >= least_ratio * (F.col("clean_uses") + 0.5) / n0
    more = F.col("toxic") / n1 > F.col("clean") / n0
    judged = candidates.where(frequent & more).select("word", evidence_of(n1, n0).alias("evidence"))
    found = judged.toArrow()
    words, evidence = found["word"].to_numpy().astype(np.int64).view(np.uint64), found["evidence"].to_numpy().astype(float)
    strong = evidence >= least_evidence(evidence, candidates.count(), chance)
    order = np.argsort(words[strong])
    return Stems(words[strong][order], evidence[strong][order])


def vocabulary_of(rows: DataFrame, stems: Stems = NO_STEMS, least_documents: int = 3, chance: float = 0.05, least_ratio: float = 6.0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words of at least ``least_documents`` sampled documents, and which are toxic.

    Marked stems are toxic. Another word is toxic if toxic documents have it at ``least_ratio`` times the rate of clean ones at least (one
    half added to both counts), and more often by a likelihood-ratio statistic under which a share of ``chance`` of
    the toxic words is expected to be there by luck (Benjamini-Hochberg over all candidates). The sample bounds the words.
    """
    n1, n0 = classes_of(rows)
    if not n1 or not n0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)

    def items(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = words_of(data, offsets, stems)
        return words.hashes, words.bounds

    evidence = evidence_of(n1, n0)
    candidates = cut_lineage(counted(rows, items).where(F.col("toxic") + F.col("clean") >= least_documents))
    frequent = (F.col("toxic") + 0.5) / n1 >= least_ratio * (F.col("clean") + 0.5) / n0
    is_toxic = frequent & (evidence >= least_evidence(candidates.where(frequent).select(evidence.alias("x")).toArrow()["x"].to_numpy(), candidates.count(), chance))
    found = candidates.select("word", is_toxic.alias("is_toxic")).toArrow()
    words = found["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], found["is_toxic"].to_numpy().astype(bool)[order] | np.isin(words[order], stems.hashes)


def least_evidence(evidence: np.ndarray, tested: int, chance: float) -> float:
    """The least statistic (chi-square with one degree, upper side) that Benjamini-Hochberg accepts out of ``tested`` ones."""
    ordered = np.sort(evidence)[::-1]
    tail = np.array([erfc(sqrt(max(x, 0.0) / 2)) / 2 for x in ordered.tolist()])
    accepted = np.flatnonzero(tail <= chance * np.arange(1, len(ordered) + 1) / max(tested, 1))
    return float(ordered[accepted[-1]]) if len(accepted) else float("inf")


def fit_field(rows: DataFrame, stems: Stems, vocabulary: np.ndarray, toxic: np.ndarray, steps: int = 30, ridge: tuple[float, float, float] = (0.5, 8.0, 8.0)) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions under a ridge penalty per place; one job per step sums the gradient.

    A step divides each slope by an upper bound of its curvature, a quarter of the feature's count for
    each of the three places, so every step improves the likelihood.
    """
    context = rows.sparkSession.sparkContext
    shape = (3, len(vocabulary) + 2)
    weights, transitions = np.zeros(shape, np.float32), np.array([[0.0, -3.0], [0.0, -3.0]])
    words_known = context.broadcast((vocabulary, vocabulary[toxic]))
    counts, penalty = np.zeros(weights.size, np.float32), np.array(ridge, np.float32)[:, None]
    for step in range(steps):
        current = context.broadcast((weights, transitions))

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, marked = words_known.value
            field = Field(stems, known, *current.value, np.zeros(3))
            sums = [np.zeros(field.weights.size), np.zeros((2, 2)), np.zeros(field.weights.size)]
            for batch, a, b, data, offsets in over_slices(batches, 0):
                words = words_of(data, offsets, stems)
                if len(words.hashes):
                    of_toxic = np.repeat(batch.column(1).to_numpy()[a:b], np.diff(words.bounds)) == 1
                    for total, part in zip(sums, gradient(words, (of_toxic & np.isin(words.hashes, marked)).astype(float), field)):
                        total += part
            sums = [x.astype(np.float32) for x in sums[: 3 if step == 0 else 2]]  # the counts stay the same
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in sums], ["slope", "moves", "counts"][: len(sums)])

        names = ["slope", "moves"] + ["counts"] * (step == 0)
        slope, moves = np.zeros(weights.size, np.float32), np.zeros((2, 2))
        for r in rows.select("text", "toxic").mapInArrow(one, ", ".join(f"{c} binary" for c in names)).collect():
            slope += np.frombuffer(r["slope"], np.float32)
            moves += np.frombuffer(r["moves"], np.float32).reshape(2, 2)
            counts += np.frombuffer(r["counts"], np.float32) if step == 0 else 0
        weights = weights + (slope.reshape(shape) - penalty * weights) / (0.75 * counts.reshape(shape) + penalty)
        transitions = transitions + (moves - transitions) / (0.25 * counts[: shape[1]].sum() + 1)
        current.destroy()
    words_known.destroy()
    return weights, transitions


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 30, decay: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge, classes weighted equally."""
    design = np.column_stack([np.ones(len(x)), x])
    share = max(y.mean(), 1e-9) if len(y) else 0.5
    weight = np.where(y == 1, 0.5 / share, 0.5 / max(1 - share, 1e-9))
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (weight * (y - p)) - decay * w
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + decay * np.eye(3)
        w = w + np.linalg.solve(bend, slope)
    return w


def fit(
    documents: DataFrame, labels: DataFrame, training: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample_rows: int = 3000
) -> Field:
    """The field fitted on the labelled rows where ``training`` (over the id of ``labels``) holds.

    A document labelled more than once is toxic if any label says so. With labels of one class only, or
    none, every document gets the score 0.5 of an unfitted curve or the share the labels give.
    """
    rows = cut_lineage(sample(documents, labels, training, id_column, text_column, label_column, sample_rows))
    first = rows.where("part = 0").coalesce(FIT_TASKS)  # at most 2 x sample_rows documents, read once per step
    stems = stems_of(first)
    vocabulary, toxic = vocabulary_of(first, stems)
    unscored = Field(stems, vocabulary, *fit_field(first, stems, vocabulary, toxic), np.zeros(3))
    second = score(rows.where("part = 1").withColumn("doc_id", F.lit(None).cast("long")), unscored, keep=["toxic"])
    judged = second.select("toxic", "expected", "greatest").collect()
    x = np.array([(r["expected"], r["greatest"]) for r in judged]).reshape(-1, 2)
    return replace(unscored, curve=fit_curve(x, np.array([r["toxic"] for r in judged], float)))


def score(
    documents: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None, threshold: float = 0.5, prefix: str = ""
) -> DataFrame:
    """One row per document: doc_id, score, expected, greatest, spans (named with ``prefix``), and the columns of ``keep``.

    Only the text decides. ``spans`` lists start:end (code points, end exclusive) of the runs of words whose
    marginal reaches ``threshold``. A null text counts as empty; it has the score of a text without toxic
    words. Rows are judged one by one, so ids may repeat or be null; an empty table stays empty.
    """
    keep = keep or []
    source = documents.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("judged"), *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)]
    )
    doubles = [T.StructField(prefix + c, T.DoubleType()) for c in ("score", "expected", "greatest")]
    schema = T.StructType([replace_name(source.schema["doc_id"], prefix + "doc_id"), *doubles, T.StructField(prefix + "spans", T.StringType()), *[replace_name(source.schema[f"kept_{k}"], c) for k, c in enumerate(keep)]])
    arrow = to_arrow_schema(schema)
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch, a, b, data, offsets in over_slices(batches, 1):
            words = words_of(data, offsets, known.stems)
            p, _ = marginals(log_odds(features(words, known.vocabulary), known.weights), words.bounds, known.transitions)
            summary = summaries(p, words.bounds)
            value = 1 / (1 + np.exp(-np.clip(known.curve[0] + summary @ known.curve[1:], -30, 30)))
            columns = [batch.column(0).slice(a, b - a), pa.array(value), pa.array(summary[:, 0]), pa.array(summary[:, 1]), pa.array(spans_of(p >= threshold, words, data, offsets), pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(2 + k).slice(a, b - a) for k in range(len(keep))], schema=arrow)

    return source.mapInArrow(run, schema)


def without_toxic(documents: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text", limit: float = 0.7) -> DataFrame:
    """The documents whose score is below ``limit``; columns as before, which must have distinct names."""
    prefix = "_judged_"
    while any(c.lower().startswith(prefix) for c in documents.columns):
        prefix = f"_{prefix}"
    judged = score(documents, field, id_column, text_column, keep=documents.columns, prefix=prefix)
    return judged.where(F.col(f"{prefix}score") < limit).select(*documents.columns)


def replace_name(field: T.StructField, name: str) -> T.StructField:
    return T.StructField(name, field.dataType, field.nullable)


def spans_of(toxic: np.ndarray, words: Words, data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Per row the runs of toxic words as start:end in code points, comma-joined."""
    found: list[list[str]] = [[] for _ in range(len(offsets) - 1)]
    at = np.flatnonzero(toxic)
    if len(at):
        row = np.searchsorted(words.bounds, at, "right") - 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        opens = np.ones(len(at), bool)
        opens[1:] = (np.diff(at) > 1) | (np.diff(row) > 0)
        closes = np.append(opens[1:], True)
        for r, s, e in zip(row[opens].tolist(), words.starts[at[opens]], words.ends[at[closes]]):
            base = points[offsets[r]]
            found[r].append(f"{points[s] - base}:{points[e] - base}")
    return [",".join(x) for x in found]
