"""Language identification with a bit-sliced Bloom filter over letter n-grams.

One filter serves all languages: a slot holds one bit per language, and the conjunction of an n-gram's
slots is the mask of the languages whose training texts contain it. A document counts, per language,
the n-grams whose mask has its bit; the counts are corrected for the filter's false positives, which
follow from each language's share of set bits, and the largest corrected share decides.

The filter is fitted on a bounded sample of each language's training rows (``sample_rows``), picked by a
hash of the id. Fitting counts n-grams on the executors; the driver gets the finished slots, at most
``slots`` of them, whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage
from .textbytes import mix, slices, utf8

UNKNOWN = "und"
SLICE = 1 << 18


@dataclass(frozen=True)
class LanguageFilter:
    languages: tuple[str, ...]
    masks: np.ndarray  # slots x words of 64 languages
    width: int
    probes: int

    def false_positive_rate(self) -> np.ndarray:
        """Per language the chance that an absent n-gram is reported: the share of set bits to the power of the probes."""
        set_bits = [float((self.masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()) for i in range(len(self.languages))]
        return np.array(set_bits) ** self.probes


def held_out(doc_id: Column) -> Column:
    """True for the rows of the test fold: crc32 of the id as text modulo 3 is 1. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of a slice, the row of each, and per row whether it has a letter.

    Letters are lower-cased, any run of other characters is one separator, also at both ends of a text;
    an n-gram may begin or end with a separator, never with one inside.
    """
    rows = len(offsets) - 1
    data = np.where(data == 0, np.uint8(32), data)
    spread = np.zeros(len(data) + rows + 1, np.uint8)  # a zero byte before each row and at the end
    spread[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(offsets))] = data
    points = np.frombuffer(spread.tobytes().decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.cumsum(points == 0) - 1
    letters = np.where(letter_table()[points], points, np.uint32(0))
    keep = letters != 0
    has_letter = np.bincount(row[keep], minlength=rows)[:rows] > 0
    keep[0] = True
    keep[1:] |= letters[:-1] != 0  # the first separator after a letter stays
    letters, row = letters[keep].astype(np.uint64), row[keep]
    n = len(letters) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has_letter
    code, inside = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(width):
        code = code * np.uint64(0x110001) + letters[k : k + n]
        if 0 < k < width - 1:
            inside &= letters[k : k + n] != 0
    return mix(code[inside]), row[1 : n + 1][inside], has_letter


def slots_of(hashes: np.ndarray, slots: int, probes: int) -> list[np.ndarray]:
    """The slots of each n-gram, one array per probe: two halves of the hash combined."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return [((low + np.uint64(k) * high) % np.uint64(slots)).astype(np.int64) for k in range(probes)]


def fit(
    documents: DataFrame, training: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
    width: int = 3, slots: int = 1 << 20, probes: int = 3, sample_rows: int = 4000, least_share: float = 0.003,
    least_ratio: float = 0.25,
) -> LanguageFilter:
    """The filter of the rows where ``training`` holds and language and text are not null.

    An n-gram enters a language's bits if at least ``least_share`` of its sampled documents (and two of
    them, where there are that many) have it, and if it is there at least ``least_ratio`` times as
    frequent as in the language where it is most frequent: passages quoted in another language teach
    nothing. Without training rows the filter knows no language.
    """
    rows = documents.where(training & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang")
    )
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(found))
    if not languages:
        return LanguageFilter((), np.zeros((slots, 1), np.uint64), width, probes)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_rows / found[k]))])
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    unit = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.where(unit < share[F.col("lang")]).select("text", number[F.col("lang")].alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            lang = batch.column(1).to_numpy()
            for a, b in slices(offsets, SLICE):
                grams, row, _ = ngrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                owner = lang[a:b][row]
                for i in np.unique(owner):
                    values, which = np.unique(grams[owner == i], return_inverse=True)
                    pairs = np.unique(row[owner == i] * len(values) + which) % len(values)  # once per document
                    columns = [np.full(len(values), i, np.int32), values.view(np.int64), np.bincount(which), np.bincount(pairs)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["lang", "gram", "n", "docs"])

    counted = sample.mapInArrow(count, "lang int, gram long, n long, docs long").groupBy("gram", "lang").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = cut_lineage(counted)
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (i, max(min(2, found[k]), least_share * min(found[k], sample_rows)))])
    rate = F.col("n") / F.create_map(*[F.lit(x) for i in range(len(languages)) for x in (i, totals.get(i, 1))])[F.col("lang")]
    ranked = counted.withColumn("rate", rate).withColumn("most", F.max("rate").over(Window.partitionBy("gram")))
    kept = ranked.where((F.col("docs") >= least[F.col("lang")]) & (F.col("rate") >= least_ratio * F.col("most")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).to_numpy().astype(np.int64)
            for at in slots_of(batch.column(1).to_numpy().view(np.uint64), slots, probes):
                bit = np.uint64(1) << (lang % 64).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((lang // 64).astype(np.int32)), pa.array(bit.view(np.int64))], ["slot", "word", "bits"])

    placed = kept.select("lang", "gram").mapInArrow(place, "slot long, word int, bits long")
    table = placed.groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    masks = np.zeros((slots, (len(languages) + 63) // 64), np.uint64)
    masks[table["slot"].to_numpy(), table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return LanguageFilter(languages, masks, width, probes)


def shares(model: LanguageFilter, grams: np.ndarray, row: np.ndarray, rows: int, rates: np.ndarray) -> np.ndarray:
    """Per row and language, the corrected share of n-grams that the language's training texts contain."""
    at = slots_of(grams, len(model.masks), model.probes)
    total = np.maximum(np.bincount(row, minlength=rows)[:rows], 1)
    out = np.zeros((rows, len(model.languages)))
    for word in range(model.masks.shape[1]):
        mask = model.masks[at[0], word]
        for more in at[1:]:
            mask &= model.masks[more, word]
        for i in range(word * 64, min(len(model.languages), word * 64 + 64)):
            hit = (mask >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
            out[:, i] = np.bincount(row[hit], minlength=rows)[:rows] / total
    return np.clip((out - rates) / np.maximum(1 - rates, 1e-9), 0, 1)


def predict(documents: DataFrame, model: LanguageFilter, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    Only the text decides. The score is the best share over the sum of the two best. A text that is null
    or has no letter, and every text under an empty filter, is ``und`` with score 0; ties go to the first
    language in order. Rows are judged one by one, so ids may repeat or be null.
    """
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array([*known.languages, UNKNOWN], object)
        rates = known.false_positive_rate()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            best, score = np.full(len(batch), len(names) - 1), np.zeros(len(batch))
            for a, b in slices(offsets, SLICE) if known.languages else ():
                grams, row, has_letter = ngrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], known.width)
                share = shares(known, grams, row, b - a, rates)
                top = np.sort(np.column_stack([share, np.zeros(b - a)]), axis=1)[:, ::-1]
                best[a:b] = np.where(has_letter, share.argmax(axis=1), len(names) - 1)
                score[a:b] = np.where(has_letter & (top[:, 0] > 0), top[:, 0] / np.maximum(top[:, 0] + top[:, 1], 1e-12), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score)], schema=arrow)

    return source.mapInArrow(run, schema)
