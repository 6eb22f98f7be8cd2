"""Target-distribution importance resampling over hashed word n-grams, counted with Arrow kernels.

Texts are lower-cased and split by Arrow (``ascii_lower``, ``split_pattern_regex``, ``list_flatten``), words
become dictionary indices (``dictionary_encode``), and shifted indices of one text form the n-grams. Only
distinct n-grams are joined and hashed; ``take`` carries the buckets back and a segment sum adds the gains
up per text. A first pass counts buckets in the documents and in the target texts, a second one scores.

Gains, weights and scores are whole numbers (thousandths, rounded down). The draw adds a Gumbel value per
document to its weight, so the highest scores are a sample without replacement from the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage
from .textbytes import slices

#: what separates words after lower-casing: all of ASCII but digits and letters
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SLICE = 10_000, 1 << 20


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of a slice of texts as a dictionary array, and where each text's begin."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("").cast(pa.large_string())), SEPARATORS)
    words, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    filled = pc.not_equal(words, "")  # a separator at either end leaves an empty word
    words, parents = words.filter(filled), parents[filled.to_numpy(zero_copy_only=False)]
    return words.dictionary_encode(), np.searchsorted(parents, np.arange(len(texts) + 1))


def buckets_of(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram of 1 to ``longest`` words, the row it is in (ascending), and each row's number of words."""
    words, begin = words_of(texts)
    spelled, place = words.dictionary, words.indices.to_numpy().astype(np.int64)
    counts = np.diff(begin)
    row = np.repeat(np.arange(len(counts)), counts)
    found, rows = [], []
    ids, names = place, [w.as_buffer().to_pybytes() if w.is_valid else b"" for w in spelled.cast(pa.large_binary())]
    for n in range(1, longest + 1):
        if n > 1:
            # runs of n words: the run of n - 1 that starts here and the word n - 1 places on, in one text
            inside = row[: len(row) - n + 1] == row[n - 1 :] if len(row) >= n else np.zeros(0, bool)
            starts = np.flatnonzero(inside)
            pairs, ids_of_pairs = np.unique(ids[starts] * len(spelled) + place[starts + n - 1], return_inverse=True)
            words_bytes = first_names
            names = [names[p // len(spelled)] + b" " + words_bytes[p % len(spelled)] for p in pairs.tolist()]
            ids = np.zeros(len(place), np.int64)
            ids[starts] = ids_of_pairs
        else:
            starts, first_names = np.arange(len(place)), names
        hashed = np.array([zlib.crc32(x) % buckets for x in names], np.int64)
        found.append(hashed.take(ids[starts]) if len(starts) else np.zeros(0, np.int64))
        rows.append(row[starts])
    if longest == 1:
        return found[0], rows[0], counts
    every = np.concatenate(rows)
    order = np.argsort(every, kind="stable")
    return np.concatenate(found)[order], every[order], counts


def text_slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, pa.Array]]:
    """Row ranges of about ``SLICE`` bytes of text, or one longer text."""
    texts = batch.column(column).fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    for a, b in slices(offsets - offsets[0], SLICE):
        yield a, b, texts.slice(a, b - a)


def bucket_counts(texts: DataFrame, text_column: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all rows fall into each bucket; what comes back is one number per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, part in text_slices(batch, 0):
                total += np.bincount(buckets_of(part, longest, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    counted = texts.select(F.col(text_column).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target and corpus frequency per bucket, one added to each count."""
    size = float(len(corpus))
    t, s = target.astype(float), corpus.astype(float)
    ratio = (t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(documents: DataFrame, gain: np.ndarray, id_column: str, text_column: str, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight (the mean gain, rounded down) of every row."""
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in text_slices(batch, 1):
                bucket, row, words = buckets_of(part, longest, len(gain))
                n = np.bincount(row, minlength=b - a)
                filled = np.flatnonzero(n)
                sums = np.zeros(b - a, np.int64)
                if len(filled):
                    sums[filled] = np.add.reduceat(gain.take(bucket), np.searchsorted(row, filled))
                weight = sums // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x, pa.int64()) for x in (words, n, weight))], schema=arrow)

    return source.mapInArrow(run, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel value, from the first 32 bits of a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    documents: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_column: str = "text",
    percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024,
) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score and rank (null where the row is not drawn).

    Of the N rows with at least ``least_words`` words the floor(percent * N / 100) highest scores are drawn,
    ties to the smaller id, then to fewer features and the smaller weight. A null or empty text has no
    features and the weight 0, as has a text without words; a null id scores like an empty one and comes
    last among ties. Rows are taken one by one, so ids may repeat (their noise is the same). Without target
    texts all counts there are 0. An empty table gives an empty result.

    Ranks come from one range sort of narrow rows: each range is written with its number, ranges are counted,
    and a row's rank is its place in its range after all rows of the ranges before.
    """
    target_texts = target.select(F.col(target_column).cast("string").alias("text"))
    corpus = bucket_counts(documents, text_column, longest, buckets)
    gain = gains(bucket_counts(target_texts, "text", longest, buckets), corpus)
    rows = weighed(documents, gain, id_column, text_column, longest)
    scored = rows.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("open"))
    scored = cut_lineage(scored)  # the range sort reads its input twice, and texts are read once only
    order = [F.desc("open"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    # the upper part of the number is the range, the lower 33 bits the place in it
    placed = cut_lineage(dealt.withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"], r["n_open"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("open").alias("n_open")).collect())  # one row per range
    before, offsets = 0, []
    for number, n, _ in sizes:
        offsets.append((int(number), before))
        before += n
    drawn = sum(n_open for *_, n_open in sizes) * percent // 100
    starts = documents.sparkSession.createDataFrame(offsets, "part long, before long")
    rank = F.col("before") + place + 1
    numbered = placed.withColumn("part", part).join(F.broadcast(starts), "part", "left")  # one row per range
    return numbered.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
