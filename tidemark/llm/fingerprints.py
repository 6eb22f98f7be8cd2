"""MinHash fingerprints of documents, and near pairs by banded signatures with verified Jaccard.

A text's shingles are its runs of five lower-cased words (the whole sequence where there are fewer). Each
of ``PERMUTATIONS`` universal hash functions is applied to all shingles of a slice at once in numpy, and
the least value per text is one component. Equal texts have equal fingerprints; the share of equal
components estimates the Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .textbytes import LOWER, distinct_per_row, mix, shingle_hashes, slices, utf8, word_bounds, word_hashes

PERMUTATIONS, WIDTH = 128, 5
SLICE = 1 << 18
_COEFFICIENTS = np.random.default_rng(11).integers(1, 1 << 63, (2, 1024), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a slice, repeats included, and where each row's begin."""
    lowered = LOWER[data]
    starts, ends, bounds = word_bounds(lowered, offsets)
    return shingle_hashes(word_hashes(lowered, starts, ends), bounds, WIDTH)


def signatures(hashes: np.ndarray, begin: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Rows x permutations of 16-bit minima under universal hashing; a row without shingles has the largest value throughout.

    Each function multiplies and adds modulo 2**64 and keeps the high half; the least 32-bit value is
    scrambled to 16 bits, so that equal components mean equal minima but for one pair in 65,536.
    """
    rows = len(begin) - 1
    out = np.full((rows, permutations), 0xFFFF, np.uint16)
    filled = np.flatnonzero(np.diff(begin))
    if not len(filled):
        return out
    a, b = _COEFFICIENTS[0, :permutations], _COEFFICIENTS[1, :permutations]
    work = np.empty_like(hashes)
    for k in range(permutations):
        np.multiply(hashes, a[k], out=work)
        np.add(work, b[k], out=work)
        np.right_shift(work, np.uint64(32), out=work)
        out[filled, k] = (mix(np.minimum.reduceat(work, begin[filled])) >> np.uint64(48)).astype(np.uint16)
    return out


def to_text(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def code_points(data: np.ndarray) -> np.ndarray:
    """Where each code point of a UTF-8 buffer starts."""
    return np.flatnonzero((data & 0xC0) != 0x80)


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles (distinct), fingerprint (hexadecimal).

    A null text is empty; a text without words has no shingles and the fingerprint of all ones. Rows are
    taken one by one, so ids may repeat or be null. An empty table gives an empty result.
    """
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("fingerprint", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            counts, texts = [], []
            for a, b in slices(offsets, SLICE):
                hashes, begin = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                texts += map(to_text, signatures(hashes, begin))
                counts += np.diff(distinct_per_row(hashes, begin)[1]).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(texts, pa.string())], schema=arrow)

    return source.mapInArrow(run, schema)


def likeness(a: Column, b: Column, permutations: int = PERMUTATIONS) -> Column:
    """Share of equal components of two fingerprints."""
    equal = F.lit(0)
    for k in range(permutations):
        equal = equal + (F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int")
    return equal / F.lit(float(permutations))


def edit_report(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", classes: DataFrame | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the neighbours' are.

    The next document is the one with the next smaller id, after the smallest the largest; rows of one id
    follow by a hash of their text, null ids come last. The edited text keeps a text's first half and goes
    on with as many code points of the next document's beginning (or all of them). One row per input row.

    Documents are dealt by ranges of ids whose limits are quantiles of the ids; the first row of each
    range also goes to the range before it, so a range knows what follows its last row. Only ids are
    gathered, one per range. With ``classes`` (doc_id, class_id, n_linked; one row per id) its columns come along: its rows
    go to the ranges as the documents do, so the report needs no join.
    """
    spark = documents.sparkSession
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    limits = source.select(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], 10_000).alias("q")).first()["q"]
    # range 0 holds the largest ids; null ids are in the last range
    cuts = [float("-inf"), *sorted({-float(q) for q in limits or [0]}), float("inf")]
    bucketizer = Bucketizer(splits=cuts, inputCol="negated", outputCol="range")

    def ranged(rows: DataFrame) -> DataFrame:
        negated = rows.withColumn("negated", F.coalesce(-F.col("doc_id").cast("double"), F.lit(float("inf"))))
        return bucketizer.transform(negated).withColumn("range", F.col("range").cast("int"))

    numbered = ranged(source.withColumn("tie", F.xxhash64("text")))
    # the first row of each range: the greatest id and of its rows the greatest tie
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.col("tie"))
    firsts = {r["range"]: r["top"] for r in numbered.groupBy("range").agg(F.max(order).alias("top")).collect()}
    present = sorted(firsts)
    # the last range comes before the first: the round closes
    rows = [(here, present[k - 1], firsts[here]["doc_id"], firsts[here]["tie"]) for k, here in enumerate(present)]
    edges = spark.createDataFrame(rows, T.StructType([T.StructField("f_range", T.IntegerType()), T.StructField("before", T.IntegerType()), T.StructField("f_id", source.schema["doc_id"].dataType), T.StructField("f_tie", T.LongType())]))
    same = (F.col("range") == F.col("f_range")) & (F.col("tie") == F.col("f_tie")) & F.col("doc_id").eqNullSafe(F.col("f_id"))
    marked = numbered.join(F.broadcast(edges), same, "left")  # one row per range
    own = F.struct(F.col("range"), F.lit(True).alias("own"))
    halo = F.struct(F.col("before").alias("range"), F.lit(False).alias("own"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, halo))
    dealt = marked.select("doc_id", "text", "tie", F.explode(places).alias("at")).select("doc_id", "text", "tie", "at.*")
    carried = ["class_id", "n_linked"] if classes is not None else []
    if classes is not None:
        known = ranged(classes.where(F.col("doc_id").isNotNull())).select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("tie"), "range", F.lit(True).alias("own"), *carried)
        dealt = dealt.select("*", *[F.lit(None).cast("long").alias(c) for c in carried]).withColumn("is_class", F.lit(0)).unionByName(known.withColumn("is_class", F.lit(1)))
    else:
        dealt = dealt.withColumn("is_class", F.lit(0))
    # one range per task, also where hashes of the range numbers would fall together
    sorted_rows = dealt.repartitionById(max(1, present[-1] + 1 if present else 1), F.col("range")).sortWithinPartitions("range", F.desc("own"), F.desc_nulls_last("doc_id"), F.desc("is_class"), F.desc("tie"))
    longs, texts, doubles = ["n_chars"], ["edited_sha256", "fingerprint", "edited_fingerprint"], ["near_edited", "near_next"]
    schema = T.StructType(
        [source.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in longs), *(T.StructField(c, T.StringType()) for c in texts), *(T.StructField(c, T.DoubleType()) for c in doubles), *(T.StructField(c, T.LongType()) for c in carried)]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from edited(batches, arrow)

    return sorted_rows.select("doc_id", "text", "range", "own", "is_class", *carried).mapInArrow(run, schema)


def edited(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of one partition in order: doc_id, text, range, own, is_class, class columns; each document is compared with the one after it.

    A class row stands before the documents of its id.
    """
    held: tuple | None = None  # the row that waits for the next: id, bytes, range, class columns
    closing = None  # a range's extra row is taken once, however many rows equal it
    waiting: list[tuple] = []
    known: tuple = (None, None)  # id and class columns of the last class row

    def flush() -> pa.RecordBatch:
        made = compare(waiting, schema)
        waiting.clear()
        return made

    size = 0
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        ids, ranges, owns, kinds = batch.column(0), *(batch.column(k).to_pylist() for k in (2, 3, 4))
        classes = list(zip(*(batch.column(k).to_pylist() for k in range(5, batch.num_columns)))) or [()] * len(batch)
        none = (None,) * (batch.num_columns - 5)
        for k, (number, own, kind) in enumerate(zip(ranges, owns, kinds)):
            if kind:
                known = (ids[k].as_py(), classes[k])
                continue
            mine = known[1] if known[1] is not None and known[0] == ids[k].as_py() else none
            row = (ids[k], data[offsets[k] : offsets[k + 1]].copy(), number, mine)
            if own:
                if held is not None and held[2] == number:
                    waiting.append((held[0], held[1], row[1], held[3]))
                    size += len(held[1])
                held = row
            elif closing != number:
                closing = number
                waiting.append((held[0], held[1], row[1], held[3]))
                size += len(held[1])
                held = None
            if size >= SLICE:
                yield flush()
                size = 0
    if waiting:
        yield flush()


def compare(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of (id, text bytes, next text's bytes, class columns) to rows of the report."""
    plain, changed, counts, hashes = [], [], [], []
    for _, own, following, _ in rows:
        starts = code_points(own)
        n = len(starts)
        counts.append(n)
        half = n // 2
        cut = int(starts[n - half]) if half else len(own)
        after = code_points(following)
        new = np.concatenate([own[:cut], following[: int(after[half])] if half < len(after) else following])
        plain.append(own)
        changed.append(new)
        hashes.append(hashlib.sha256(new.tobytes()).hexdigest())
    prints = []
    for texts in (plain, changed, [r[2] for r in rows]):
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        prints.append(signatures(*shingles(np.concatenate(texts), offsets)))
    own, new, following = prints
    columns = [
        [r[0].as_py() for r in rows], counts, hashes, [to_text(x) for x in own], [to_text(x) for x in new], (own == new).mean(axis=1), (own == following).mean(axis=1),
        *zip(*(r[3] for r in rows)),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
