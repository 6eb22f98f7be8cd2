"""The plan that the two substring operators share: which windows of a corpus occur again.

A window is ``width`` consecutive elements (bytes or words) of one document. The least hash among a window's
runs of ``kmer`` elements is its minimiser; equal windows have equal minimisers at equal places, and
neighbouring windows mostly share one, so a run of windows travels as one string.

1. Documents are dealt into buckets of a bounded number of bytes. A bucket reports each minimiser it has
   once, with its count; minimisers that the corpus has once are done with. That is most of them.
2. Beside the minimisers that are left a bucket cuts the strings of their windows. Equal strings inside a
   bucket become one row, so no string has more rows than there are buckets.
3. Rows meet by minimiser, where the operator's own method finds equal windows. A minimiser with very many
   occurrences is dealt by window content instead, window by window.
4. The verdicts go back to the buckets, where the texts are.

The buckets' documents are shuffled once; Spark reuses that exchange for the three steps that need texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .textbytes import BYTE_VALUES, mix, prefix_hashes, ragged, span_hashes, utf8, word_hashes

BUCKET_BYTES = 4 << 20
#: elements handled at a time, and occurrences from which a minimiser is dealt by window content
BLOCK, CROWDED = 1 << 17, 4096
_PLACE = np.uint64((1 << 20) - 1)

STRINGS = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("minimiser", "part", "order_id", "bucket", "row", "start", "place", "count")] + [T.StructField("string", T.BinaryType())]
)
VERDICTS = T.StructType([T.StructField(c, T.LongType()) for c in ("bucket", "row", "first", "last")])


@dataclass(frozen=True)
class Scheme:
    width: int
    kmer: int
    words: bool
    crowded: int = CROWDED


class Bucket:
    """The documents of a bucket in the order of their ids: elements, their bounds by document, their bytes."""

    def __init__(self, table: pa.Table, scheme: Scheme):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.scheme, self.ids = scheme, table.column("doc_id").combine_chunks()
        data, offsets = utf8(pa.concat_arrays(table.column("text").chunks) if len(table) else pa.array([], pa.string()))
        self.content, self.bounds = data, offsets
        if scheme.words:  # bytes.split() cuts at the same white space
            words = [data[a:b].tobytes().split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            self.bounds = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
            self.content = np.frombuffer(b"".join(b" ".join(w) + b" " for w in words if w), np.uint8)
            self.ends = np.flatnonzero(self.content == 0x20)
            self.starts = np.append(0, self.ends[:-1] + 1)[: len(self.ends)]
            self.hashes = np.zeros(len(self.ends), np.uint64)
            for a in range(0, len(self.ends), BLOCK // 8):
                own = slice(a, a + BLOCK // 8)
                low, high = int(self.starts[own][0]), int(self.ends[own][-1])
                self.hashes[own] = word_hashes(self.content[low:high], self.starts[own] - low, self.ends[own] - low)
        self.n = int(self.bounds[-1])

    def values(self, a: int, b: int) -> np.ndarray:
        return self.hashes[a:b] if self.scheme.words else BYTE_VALUES[self.content[a:b]]

    def string(self, a: int, b: int) -> bytes:
        """The elements from a to b; words with one blank between."""
        return (self.content[self.starts[a] : self.ends[b - 1]] if self.scheme.words else self.content[a:b]).tobytes()

    def row_of(self, element: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, element, "right") - 1

    def runs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Per block: first window, number of windows, place of the minimiser, its hash, two hashes of the run's string."""
        width, kmer = self.scheme.width, self.scheme.kmer
        for a in range(0, self.n - width + 1, BLOCK):
            b = min(a + BLOCK + width - 1, self.n)
            values = self.values(a, b)
            prefix, second = prefix_hashes(values), prefix_hashes(mix(values))
            at = np.arange(len(values) - kmer + 1)
            hashes = span_hashes(prefix, at, at + kmer)
            least = sliding_minimum((hashes & ~_PLACE) | at.astype(np.uint64), width - kmer + 1)
            place = (least & _PLACE).astype(np.int64)
            first = np.arange(len(place))
            valid = a + first + width <= self.bounds[1:][self.row_of(a + first)]
            first, place = first[valid], place[valid]
            if not len(first):
                continue
            opens = np.ones(len(first), bool)
            opens[1:] = (place[1:] != place[:-1]) | (np.diff(first) > 1)
            begin = np.flatnonzero(opens)
            first, place, count = first[begin], place[begin], np.diff(np.append(begin, len(first)))
            end = first + count - 1 + width
            yield a + first, count, a + place, hashes[place].view(np.int64), span_hashes(prefix, first, end), span_hashes(second, first, end)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    least, done = values, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    rest = width - done
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def first_of_equal(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the first of each set of equal keys, how many are equal, and the indices of all others."""
    order = np.lexsort(keys[::-1])  # stable: the first index of equal ones leads
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0) if len(order) > 1 else new[1:]
    return order[new], np.diff(np.append(np.flatnonzero(new), len(order))), order[~new]


def minimisers(table: pa.Table, scheme: Scheme) -> pa.Table:
    """Each minimiser of a bucket once, with its count."""
    found = [h for _, _, _, h, _, _ in Bucket(table, scheme).runs()]
    values, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    bucket = np.full(len(values), table.column("bucket")[0].as_py() if len(table) else 0, np.int64)
    return pa.table({"minimiser": values, "bucket": bucket, "count": counts.astype(np.int64)})


def strings(table: pa.Table, repeated: pa.Table, scheme: Scheme) -> pa.Table:
    """The strings of the repeated minimisers of a bucket, and the verdicts on repeats inside the bucket.

    A verdict row has part -1 and covers windows of later ones of equal strings.
    """
    schema = to_arrow_schema(STRINGS)
    if not len(table) or not len(repeated):
        return schema.empty_table()
    bucket = Bucket(table, scheme)
    number = table.column("bucket")[0].as_py()
    known, total = repeated.column("minimiser").to_numpy(), repeated.column("total").to_numpy()
    order = np.argsort(known)
    known, total = known[order], total[order]
    plain, crowded = [], []
    for run in bucket.runs():
        at = np.minimum(np.searchsorted(known, run[3]), len(known) - 1)
        hit = known[at] == run[3]
        many = hit & (total[at] > scheme.crowded)
        plain.append([x[hit & ~many] for x in run])
        if many.any():
            crowded.append(single_windows(bucket, *[x[many] for x in run]))
    ids = bucket.ids
    out, last = [], np.iinfo(np.int64).max
    for parts, split in ((plain, False), (crowded, True)):
        if not parts:
            continue
        first, count, place, name, one, two = (np.concatenate(x) for x in zip(*parts))
        chosen, copies, others = first_of_equal(name, one, two)
        row = bucket.row_of(first[chosen])
        ordered = ids.take(pa.array(row)).cast(pa.int64()).fill_null(last).to_numpy()
        ends = first[chosen] + count[chosen] - 1 + scheme.width
        content = [bucket.string(x, y) for x, y in zip(first[chosen].tolist(), ends.tolist())]
        part = one[chosen].view(np.int64) if split else np.zeros(len(chosen), np.int64)
        start = first[chosen] - bucket.bounds[row]
        columns = [name[chosen], np.where(part == -1, 0, part), ordered, np.full(len(row), number), row, start, place[chosen] - first[chosen], copies]
        out.append(pa.Table.from_arrays([*(pa.array(np.asarray(c, np.int64)) for c in columns), pa.array(content, pa.binary())], schema=schema))
        # verdicts: neighbouring runs of a document in one row, spread by a hash of their own
        begin, length = joined_runs(first[others], count[others])
        row = bucket.row_of(begin)
        spread = mix(begin.astype(np.uint64) + np.uint64(number << 32)).view(np.int64)
        zeros = np.zeros(len(begin), np.int64)
        columns = [spread, zeros - 1, zeros, zeros + number, row, begin - bucket.bounds[row], zeros, length]
        out.append(pa.Table.from_arrays([*(pa.array(np.asarray(c, np.int64)) for c in columns), pa.nulls(len(begin), pa.binary())], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def joined_runs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows with those that follow one another without a gap joined; a document's end is a gap."""
    order = np.argsort(first, kind="stable")
    first, count = first[order], count[order]
    opens = np.ones(len(first), bool)
    opens[1:] = first[1:] != first[:-1] + count[:-1]
    return first[opens], np.add.reduceat(count, np.flatnonzero(opens)) if len(first) else count


def single_windows(bucket: Bucket, first: np.ndarray, count: np.ndarray, place: np.ndarray, name: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """Runs taken apart into windows, with the two hashes of each window's content."""
    width = bucket.scheme.width
    start, run = ragged(first, count), np.repeat(np.arange(len(first)), count)
    hashes = [np.zeros(len(start), np.uint64) for _ in range(2)]
    done = 0
    for a, n in zip(first.tolist(), count.tolist()):
        values, at = bucket.values(a, a + n - 1 + width), np.arange(n)
        for out, v in zip(hashes, (values, mix(values))):
            out[done : done + n] = span_hashes(prefix_hashes(v), at, at + width)
        done += n
    return [start, np.ones(len(start), np.int64), place[run], name[run], *hashes]


def repeats(
    documents: DataFrame, id_column: str, text_column: str, scheme: Scheme, solve: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    report: Callable[[pa.Table, pa.Table], pa.Table], result: T.StructType,
) -> DataFrame:
    """``report`` of every bucket's documents with the verdicts on them.

    ``solve`` maps sorted rows of STRINGS (whole groups of minimiser and part) to VERDICTS; ``report`` maps
    a bucket's documents and verdicts to rows of ``result``.
    """
    spark = documents.sparkSession
    source = documents.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.xxhash64("text").cast("string"))))
    dealt = source.withColumn("bucket", F.pmod(key, F.lit(buckets)).cast("long"))

    def of_bucket(table: pa.Table) -> pa.Table:
        return minimisers(table, scheme)

    seen = dealt.groupBy("bucket").applyInArrow(of_bucket, "minimiser long, bucket long, count long")
    totals = seen.withColumn("total", F.sum("count").over(Window.partitionBy("minimiser")))  # a row per bucket and minimiser
    repeated = totals.where("total > 1").select("bucket", "minimiser", "total")

    def cut(table: pa.Table, marked: pa.Table) -> pa.Table:
        return strings(table, marked, scheme)

    rows = dealt.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(cut, STRINGS)
    keys = ["minimiser", "part"]
    met = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "order_id", "bucket", "row", "start")
    verdicts = met.mapInArrow(solve, VERDICTS)
    return dealt.groupBy("bucket").cogroup(verdicts.groupBy("bucket")).applyInArrow(report, result)


def covered(bucket: Bucket, verdicts: pa.Table) -> np.ndarray:
    """Marks of the elements of a bucket that a repeated window covers; verdicts hold window starts, last exclusive."""
    edge = np.zeros(bucket.n + 1, np.int64)
    if len(verdicts):
        row, first, last = (verdicts.column(c).to_numpy() for c in ("row", "first", "last"))
        base = bucket.bounds[row]
        np.add.at(edge, base + first, 1)
        np.add.at(edge, base + last - 1 + bucket.scheme.width, -1)
    return np.cumsum(edge[:-1]) > 0


def verdict_batch(table: pa.Table, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Verdicts on the windows first to last (exclusive) of the strings of ``row``."""
    bucket, document, start = (table.column(c).to_numpy()[row] for c in ("bucket", "row", "start"))
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (bucket, document, start + first, start + last)], schema=to_arrow_schema(VERDICTS))


def passed_on(table: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
    """Verdicts that come ready from the buckets, and the indices of the rows to solve."""
    ready = table.column("part").to_numpy() == -1
    rows = np.flatnonzero(ready)
    return verdict_batch(table, rows, np.zeros(len(rows), np.int64), table.column("count").to_numpy()[rows]), np.flatnonzero(~ready)
