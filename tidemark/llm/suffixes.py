"""Suffix-array dedup over bytes: every byte that an earlier 100-byte string covers again is removed.

Suffixes are sorted by mergesort. Two suffixes are compared by their longest common extension: prefix
polynomial hashes tell in constant time whether two strings of one length are equal, so a binary search
over the length needs logarithmically many hash comparisons and one byte decides. Neighbours in the sorted
order with a common extension of the whole width are equal strings; their bytes are compared once more, so
a hash collision cannot pass. Merging is done for all runs of all buckets of a batch at once: the place of
an element in the merged run is its place in its own run plus a binary search in the other.

The suffixes come by minimiser (see ``repeats``): equal strings have the same minimiser at the same place,
so only suffixes of one bucket and place are sorted together, truncated to the width.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .grouped import whole_groups
from .repeats import CROWDED, Bucket, Scheme, covered, passed_on, repeats, verdict_batch
from .textbytes import BYTE_VALUES, powers, prefix_hashes, ragged

WIDTH, KMER = 100, 20
#: suffixes sorted at a time, but for a single larger group
SUFFIXES = 1 << 18


class Suffixes:
    """Suffixes of a text, truncated to ``width`` bytes, that compare by hash."""

    def __init__(self, text: np.ndarray, width: int):
        self.text, self.width = text, width
        self.prefix = prefix_hashes(BYTE_VALUES[text])
        self.inverse = powers(len(self.prefix))[1]

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Whether the strings of ``length`` at a and b have equal hashes."""
        left = (self.prefix[a + length] - self.prefix[a]) * self.inverse[a]
        return left == (self.prefix[b + length] - self.prefix[b]) * self.inverse[b]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension at a and b, at most the width: binary search over hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.width)
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = self.same(a, b, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the suffix at a sorts before the one at b, and whether they are equal."""
        length = self.common(a, b)
        equal = length == self.width
        step = np.minimum(length, self.width - 1)
        return self.text[a + step] < self.text[b + step], equal

    def sort(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes by group and content, equal ones in the given order; ``group`` ascends."""
        n = len(start)
        opens = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(opens, n))
        first, size = np.repeat(opens, sizes), np.repeat(sizes, sizes)
        order, slot, length = np.arange(n), np.arange(n) - np.repeat(opens, sizes), 1
        while length < size.max(initial=0):
            moving = np.flatnonzero(size > length)  # groups that are one run are done
            base, own = first[moving], slot[moving] // length
            other = own ^ 1
            low = np.minimum(other * length, size[moving]) + base
            high = np.minimum(other * length + length, size[moving]) + base
            begin, mine = low.copy(), start[order[moving]]
            active = np.flatnonzero(low < high)
            while len(active):
                middle = (low[active] + high[active]) // 2
                less, equal = self.before(start[order[middle]], mine[active])
                goes_first = np.where(equal, other[active] < own[active], less)
                low[active] = np.where(goes_first, middle + 1, low[active])
                high[active] = np.where(goes_first, high[active], middle)
                active = active[low[active] < high[active]]
            place = base + np.minimum(own, other) * length + slot[moving] % length + (low - begin)
            merged = order.copy()
            merged[place] = order[moving]
            order, length = merged, length * 2
        return order

    def equal_neighbours(self, start: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Marks the places of the order whose suffix equals the one before, byte by byte."""
        again = np.zeros(len(order), bool)
        if len(order) > 1:
            a, b = start[order[:-1]], start[order[1:]]
            near = np.flatnonzero((group[order[1:]] == group[order[:-1]]) & self.same(a, b, self.width))
            for part in np.array_split(near, len(near) // 20_000 + 1):
                offsets = np.arange(self.width)
                again[part + 1] = (self.text[a[part][:, None] + offsets] == self.text[b[part][:, None] + offsets]).all(axis=1)
        return again


def repeated_suffixes(text: np.ndarray, start: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Marks the suffixes that equal an earlier one of their group; ``group`` ascends.

    A hash collision would leave equal strings apart or unequal ones together; the latter is seen and such
    a group is sorted by its bytes.
    """
    suffixes = Suffixes(text, width)
    order = suffixes.sort(start, group)
    again = suffixes.equal_neighbours(start, group, order)
    marks = np.zeros(len(start), bool)
    marks[order[again]] = True
    if len(order) > 1:
        hashed = suffixes.same(start[order[:-1]], start[order[1:]], width) & (group[order[1:]] == group[order[:-1]])
        for wrong in np.unique(group[order[1:]][hashed & ~again[1:]]):
            seen: set[bytes] = set()
            for i in np.flatnonzero(group == wrong):
                string = text[start[i] : start[i] + width].tobytes()
                marks[i] = string in seen
                seen.add(string)
    return marks


def solver(width: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, [0, 1]):
            ready, open_rows = passed_on(table)
            if len(ready):
                yield ready
            number = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[open_rows]
            column, place = table.column("string"), table.column("place").to_numpy()
            # of equal strings the first goes on, the later ones are repeats as a whole
            strings = column.take(pa.array(open_rows)).to_pylist()
            seen: dict[tuple[int, bytes], int] = {}
            for i, key in enumerate(zip(number.tolist(), strings)):
                seen.setdefault(key, i)
            first = np.fromiter(seen.values(), np.int64, len(seen))
            later = np.ones(len(open_rows), bool)
            later[first] = False
            if later.any():
                again = np.flatnonzero(later)
                whole = np.array([len(strings[i]) for i in again.tolist()], np.int64) - width + 1
                yield verdict_batch(table, open_rows[again], np.zeros(len(again), np.int64), whole)
            several = np.bincount(number[first], minlength=len(bounds))[number[first]] > 1  # a string alone has no equal window
            kept = first[several]
            rows, number, strings = open_rows[kept], number[kept], [strings[i] for i in kept.tolist()]
            lengths = np.array([len(x) for x in strings], np.int64)
            windows = lengths - width + 1
            done = np.cumsum(windows)
            cuts = [0]
            while cuts[-1] < len(rows):  # whole groups of about SUFFIXES windows
                at = int(np.searchsorted(done, (done[cuts[-1] - 1] if cuts[-1] else 0) + SUFFIXES, "right"))
                at = min(max(at, cuts[-1] + 1), len(rows))
                while at < len(rows) and number[at] == number[at - 1]:
                    at += 1
                cuts.append(at)
            for a, b in zip(cuts[:-1], cuts[1:]):
                text = np.frombuffer(b"".join(strings[a:b]), np.uint8)
                of = np.repeat(np.arange(a, b), windows[a:b])
                begin = np.cumsum(lengths[a:b]) - lengths[a:b]
                start = ragged(begin, windows[a:b])
                offset = place[rows[of]] - (start - begin[of - a])  # where the window has the minimiser
                group = (number[of] - number[a]) * (width + 1) + offset
                order = np.argsort(group, kind="stable")
                marks = np.zeros(len(start), bool)
                marks[order] = repeated_suffixes(text, start[order], group[order], width)
                hit = np.flatnonzero(marks)
                if len(hit):
                    new = np.ones(len(hit), bool)
                    new[1:] = (np.diff(hit) > 1) | (of[hit][1:] != of[hit][:-1])
                    first, last = hit[new], hit[np.append(new[1:], True)]
                    base = (start - begin[of - a])
                    yield verdict_batch(table, rows[of[first]], base[first], base[last] + 1)

    return solve


def remove_repeats(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, kmer: int = KMER, keep_text: bool = False, crowded: int = CROWDED
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (remaining bytes concatenated).

    A byte goes if a string of ``width`` bytes that covers it also starts earlier: in a document with a
    smaller id (nulls last, rows of one id in the order of their texts) or earlier in the same one. Strings
    are judged on the input. A null text is empty. With ``keep_text`` the remaining bytes are in ``text``,
    cut characters replaced.
    """
    scheme = Scheme(width, kmer, words=False, crowded=crowded)
    id_field = T.StructField("doc_id", documents.schema[id_column].dataType)
    longs = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([id_field, *longs, T.StructField("kept_sha256", T.StringType())] + [T.StructField("text", T.StringType())] * keep_text)
    arrow = to_arrow_schema(schema)

    def report(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not len(table):
            return arrow.empty_table()
        bucket = Bucket(table, scheme)
        gone = covered(bucket, verdicts)
        removed, spans, texts = [], [], []
        for a, b in zip(bucket.bounds[:-1].tolist(), bucket.bounds[1:].tolist()):
            own = gone[a:b]
            removed.append(int(own.sum()))
            spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
            texts.append(bucket.content[a:b][~own].tobytes())
        columns = [bucket.ids, pa.array(np.diff(bucket.bounds)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
        return pa.Table.from_arrays(columns + [pa.array([t.decode("utf-8", "replace") for t in texts])] * keep_text, schema=arrow)

    return repeats(documents, id_column, text_column, scheme, solver(width), report, schema).select(*[F.col(c) for c in schema.names])
