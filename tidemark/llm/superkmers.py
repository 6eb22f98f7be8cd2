"""Substring dedup over words: every word that lies in a window occurring more than once is removed.

Super-k-mers: consecutive windows that share a minimiser travel as one packed string to the minimiser's
bucket; there all windows are sorted and equal neighbours counted, which is exact.
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
from .textbytes import ragged

WIDTH, KMER = 35, 6


def repeated_windows(packed: list[bytes], counts: np.ndarray, width: int) -> tuple[list[int], list[int]]:
    """(string, window) of every window that the strings, each occurring ``counts`` times, hold more than once."""
    members: dict[bytes, list[int]] = {}
    for i, string in enumerate(packed):
        members.setdefault(string, []).append(i)
    own = list(members.values())
    counts = [sum(int(counts[i]) for i in m) for m in own]
    windows = []
    for i, string in enumerate(members):
        words = string.split(b" ")
        for j in range(len(words) - width + 1):
            windows.append((b" ".join(words[j : j + width]), i, j))
    windows.sort()
    strings, places = [], []
    start = 0
    while start < len(windows):
        end = start + 1
        while end < len(windows) and windows[end][0] == windows[start][0]:
            end += 1
        if end - start > 1 or counts[windows[start][1]] > 1:
            for _, i, j in windows[start:end]:
                strings += own[i]
                places += [j] * len(own[i])
        start = end
    return strings, places


def joined_places(rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings with the first place and the end of each run of places that follow one another."""
    order = np.lexsort((places, rows))
    rows, places = rows[order], places[order]
    opens = np.ones(len(rows), bool)
    opens[1:] = (rows[1:] != rows[:-1]) | (places[1:] != places[:-1] + 1)
    return rows[opens], places[opens], places[np.append(opens[1:], True)] + 1


def solver(width: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, [0, 1]):
            ready, _ = passed_on(table)
            if len(ready):
                yield ready
            part, counts, strings = table.column("part").to_numpy(), table.column("count").to_numpy(), table.column("string")
            rows, places = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if part[a] != -1 and (b - a > 1 or counts[a] > 1):  # a string alone has no equal window
                    found = repeated_windows([s.as_py() for s in strings.slice(a, b - a)], counts[a:b], width)
                    rows += [a + i for i in found[0]]
                    places += found[1]
            if rows:
                yield verdict_batch(table, *joined_places(np.array(rows, np.int64), np.array(places, np.int64)))

    return solve


def remove_repeats(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, kmer: int = KMER, keep_text: bool = False, crowded: int = CROWDED
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one blank).

    A word goes if a window of ``width`` words that covers it occurs anywhere else, in the same document
    too. A null text has no words. Rows are documents of their own: rows that repeat id and text remove each
    other's windows. With ``keep_text`` the kept words are in ``text``.
    """
    scheme = Scheme(width, kmer, words=True, crowded=crowded)
    id_field = T.StructField("doc_id", documents.schema[id_column].dataType)
    fields = [id_field, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("text", T.StringType())] * keep_text)
    arrow = to_arrow_schema(schema)

    def report(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not len(table):
            return arrow.empty_table()
        bucket = Bucket(table, scheme)
        kept = ~covered(bucket, verdicts)
        n = np.diff(bucket.bounds)
        texts = []
        for a, b in zip(bucket.bounds[:-1].tolist(), bucket.bounds[1:].tolist()):
            words = a + np.flatnonzero(kept[a:b])
            joined = bucket.content[ragged(bucket.starts[words], bucket.ends[words] - bucket.starts[words] + 1)]
            texts.append(joined[:-1].tobytes())
        removed = n - np.add.reduceat(np.append(kept, False).astype(np.int64), bucket.bounds[:-1]) * (n > 0)
        columns = [bucket.ids, pa.array(n), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
        return pa.Table.from_arrays(columns + [pa.array([t.decode("utf-8", "replace") for t in texts])] * keep_text, schema=arrow)

    return repeats(documents, id_column, text_column, scheme, solver(width), report, schema).select(*[F.col(c) for c in schema.names])
