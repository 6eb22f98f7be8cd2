"""Packing of token ids into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids fill whole windows as long as they can; what is left of it (less than one window) is
cut into quarters of a window and packed with the leftovers of its neighbours. A bounded run of leftovers is split into ``m`` windows by
differencing: every leftover starts as a partition of its own, and the two partitions with the largest
spread are merged again and again, the fullest windows of one onto the emptiest of the other, so that
their imbalances cancel. ``m`` starts at the least count that could hold the ids and rises whenever a
window exceeds the capacity. Documents are packed where they are read: no shuffle, no group that grows.
"""

from __future__ import annotations

import heapq
import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .textbytes import BYTE_VALUES, prefix_hashes, ragged, slices, span_hashes, utf8

#: fixed value: the pattern that cuts text before the merges of a byte-level vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: text encoded at a time, windows that leftovers are split into at a time, and cuts of a leftover
TEXT_BYTES, GROUP_WINDOWS, LEFTOVER_CUTS = 1 << 19, 32, 4
#: distinct chunks whose ids a task remembers before it starts over
CACHE_CHUNKS = 1_000_000
#: bytes that are a character which is not white space, and bytes that begin one
SURELY_FILLED = np.array([0x20 < b < 0x7F for b in range(256)])
STARTS_FILLED = SURELY_FILLED | np.array([b >= 0xC3 and b not in (0xE1, 0xE2, 0xE3) for b in range(256)])


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 as itself, the rest from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.room, self.size = np.zeros(1 << 10, kind), 0

    @property
    def filled(self) -> np.ndarray:
        return self.room[: self.size]

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            self.room = np.concatenate([self.filled, np.zeros(2 * end - self.size, self.room.dtype)])
        self.room[self.size : end] = values
        self.size = end


class Encoder:
    """Ids of texts under a byte-level BPE vocabulary file (JSON form of ``tokenizers``).

    Special tokens' strings are ordinary text. The ids are those of ``tokenizers``; the merges run in
    ``tiktoken``, several times as fast, since in such a vocabulary a token's id is its merge rank. A
    blank between two characters that are surely not white space always starts a token, so texts are cut
    there and a chunk met before (its bytes compared) is not encoded again.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"] for t in content["added_tokens"]}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.encode = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.forget()

    def forget(self) -> None:
        """Start over with no known chunk."""
        self.slot_hash, self.slot_number = np.zeros(1 << 21, np.uint64), np.full(1 << 21, -1, np.int64)
        self.places, self.counts, self.content_starts, self.content_lengths = (Growing(np.int64) for _ in range(4))
        self.known, self.content = Growing(np.uint32), Growing(np.uint8)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a slice, and the offsets of the rows among them."""
        blank = np.zeros(len(data) + 1, bool)
        if len(data) > 2:
            ends_word = SURELY_FILLED[data]
            ends_word[1:] |= (data[1:] >= 0x80) & (data[:-1] == 0xC3)  # the accented letters of Latin-1
            blank[1 : len(data) - 1] = (data[1:-1] == 0x20) & ends_word[:-2] & STARTS_FILLED[data[2:]]
            blank[offsets[:-1][offsets[:-1] < len(data)]] = False
            last = offsets[1:][np.diff(offsets) > 0] - 1
            blank[last] = False  # the blank after which a row ends
            first = offsets[:-1][np.diff(offsets) > 0]
        else:
            ends_word, first = np.zeros(len(data), bool), offsets[:-1][np.diff(offsets) > 0]
        edge = blank.copy()
        edge[first] = True
        starts = np.flatnonzero(edge[:-1])
        lengths = np.diff(np.append(starts, len(data)))
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes = span_hashes(prefix_hashes(BYTE_VALUES[data]), starts, starts + lengths)
        plain = blank[starts] & ends_word[starts + lengths - 1]
        number = self.numbers(data, starts, lengths, plain, hashes)
        counts = self.counts.filled[number]
        ids = self.known.filled[ragged(self.places.filled[number], counts)]
        totals = np.concatenate([[0], np.cumsum(counts)])
        return ids, totals[np.searchsorted(starts, offsets)]

    def numbers(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, plain: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The numbers of a slice's chunks; those not met before are encoded."""
        if len(self.places.filled) > CACHE_CHUNKS:
            self.forget()
        slot = (hashes & np.uint64(len(self.slot_hash) - 1)).astype(np.int64)
        number = np.where(self.slot_hash[slot] == hashes, self.slot_number[slot], -1)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            distinct, sample, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            sample = missing[sample]
            begin, length, easy = starts[sample], lengths[sample], plain[sample]
            joined = data[ragged(begin[easy], length[easy])].tobytes().decode()
            found = np.array(self.encode(joined), np.uint32)
            cuts = np.searchsorted(np.cumsum(self.lengths[found]), np.cumsum(length[easy])) + 1
            odd = [self.encode(data[s : s + n].tobytes().decode()) for s, n in zip(begin[~easy].tolist(), length[~easy].tolist())]
            counts, place = np.zeros(len(sample), np.int64), np.zeros(len(sample), np.int64)
            counts[easy] = np.diff(np.concatenate([[0], cuts]))
            counts[~easy] = [len(x) for x in odd]
            place[easy] = np.cumsum(counts[easy]) - counts[easy]
            place[~easy] = len(found) + np.cumsum(counts[~easy]) - counts[~easy]
            fresh = np.arange(len(sample)) + len(self.places.filled)
            number[missing] = fresh[which]
            self.slot_hash[slot[sample]], self.slot_number[slot[sample]] = distinct, fresh
            self.places.add(place + len(self.known.filled))
            self.counts.add(counts)
            self.known.add(np.concatenate([found, np.array([i for x in odd for i in x], np.uint32)]))
            self.content_starts.add(np.cumsum(length) - length + len(self.content.filled))
            self.content_lengths.add(length)
            self.content.add(data[ragged(begin, length)])
        same = lengths == self.content_lengths.filled[number]
        if not same.all() or not (data == self.content.filled[ragged(self.content_starts.filled[number], lengths)]).all():
            self.forget()  # two chunks with one hash: take every chunk of this slice as it is
            return self.numbers(data, starts, lengths, plain, np.arange(len(starts), dtype=np.uint64))
        return number


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def parts(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """The slices of a batch: first and last row, bytes; a row beyond ``limit`` bytes comes in several parts."""
    for row, end in slices(offsets, limit):
        start, stop = int(offsets[row]), int(offsets[end])
        while stop - start > limit and end == row + 1:
            window = data[start + limit // 2 : start + limit]
            cut = np.flatnonzero((window[1:-1] == 0x20) & SURELY_FILLED[window[:-2]] & SURELY_FILLED[window[2:]])
            if not len(cut):
                break
            middle = start + limit // 2 + 1 + int(cut[-1])
            yield row, row, data[start:middle]
            start = middle
        yield row, end, data[start:stop]


def differencing(sizes: list[int], m: int) -> tuple[list[list[int]], int]:
    """``m`` sets of positions of ``sizes`` with near-equal sums, and the largest sum."""
    parts: list[tuple[int, int]] = [(-1, -1)] * (len(sizes) + 1)  # the two parts of a merged window, none for an item
    heap = [(-s, i, [(s, i)] + [(0, 0)] * (m - 1)) for i, s in enumerate(sizes, 1)]  # window 0 is empty
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        b.reverse()
        merged = []
        for (x, p), (y, q) in zip(a, b):
            if p and q:
                parts.append((p, q))
                merged.append((x + y, len(parts) - 1))
            else:
                merged.append((x + y, p or q))
        merged.sort(reverse=True)
        least = merged[-1][0]  # only differences decide, so each partition is kept as such
        number += 1
        heapq.heappush(heap, (least - merged[0][0], number, [(x - least, p) for x, p in merged] if least else merged))
    windows = []
    for _, top in heap[0][2]:
        window, open_parts = [], [top] if top else []
        while open_parts:
            p, q = parts[node := open_parts.pop()]
            if p < 0:
                window.append(node - 1)
            else:
                open_parts += (p, q)
        windows.append(window)
    return windows, max(sum(sizes[i] for i in w) for w in windows)


def near_equal_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; every size is at most that."""
    m = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        windows, largest = differencing(sizes, m)
        if largest <= capacity:
            return [w for w in windows if w]
        m += 1


def packed(
    batches: Iterator[pa.RecordBatch], encoder: Encoder, capacity: int, end_id: int, schema: pa.Schema, task: int
) -> Iterator[pa.RecordBatch]:
    """Pieces of the documents of one partition; ``task`` keeps sequence numbers apart."""
    waiting: list[tuple] = []  # leftovers: id, start, length, crc, tokens of the document
    rows: list[tuple] = []
    sequence, held = task << 36, 0

    def flush() -> None:
        nonlocal sequence, held
        for window in near_equal_windows([w[2] for w in waiting], capacity) if waiting else []:
            offset = 0
            for i in window:
                rows.append((*waiting[i], sequence, offset))
                offset += waiting[i][2]
            sequence += 1
        waiting.clear()
        held = 0

    def add(doc, ids: np.ndarray) -> None:
        nonlocal sequence, held
        total, start = len(ids), 0
        while start < total:
            whole = total - start >= capacity
            length = capacity if whole else min(capacity // LEFTOVER_CUTS, total - start)
            crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
            if whole:
                rows.append((doc, start, length, crc, total, sequence, 0))
                sequence += 1
            else:
                waiting.append((doc, start, length, crc, total))
                held += length
                if held >= GROUP_WINDOWS * capacity:
                    flush()
            start += length

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows.clear()
        return made

    last = np.array([end_id], np.uint32)
    for arrived in batches:
        doc_ids = arrived.column(0)
        data, offsets = utf8(arrived.column(1))
        long: list[np.ndarray] = []  # the parts so far of a very long row
        for row, end, content in parts(data, offsets, TEXT_BYTES):
            if end == row:
                long.append(encoder.ids(content, np.array([0, len(content)]))[0])
                continue
            own = offsets[row : end + 1] - offsets[end] + len(content)
            own[0] = 0
            ids, bounds = encoder.ids(content, own)
            for k in range(row, end):
                mine = ids[bounds[k - row] : bounds[k - row + 1]]
                add(doc_ids[k].as_py(), np.concatenate([*long, mine, last]))
                long = []
            if rows:
                yield batch()
    flush()
    if rows:
        yield batch()


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece of a document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and still has the end id. Rows are documents of their own, also where ids
    repeat or are null. No rows in, no rows out. Other columns are not read. Sequence numbers are unique;
    a sequence's pieces lie in one partition.
    """
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in longs)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        yield from packed(batches, encoder, capacity, end_id, arrow, TaskContext.get().partitionId())
        encoder.forget()  # the process lives on and is used for other work

    return source.mapInArrow(run, schema)
