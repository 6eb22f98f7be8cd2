"""Trailing means and deviations of many ordered series.

A window function works a trailing frame out anew for every row, at a cost of its length in calls. Here Spark deals and sorts
the series, and Arrow batches of many series, or of a part of one, are worked on at once: each place of the frame is one
array operation over all rows. Sums and deviations are built up in the order of the window function, from the frame's
first row to its last, and agree with it to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .quantiles import blocks

# Name of the new column to (kind, column, rows of the frame), kind being a key of KINDS.
Frames = Mapping[str, tuple[str, str, int]]


def _mean(x: np.ndarray, rows: int) -> np.ndarray:
    n = len(x) - rows + 1
    total = np.zeros(n)
    for k in range(rows):
        total += x[k : k + n]
    return total / rows


def _deviation(x: np.ndarray, rows: int) -> np.ndarray:
    n = len(x) - rows + 1
    mean, squares = np.zeros(n), np.zeros(n)
    for k in range(rows):
        delta = x[k : k + n] - mean
        step = delta / (k + 1.0)
        mean += step
        squares += delta * (delta - step)
    return np.sqrt(squares / (rows - 1.0))


KINDS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"mean": _mean, "deviation": _deviation}


def _frame_values(column: pa.ChunkedArray, first: np.ndarray, kind: str, rows: int) -> pa.Array:
    """One value per row, null unless the frame lies in the row's series, from row ``first`` on, and holds ``rows`` non-null inputs."""
    out, known = np.zeros(len(column)), np.zeros(len(column), bool)
    if len(column) >= rows:
        present = np.concatenate([[0], np.cumsum(column.is_valid().to_numpy())])
        begin = np.arange(len(column) - rows + 1)
        known[rows - 1 :] = (present[rows:] - present[:-rows] == rows) & (begin >= first[rows - 1 :])
        with np.errstate(all="ignore"):
            out[rows - 1 :] = KINDS[kind](column.fill_null(0.0).to_numpy(), rows)
    return pa.array(out, mask=~known)


def _series_starts(keys: Sequence[pa.ChunkedArray], rows: int) -> np.ndarray:
    """For every row the first row of its series; a null key is a key like any other."""
    begins = np.zeros(rows, bool)
    begins[:1] = True
    for key in keys:
        codes = key.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        begins[1:] |= codes[1:] != codes[:-1]
    return np.maximum.accumulate(np.where(begins, np.arange(rows), 0))


def trailing_frames(df: DataFrame, keys: Sequence[str], order: Sequence[str], frames: Frames) -> DataFrame:
    """``df`` with a column per frame over the rows up to and including the current one; null while a frame is not full.

    ``order`` must identify a row within its keys. Series are dealt whole: cut long ones, see
    :func:`tidemark.operators.segments.over_series`. The framed columns are doubles.
    """
    if shorter := [name for name, (kind, _, rows) in frames.items() if rows < (2 if kind == "deviation" else 1)]:
        raise ValueError(f"frames with too few rows: {', '.join(shorter)}")
    framed = {c: df.schema[c].dataType.simpleString() for _, c, _ in frames.values()}
    if other := [c for c, kind in framed.items() if kind != "double"]:
        raise ValueError(f"not doubles: {', '.join(other)}")
    reach = max(rows for _, _, rows in frames.values()) - 1
    needed = list(dict.fromkeys([*keys, *framed]))
    zoned = pa.timestamp("us", "UTC")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.Table | None = None  # the rows that the frames of the next batch reach into
        for batch in blocks(batches):
            own = pa.Table.from_batches([batch])
            table = own.select(needed) if before is None else pa.concat_tables([before, own.select(needed)])
            first = _series_starts([table[k] for k in keys], len(table))
            made = [_frame_values(table[c], first, kind, rows).slice(len(table) - len(own)) for kind, c, rows in frames.values()]
            kept = [c.cast(zoned) if pa.types.is_timestamp(c.type) and c.type.tz else c for c in own.columns]
            yield from pa.Table.from_arrays([*kept, *made], names=[*own.column_names, *frames]).to_batches()
            before = table.slice(max(0, len(table) - reach))

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in df.schema], *[T.StructField(name, T.DoubleType()) for name in frames]])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
