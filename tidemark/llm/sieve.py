"""A Bloom filter of fixed size in front of an exchange: rows whose key is surely not wanted stay where they are.

The join behind it stays exact. With more keys than the filter is made for more rows pass, never fewer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: 4 MB; 2 million keys let some hundredth of the other rows pass
BITS = 1 << 25


def positions(hashed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a 64-bit hash."""
    h = hashed.astype(np.int64).view(np.uint64)
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def sieve(keys: DataFrame, bits: int = BITS) -> Callable[[Column], Column]:
    """A test on a column of the type of ``keys``' only one: false if its value surely is no key, null counts as no key."""
    key = F.xxhash64(keys.columns[0])
    word, bit = (lambda at: F.shiftright(at, 6)), (lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")))
    hashed = keys.where(F.col(keys.columns[0]).isNotNull()).select(key.alias("h"))
    places = hashed.select(F.explode(F.array(F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1)))).alias("at"))
    # at most bits / 64 rows come back, however many keys there are
    words = places.groupBy(word(F.col("at")).alias("word")).agg(F.bit_or(bit(F.col("at"))).alias("held")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words["word"].to_numpy()] = words["held"].to_numpy().view(np.uint64)
    known = keys.sparkSession.sparkContext.broadcast(table)

    @pandas_udf("boolean")
    def passes(h: pd.Series) -> pd.Series:
        held = known.value
        hit = np.ones(len(h), bool)
        for at in positions(h.to_numpy(), bits):
            hit &= (held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return pd.Series(hit)

    return lambda column: column.isNotNull() & passes(F.xxhash64(column))
