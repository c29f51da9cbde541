"""A bounded filter of 64-bit keys that tasks probe as an array: it tells which keys are surely not there.

Made by Spark (a bit each for three places of a key, or-ed together by word), held by the
driver and sent once to each executor.  It has 64 bits for each key between the bounds
BITS, so 16 MB at most; with more keys than that it only lets more through, so what
passes must be joined with the keys afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20, 27
#: The places of a key are the low bits of the key shifted by so much.
_SHIFTS = 37, 18, 0
_U = np.uint64


def key_filter(keys: DataFrame, key: str) -> Broadcast:
    """The filter of ``keys[key]`` (a settled table of well mixed longs; nulls count as absent)."""
    bits = min(max((64 * keys.count()).bit_length(), BITS[0]), BITS[1])
    places = F.array(*[F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << bits) - 1)) for shift in _SHIFTS])
    words = (keys.filter(F.col(key).isNotNull()).select(F.explode(places).alias("p"))
             .groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(p & 63)))").alias("set")))
    table = words.toArrow()
    field = np.zeros(1 << (bits - 6), _U)
    field[table.column("word").to_numpy()] = table.column("set").to_numpy().view(_U)
    return keys.sparkSession.sparkContext.broadcast(field)


def maybe(field: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in ``keys`` (uint64) of those that may be in the filter."""
    mask, at = _U(len(field) * 64 - 1), None
    for shift in _SHIFTS:
        p = ((keys if at is None else keys[at]) >> _U(shift)) & mask
        there = np.flatnonzero((field[(p >> _U(6)).view(np.int64)] >> (p & _U(63))) & _U(1))
        at = there if at is None else at[there]
    return at
