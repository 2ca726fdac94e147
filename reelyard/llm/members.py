"""Which keys of a table can be in a smaller one: a bitmap of hashed keys, of bounded size, for all tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 16, 27


class Members:
    """A bitmap with 8 bits for each key, 2**27 (16 MB) at most: beyond some 20 million keys it lets more and more others pass,
    so what it lets pass must still be joined exactly."""

    def __init__(self, shared: Broadcast, bits: int):
        self.shared, self.bits = shared, bits

    @classmethod
    def of(cls, table: DataFrame, *key: str) -> Members:
        bits = min(max(LEAST_BITS, (8 * table.count()).bit_length()), MOST_BITS)
        place = F.shiftrightunsigned(F.xxhash64(*key), 64 - bits)
        words = table.select(place.alias("p")).groupBy(F.expr("p div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("mask"))
        found = words.toPandas()  # at most 2**21 rows
        map_ = np.zeros(1 << (bits - 6), np.int64)
        map_[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64)
        return cls(table.sparkSession.sparkContext.broadcast(map_), bits)

    def test(self, *key: str) -> Column:
        """Whether the key can be in the table."""
        shared = self.shared

        @F.pandas_udf("boolean")
        def held(place: pd.Series) -> pd.Series:
            at = place.to_numpy(np.int64)
            return pd.Series((shared.value[at >> 6] >> (at & 63) & 1).astype(bool))

        return held(F.shiftrightunsigned(F.xxhash64(*key), 64 - self.bits))

    def filter(self, rows: DataFrame, *key: str) -> DataFrame:
        return rows.where(self.test(*key))
