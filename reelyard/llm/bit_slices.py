"""Exact top-k inner-product search on a bit-sliced index.

Components are quantised to integers. A block of rows keeps, for each dimension, its values' bits as bitmaps over the rows
(slices). A query's score slices are the sum of the attribute slices shifted by the set digits of the query's components,
added up by carry-save bitmap arithmetic. The best rows follow from the most significant score slice downward; the rows that
remain at the boundary are settled by exact scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelyard.llm.words import columns
from reelyard.storage import keep

SCALE = 256
TOP = 5
ROW_BLOCK = 32_768
LEAST_BLOCK = 8_192
EVERY = 50
SETTLE = 48


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as double; null where the vector is null or holds a null or non-finite one. A component
    that passes 62 bits is an error: as a whole number of 64 bits it would be cut short without a word."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    wide = F.exists(vector, lambda x: F.abs(x.cast("double") * scale) >= float(1 << 62))
    whole = F.when(wide, F.raise_error(F.lit("components of these vectors pass 62 bits"))).otherwise(F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))
    return F.when(~F.coalesce(bad, F.lit(True)), whole)


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(power, sign) of the non-adjacent form of an integer: few digits, none adjacent."""
    out, power = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((power, digit))
            value -= digit
        value >>= 1
        power += 1
    return out


class SlicedBlock:
    """The slices of a block of rows; rows in the order of their ids, then of their row numbers."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, numbers: np.ndarray):
        order = np.lexsort((numbers, ids))
        self.ids, self.values, self.numbers = ids[order], values[order], numbers[order]
        self.most = int(np.abs(values).max(initial=0))
        self.words = -(-len(ids) // 64)
        self.full = self._pack(np.ones((1, len(ids)), bool))[0]
        self.low = self.values.min(axis=0)
        spread = self.values - self.low
        self.bits = [int(m).bit_length() for m in spread.max(axis=0)]
        self.slices = [[s for s in self._pack((spread[:, d][None, :] >> np.arange(b)[:, None] & 1).astype(bool))] for d, b in enumerate(self.bits)]

    def _pack(self, rows: np.ndarray) -> np.ndarray:
        packed = np.packbits(rows, axis=1, bitorder="little")
        out = np.zeros((len(rows), self.words * 8), np.uint8)
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of score - (a constant of the query), all terms not negative, least significant first.

        A term -2**p * v becomes 2**p * (the complement of v's slices) less a constant.
        """
        columns: list[list[np.ndarray]] = []

        def add(power: int, bitmap: np.ndarray) -> None:
            while len(columns) <= power:
                columns.append([])
            columns[power].append(bitmap)

        for d, q in enumerate(query.tolist()):
            for power, sign in signed_digits(q):
                for b, bitmap in enumerate(self.slices[d]):
                    add(power + b, bitmap if sign > 0 else self.full & ~bitmap)
        out, power = [], 0
        while power < len(columns):
            stack = columns[power]
            while len(stack) > 2:  # a full adder: three bitmaps of a weight become one, and one of the next weight
                x, y, z = stack.pop(), stack.pop(), stack.pop()
                half = x ^ y
                add(power + 1, (x & y) | (half & z))
                stack.insert(0, half ^ z)
            if len(stack) == 2:
                x, y = stack
                add(power + 1, x & y)
                stack = [x ^ y]
            out.append(stack[0] if stack else np.zeros(self.words, np.uint64))
            columns[power] = []
            power += 1
        return out

    def top(self, query: np.ndarray, k: int, own: int, number: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows without the query's own, which has this id and row number; ties to smaller ids."""
        if self.most * int(np.abs(query).max(initial=0)) * max(len(query), 1) >= 2**62:
            raise ValueError("scores of these vectors pass 62 bits")
        alive = self.full.copy()
        at = np.searchsorted(self.ids, own)
        while at < len(self.ids) and self.ids[at] == own:
            if self.numbers[at] == number:
                alive[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
            at += 1
        sure = np.zeros_like(alive)
        count_sure, count_alive = 0, int(np.bitwise_count(alive).sum())
        for bitmap in reversed(self.score_slices(query)):
            if count_sure + count_alive <= max(k, SETTLE):
                break
            upper = alive & bitmap
            n = int(np.bitwise_count(upper).sum())
            if count_sure + n >= k:
                alive, count_alive = upper, n
            else:
                sure |= upper
                count_sure += n
                alive, count_alive = alive & ~bitmap, count_alive - n
        rows = self._rows(sure)
        # what is left at the boundary: rows of equal score, or few enough to be settled by their exact scores
        edge = self._rows(alive)
        rows = np.concatenate((rows, edge if count_sure + count_alive <= max(k, SETTLE) else edge[: k - count_sure]))
        scores = self.values[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return list(zip(self.ids[rows][best].tolist(), scores[best].tolist(), strict=True))

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: len(self.ids)])


def top_k(rows: DataFrame, asks, k: int = TOP, row_block: int = ROW_BLOCK, least_block: int = LEAST_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row (vec_id, q) where asks holds, the k best other rows by integer inner product,
    ties to the smaller vec_id; all rows where there are fewer.

    Rows are numbered and dealt into blocks of at most about row_block rows once; a block's slices are made once, and the
    queries travel: each streams through every block, which sends its k best rows on; these meet in a second ranking. What is
    copied is a query for each block, never a row. Vectors of one length are compared only (two empty ones score 0). Rows of
    one vec_id are rows of their own, as queries and as candidates. Scores beyond 62 bits are an error.
    """
    numbered = keep(rows.select("vec_id", "q", F.monotonically_increasing_id().alias("number")), "vectors")
    n = numbered.count()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // row_block), min(tasks, n // least_block))
    block = F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int")
    parts = numbered.select(block.alias("block"), F.size("q").alias("dim"), F.lit(0).alias("asks"), "vec_id", "number", "q")
    travelling = numbered.where(asks).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.size("q").alias("dim"), F.lit(1).alias("asks"), "vec_id", "number", "q")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, index = None, [], None
        for where, dims, asking, ids, numbers, vectors in columns(batches, "block", "dim", "asks", "vec_id", "number", "q"):
            out = []
            for b, dim, ask, i, number, q in zip(where, dims, asking, ids, numbers, vectors, strict=True):
                if cell != (b, dim):
                    cell, held, index = (b, dim), [], None
                vector = np.array(q, np.int64)
                if not ask:
                    held.append((i, number, vector))
                elif held:
                    if index is None:
                        index = SlicedBlock(np.array([h[0] for h in held], np.int64), np.stack([h[2] for h in held]), np.array([h[1] for h in held], np.int64))
                        held = [None]
                    out += [(number, i, v, s) for v, s in index.top(vector, k, i, number)]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(4)], ["number", "query_id", "vec_id", "score"])

    met = parts.unionByName(travelling).repartitionById(blocks, "block").sortWithinPartitions("block", "dim", "asks")
    found = met.mapInArrow(search, "number long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantised(F.col("embedding")).alias("q")).where("q is not null and vec_id is not null")
    return top_k(rows, F.col("vec_id") % EVERY == 0)


OP4_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS number, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.number, a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.number <> b.number AND len(a.q) = len(b.q) AND a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
