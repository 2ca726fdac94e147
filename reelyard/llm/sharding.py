"""Sharding by a Hilbert curve over metadata: quantise, sort by curve index, cut into runs of equal counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelyard.operators.rank import global_rank

BITS = 10
LEVELS = ("_lang_level", "_source_level")


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each column of axes (dimensions x points, values below 2**bits)."""
    x = axes.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def hilbert_column(bits: int, *dims: Column) -> Column:
    @F.pandas_udf("long")
    def index(*parts: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack([p.to_numpy(np.int64) for p in parts]), bits))

    return index(*dims)


def log_level(value: Column, bits: int = BITS) -> Column:
    """A count quantised on a logarithmic scale that keeps its order; null as 0."""
    return F.least(F.lit(2**bits - 1), F.floor(F.log2(F.coalesce(value, F.lit(0)).cast("double") + 1) * (2**bits / 40))).cast("long")


def with_level(rows: DataFrame, name: str, level: str, bits: int = BITS) -> DataFrame:
    """rows with the column `level`: the place of rows[name] in the order of its different values, spread over 0 .. 2**bits - 1;
    0 for null and where the column is missing. There is a row for each different value, joined on by size."""
    rows = rows.drop(level)
    if name not in rows.columns:
        return rows.withColumn(level, F.lit(0).cast("long"))
    key = level + "_key"
    values = rows.where(F.col(name).isNotNull()).select(F.col(name).alias(key)).distinct()
    ranked = global_rank(values, F.col(key), rank=level, ready=True)
    total = max(ranked.count(), 1)
    ranked = ranked.withColumn(level, F.expr(f"({level} + 1) * {2**bits - 1}L div {total}L"))
    joined = rows.join(ranked, F.col(name) == F.col(key), "left").drop(key)
    return joined.withColumn(level, F.coalesce(level, F.lit(0)).cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    """docs with size (UTF-8 bytes plus 1; a null text has no bytes) and text_crc32 (null as empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text.cast("binary"))})


def hilbert_shards(rows: DataFrame, shards: int, bits: int = BITS, last: tuple[str, ...] = ()) -> DataFrame:
    """Deal every measured() row to a shard: rows in the order of their Hilbert index over (size, lang, source), cut into
    `shards` runs whose counts differ by one at most, so a file of a run has narrow ranges in all three dimensions.

    Give narrow rows, without texts: they are sorted. lang and source are quantised by the order of their values. Equal texts
    with equal metadata are neighbours (index, then CRC, then doc_id, then the columns `last`). Adds hilbert, shard and slot (place in
    the shard, from 0); columns of the input with these names are replaced, any other stays. Null metadata, or a table
    without the column, takes level 0; repeated rows each get a slot; an empty table gives an empty one; fewer rows than
    shards leave shards empty.
    """
    rows = rows.drop("hilbert", "shard", "slot", "_rank", *LEVELS)
    for name, level in zip(("lang", "source"), LEVELS, strict=True):
        rows = with_level(rows, name, level, bits)
    rows = rows.withColumn("hilbert", hilbert_column(bits, log_level(F.col("size"), bits), *map(F.col, LEVELS))).drop(*LEVELS)
    ranked = global_rank(rows, F.col("hilbert"), F.col("text_crc32"), F.col("doc_id").asc_nulls_first(), *map(F.col, last), rank="_rank")
    n = ranked.count()
    # shard k holds the ranks from ceil(k n / shards) on, so counts differ by one at most
    ranked = ranked.withColumn("shard", F.expr(f"cast((_rank * {shards}) div {max(n, 1)} as int)"))
    return ranked.withColumn("slot", F.expr(f"_rank - (shard * {n}L + {shards - 1}) div {shards}")).drop("_rank")


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents in 8 shards, with the curve index."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    placed = hilbert_shards(measured(docs).drop("text"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
