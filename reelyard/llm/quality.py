"""Importance resampling of raw text towards target text.

Two generative models of hashed word n-grams (words and word pairs, in a fixed number of buckets) are counted: one on the
target text, one on all raw text. A document's log importance weight is the sum over its n-grams of the log ratio of the two
models; the sample is the k documents of the largest weight plus Gumbel noise, which draws without replacement in
proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelyard.llm.words import columns, mix, to_bytes, word_hashes
from reelyard.operators.rank import global_rank

BUCKETS = 1 << 16
TARGET_ROWS = 20_000
SEED = 11


def buckets(text: str | None, n: int = BUCKETS) -> np.ndarray:
    """The buckets of a text's words and neighbouring word pairs."""
    words = word_hashes(to_bytes(text))
    pairs = mix(words[:-1] + words[1:] * np.uint64(3))
    return (np.concatenate((words, pairs)) % np.uint64(n)).astype(np.int64)


def sample_ids(labels: DataFrame, condition, rows: int) -> DataFrame:
    """At most `rows` distinct doc_ids of the labelled rows under the condition, the first by hash."""
    ids = labels.where(condition).where("doc_id is not null").select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def model_counts(docs: DataFrame, targets: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """(2, n): how often each bucket occurs in all of docs and in the target documents.

    targets has at most TARGET_ROWS ids, so it is broadcast; each task sends one count for each bucket it saw.
    """
    flagged = docs.select("doc_id", "text").join(F.broadcast(targets.select("doc_id", F.lit(True).alias("aim"))), "doc_id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n), np.int64)
        for texts, aims in columns(batches, "text", "aim"):
            found = [buckets(t, n) for t in texts]
            total[0] += np.bincount(np.concatenate(found), minlength=n)
            aimed = [b for b, aim in zip(found, aims, strict=True) if aim]
            total[1] += np.bincount(np.concatenate([*aimed, found[0][:0]]), minlength=n)
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen, pa.int64()), "raw": pa.array(total[0, seen]), "aim": pa.array(total[1, seen])})

    rows = flagged.mapInArrow(count, "bucket long, raw long, aim long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("aim").alias("aim"))
    out = np.zeros((2, n), np.int64)
    for r in rows.toLocalIterator():  # at most n rows
        out[:, r["bucket"]] = r["raw"], r["aim"]
    return out


def log_ratios(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw of each bucket, with add-one smoothing."""
    raw, aim = counts + smooth
    return (np.log(aim / aim.sum()) - np.log(raw / raw.sum())).astype(np.float64)


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_grams, log_weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # a fixed number of buckets

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for ids, texts in columns(batches, "doc_id", "text"):
            found = [buckets(t, len(table)) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_grams": pa.array([len(b) for b in found], pa.int64()), "log_weight": pa.array([float(np.round(table[b].sum(), 9)) for b in found])})

    return docs.select("doc_id", "text").mapInArrow(weigh, "doc_id long, n_grams long, log_weight double")


def gumbel(seed: int) -> F.Column:
    """Gumbel noise that depends on the doc_id and the seed alone."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(2**52)) + 0.5) / 2.0**52
    return -F.log(-F.log(unit))


def importance_sample(docs: DataFrame, labels: DataFrame, keep_share: float | None = None, target_rows: int = TARGET_ROWS, n: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, key, place and selected for every row of docs.

    The target model is counted on the documents of at most target_rows labels of quality 1; the raw model on all of docs.
    The sample size is keep_share of docs, by default the share of quality 1 among the labels: an operator whose feature
    is the limit. place is the rank by key (from 1; equal keys by doc_id), selected says whether it is in the sample.
    Empty or null texts have no n-grams and weight 0; repeated rows each take part; without labels of quality 1 the target
    model is flat. Only doc_id and text of docs and doc_id and quality of labels are read.
    """
    good = F.col("quality") == 1
    if keep_share is None:
        keep_share = labels.agg(F.avg(good.cast("double"))).first()[0]
        keep_share = 1.0 if keep_share is None else keep_share
    counts = model_counts(docs, sample_ids(labels, good, target_rows), n)
    keyed = log_weights(docs, log_ratios(counts)).withColumn("key", F.col("log_weight") + gumbel(seed))
    total = int(docs.count())
    size = round(total * keep_share)
    ranked = global_rank(keyed, F.col("key").desc(), F.col("doc_id").asc_nulls_first(), rank="place")
    return ranked.select("doc_id", "n_grams", "log_weight", "key", (F.col("place") + 1).alias("place"), (F.col("place") < size).alias("selected"))


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
