"""Importance resampling of documents towards a target text's distribution of hashed features.

The features' buckets of all documents are written once, as packed streams of 16-bit numbers with the offsets at which
documents start. Counting sorts stretches of the streams and run-length encodes them; Spark adds the runs up. With the
counts of the target, each bucket has a gain, the log ratio of the two smoothed models; the gains are then gathered along the
streams and added up between the offsets. A document's score is its mean gain plus Gumbel noise that its id fixes, so the
highest scores are a draw without replacement in proportion to the importance weights.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelyard.llm.words import columns, to_bytes
from reelyard.operators.rank import global_rank
from reelyard.storage import keep, release

BUCKETS = 10_000
BLOCK = 1 << 20  # features of a block of streams
SORTED = 1 << 22  # features that are sorted together
SEED = 2024

# A-Z lowered; what isn't a letter, a digit or a byte beyond ASCII divides words
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

STREAMS = "ids array<long>, words array<long>, offsets array<long>, stream binary"


class Buckets(dict):
    """Bucket of a feature by its crc32; what a full table forgets is hashed again."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.n
        if len(feature) <= 64:
            if len(self) >= 1_000_000:
                self.clear()
            self[feature] = found
        return found


def feature_stream(text: str | None, buckets: Buckets, longest: int = 1) -> tuple[np.ndarray, int]:
    """The buckets of all runs of 1 to `longest` words of a text, and its number of words."""
    words = to_bytes(text).translate(_PLAIN).split()
    found = [np.fromiter(map(buckets.__getitem__, words), np.uint16, len(words))]
    for n in range(2, min(longest, len(words)) + 1):
        runs = (b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
        found.append(np.fromiter((zlib.crc32(r) % buckets.n for r in runs), np.uint16, len(words) - n + 1))
    return np.concatenate(found), len(words)


def bucket_streams(docs: DataFrame, key: str | None = "doc_id", n: int = BUCKETS, longest: int = 1) -> DataFrame:
    """ids, words, offsets, stream: blocks of documents, each document's buckets between two neighbouring offsets of the
    packed stream; words are numbers of words. Without a key ids are null."""
    if n > 1 << 16:
        raise ValueError("buckets are 16-bit numbers")
    rows = docs.select(F.col(key).cast("long").alias("key") if key else F.lit(None).cast("long").alias("key"), "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(n)
        ids, words, parts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
            stream = np.concatenate([*parts, np.zeros(0, np.uint16)]).astype("<u2").tobytes()
            named = {"ids": pa.array([ids], pa.list_(pa.int64())), "words": pa.array([words], pa.list_(pa.int64())), "offsets": pa.array([offsets], pa.list_(pa.int64())), "stream": pa.array([stream], pa.binary())}
            return pa.RecordBatch.from_pydict(named)

        for keys, texts in columns(batches, "key", "text"):
            for k, text in zip(keys, texts, strict=True):
                found, count = feature_stream(text, buckets, longest)
                ids.append(k)
                words.append(count)
                parts.append(found)
                size += len(found)
                if size >= BLOCK or len(ids) >= 1 << 16:
                    yield block()
                    ids, words, parts, size = [], [], [], 0
        if ids:
            yield block()

    return rows.mapInArrow(packed, STREAMS)


def run_lengths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and how often each occurs: sorted, then the lengths of the runs."""
    ordered = np.sort(values)
    starts = np.flatnonzero(np.concatenate((np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1])))
    return ordered[starts], np.diff(starts, append=len(ordered))


def stream_counts(streams: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the streams: n numbers, which is all that reaches the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs(parts: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = run_lengths(np.concatenate(parts))
            return pa.RecordBatch.from_pydict({"bucket": pa.array(values.astype(np.int64)), "n": pa.array(counts.astype(np.int64))})

        held, size = [], 0
        for batch in batches:
            for stream in batch.column(0):
                held.append(np.frombuffer(stream.as_buffer(), "<u2"))
                size += len(held[-1])
                if size >= SORTED:
                    yield runs(held)
                    held, size = [], 0
        if held:
            yield runs(held)

    out = np.zeros(n, np.int64)
    for row in streams.select("stream").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed models) of each bucket, floors going down."""
    n, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((int(t) + 1) * (s_all + n)) / float((int(s) + 1) * (t_all + n)))) for s, t in zip(raw, target, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths that a document's id fixes."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(streams: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document of the streams."""
    shared = streams.sparkSession.sparkContext.broadcast(gains)  # a fixed number of buckets

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for ids, words, offsets, stream in zip(*(batch.column(i) for i in range(4)), strict=True):
                keys, at = ids.as_py(), np.array(offsets.as_py(), np.int64)
                lengths = np.diff(at)
                filled = np.flatnonzero(lengths)
                weights = np.zeros(len(keys), np.int64)
                if len(filled):
                    weights[filled] = np.add.reduceat(table[np.frombuffer(stream.as_buffer(), "<u2")], at[filled]) // lengths[filled]
                drawn = np.array([noise(k, seed) for k in keys], np.int64)
                named = {"doc_id": pa.array(keys, pa.int64()), "n_words": pa.array(words.as_py(), pa.int64()), "n_features": pa.array(lengths), "weight": pa.array(weights), "score": pa.array(weights + drawn)}
                yield pa.RecordBatch.from_pydict(named)

    return streams.select("ids", "words", "offsets", "stream").mapInArrow(gathered, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, n: int = BUCKETS, longest: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs: the features are all runs of 1 to `longest` words, and
    rank counts from 1 the rows drawn, which are floor(percent * N / 100) of the N rows with least_words words or more, by
    highest score, ties to the smaller doc_id (then the larger weight and n_features); rows not drawn have none.

    Models count all of docs and of target (its column text). A null, empty or wordless text has no features and weight 0;
    repeated rows each take part; a null doc_id draws by the empty string and comes before others in ties; an empty target
    is a flat model, an empty table gives no rows; other columns aren't read.
    """
    streams = keep(bucket_streams(docs, "doc_id", n, longest), "streams")
    gains = bucket_gains(stream_counts(streams, n), stream_counts(bucket_streams(target, None, n, longest), n))
    known = streams.agg(F.sum(F.size(F.filter("words", lambda w: w >= least_words))).alias("n")).first()["n"] or 0
    weighed = keep(scores(streams, gains, seed), "scores")
    release(streams)
    few = F.col("n_words") < least_words
    order = [few.cast("int"), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("weight").desc(), F.col("n_features").desc()]
    ranked = global_rank(weighed, *order, rank="rank", ready=True)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") < percent * known // 100, F.col("rank") + 1).alias("rank"))


#: A crc32 of every distinct word by its table of 256 remainders, in SQL.
OP11_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
e AS (SELECT doc_id, unnest(words) AS w FROM d),
remainders AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), n)) AS t),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM e UNION SELECT w FROM b)),
h AS (SELECT w, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, y: xor(t[CAST(xor(c, y) & 255 AS BIGINT) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM v, remainders),
s AS (SELECT bucket, count(*) AS s FROM e JOIN h USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (w) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT count(*) FROM e) + 10000))::DOUBLE / ((s + 1) * ((SELECT count(*) FROM b) + 10000))::DOUBLE)) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
f AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM e JOIN h USING (w) JOIN g USING (bucket) GROUP BY 1),
c AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN f USING (doc_id)),
r AS (SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id) AS r FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM c WHERE n_features >= 20) * 10 // 100 THEN r END AS rank FROM r"""


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
