"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

One weight vector is shared by all thresholds: P(grade <= k) = sigmoid(cut_k - w.x). The features are words and leading
parts of words, hashed, of which those most telling of toxicity on a bounded sample of labelled rows are kept. The labels say toxic or
not; a toxic row's grade (1 to 3) is the third of the toxic sample into which its number of telling features falls. That number
grows with a text's length; grades by the features' share of the words, or by the most telling one, were tried and fit worse
(of the held-out toxic rows at sf0.1 0.83 and 0.86 were caught then, over 0.9 by number).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelyard.llm.words import columns, prefix_hashes, to_bytes

SAMPLE_ROWS = 4000
FEATURES = 2048
LEAST_DOCS = 5
LEAST_Z = 3.0
PREFIXES = (4, 5, 6)
GRADES = 4
REJECT = 0.5


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct feature hashes of a text, their counts, and the number of words."""
    parts = prefix_hashes(to_bytes(text), PREFIXES)
    found, n = np.unique(np.concatenate(parts), return_counts=True)
    return found.view(np.int64), n, len(parts[0])


@dataclass
class Severity:
    """A fitted model: sorted feature hashes, their weights and the cut points."""

    hashes: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def __post_init__(self):
        self.likely = np.zeros(1 << 20, bool)
        self.likely[self.hashes & (len(self.likely) - 1)] = True

    def lookup(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Places in hashes of the text's features, their counts, and the number of words."""
        parts = prefix_hashes(to_bytes(text), PREFIXES)
        seen = np.concatenate(parts).view(np.int64)
        seen = seen[self.likely[seen & (len(self.likely) - 1)]]
        at = np.minimum(np.searchsorted(self.hashes, seen), len(self.hashes) - 1)
        at = at[self.hashes[at] == seen]
        found, n = np.unique(at, return_counts=True)
        return found, n, len(parts[0])

    def at_least(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades - 1."""
        if not len(self.hashes):
            return np.zeros(len(self.cuts))
        found, n, _ = self.lookup(text)
        score = float(self.weights[found] @ np.log1p(n))
        return 1 / (1 + np.exp(np.clip(self.cuts - score, -50, 50)))


def fit_cumulative(x: tuple[np.ndarray, np.ndarray, np.ndarray], d: int, grade: np.ndarray, grades: int, decay: float = 1e-5, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing cuts of the cumulative-link model, by full-batch Adam on the penalised likelihood.

    x holds the row, column (below d) and value of each feature that isn't 0.
    """
    at, column, value = x
    n = len(grade)
    cut_params = np.concatenate(([1.0], np.zeros(grades - 2)))
    params = np.concatenate((np.zeros(d), cut_params))
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, c = params[:d], params[d:]
        cuts = np.concatenate(([c[0]], c[0] + np.cumsum(np.exp(c[1:]))))
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        score = np.bincount(at, value * w[column], n)
        with np.errstate(over="ignore"):
            upper, lower = 1 / (1 + np.exp(-(edges[grade + 1] - score))), 1 / (1 + np.exp(-(edges[grade] - score)))
        share = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / share, lower * (1 - lower) / share
        by_score = (d_upper - d_lower) / n  # of the negative log likelihood
        by_cut = np.array([(d_lower[grade == k + 1].sum() - d_upper[grade == k].sum()) / n for k in range(grades - 1)])
        by_param = np.concatenate(([by_cut.sum()], [np.exp(c[j]) * by_cut[j:].sum() for j in range(1, grades - 1)]))
        g = np.concatenate((np.bincount(column, value * by_score[at], d) + decay * w, by_param))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    c = params[d:]
    return params[:d], np.concatenate(([c[0]], c[0] + np.cumsum(np.exp(c[1:]))))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, toxic of at most `rows` labelled documents of either class, the first by hash."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    pick = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for t in (0, 1)]
    found = docs.select("doc_id", "text").join(F.broadcast(pick[0].unionByName(pick[1])), "doc_id")  # a bounded number of ids
    # one row of a repeated id, so rows are bounded as well
    return found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = FEATURES) -> Severity:
    """Fit on at most 2 * rows labelled documents and `size` features; what reaches the driver is bounded by their product."""
    sample = labelled_sample(docs, labels, rows)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, toxic in columns(batches, "text", "toxic"):
            each = [(features(t)[0], y) for t, y in zip(texts, toxic, strict=True)]
            found, inverse = np.unique(np.concatenate([f for f, _ in each]), return_inverse=True)
            marks = np.concatenate([np.full(len(f), y) for f, y in each])
            yield pa.RecordBatch.from_pydict({"feature": pa.array(found), "toxic": pa.array(np.bincount(inverse, marks, len(found)).astype(np.int64)), "docs": pa.array(np.bincount(inverse, minlength=len(found)).astype(np.int64))})

    count = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}  # two rows
    empty = Severity(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES - 1, 50.0))
    n1, n0 = count.get(1, 0), count.get(0, 0)
    if not n0 or not n1:
        return empty
    by = sample.mapInArrow(tally, "feature long, toxic long, docs long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("docs").alias("d")).where(F.col("d") >= LEAST_DOCS)
    t, c = F.col("t") + 0.5, F.col("d") - F.col("t") + 0.5
    odds = F.log(t / (n1 + 1 - t)) - F.log(c / (n0 + 1 - c))
    top = by.withColumns({"odds": odds, "z": odds / F.sqrt(1 / t + 1 / c)}).where(F.col("z") >= LEAST_Z).orderBy(F.col("z").desc(), "feature").limit(size).select("feature", "odds").toPandas().sort_values("feature")
    if top.empty:
        return empty
    hashes = top["feature"].to_numpy(np.int64)
    telling = top["odds"].to_numpy() > np.log(20)
    shape = Severity(hashes, np.zeros(len(hashes)), np.zeros(GRADES - 1))
    shared = docs.sparkSession.sparkContext.broadcast((shape, telling))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, marked = shared.value
        for ids, texts, toxic in columns(batches, "doc_id", "text", "toxic"):
            each = [model.lookup(x) for x in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "toxic": pa.array(toxic, pa.int32()), "words": pa.array([w for *_, w in each], pa.int64()),
                "hits": pa.array([float(n[marked[f]].sum()) for f, n, _ in each]),
                "at": pa.array([f.astype(np.int32) for f, _, _ in each], pa.list_(pa.int32())), "n": pa.array([n.astype(np.int32) for _, n, _ in each], pa.list_(pa.int32())),
            })

    rows_ = sample.mapInArrow(encode, "doc_id long, toxic int, words long, hits double, at array<int>, n array<int>").toPandas()
    rows_ = rows_.sort_values(["doc_id", "words", "hits"], kind="stable").reset_index(drop=True)
    row = np.repeat(np.arange(len(rows_)), rows_["at"].map(len).to_numpy())
    x = row, np.concatenate(rows_["at"].to_list()).astype(np.int64), np.log1p(np.concatenate(rows_["n"].to_list()))
    grade = np.zeros(len(rows_), np.int64)
    bad = rows_["toxic"].to_numpy() == 1
    steps = np.quantile(rows_["hits"].to_numpy()[bad], [k / (GRADES - 1) for k in range(1, GRADES - 1)])
    grade[bad] = 1 + np.searchsorted(steps, rows_["hits"].to_numpy()[bad], side="left")
    weights, cuts = fit_cumulative(x, len(hashes), grade, GRADES)
    return Severity(hashes, weights.astype(np.float64), cuts)


def score(docs: DataFrame, model: Severity) -> DataFrame:
    """doc_id, expected_severity (0 .. grades - 1), grade (likeliest), p_toxic and toxic for every row of docs.

    A null or empty text has no features; repeated rows are scored alike; other columns are not read; an empty table gives
    an empty one; a model fitted without both classes gives severity 0. Whole texts are read, one at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches, "doc_id", "text"):
            p = np.array([shared.value.at_least(t) for t in texts]).reshape(len(ids), -1)
            ends = np.concatenate((np.ones((len(ids), 1)), p, np.zeros((len(ids), 1))), axis=1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "expected_severity": pa.array(p.sum(axis=1)), "grade": pa.array((ends[:, :-1] - ends[:, 1:]).argmax(axis=1).astype(np.int32)),
                "p_toxic": pa.array(p[:, 0]), "toxic": pa.array(p[:, 0] >= REJECT),
            })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean")


def without_toxic(docs: DataFrame, model: Severity) -> DataFrame:
    """The rows of docs that the model doesn't call toxic, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def rejected(text: pd.Series) -> pd.Series:
        return text.map(lambda t: bool(shared.value.at_least(t)[0] >= REJECT))

    return docs.where(~rejected(F.coalesce(F.col("text"), F.lit(""))))


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
