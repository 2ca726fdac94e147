import math
from collections import Counter

import numpy as np

from reelyard.llm import toxicity
from reelyard.llm.words import prefix_hashes
from tests.llm.cases import ODD, none, odd

SF = "/root/testdata/sf0.1"


def test_cumulative_link_recovers_the_order():
    draw = np.random.default_rng(1)
    dense = (draw.random((3000, 6)) < 0.5) * draw.random((3000, 6))
    latent = dense @ np.array([3.0, 2, 1, -1, -2, 0]) + draw.logistic(size=3000) * 0.3
    grade = np.searchsorted([0.5, 1.5, 2.5], latent)
    at, column = np.nonzero(dense)
    weights, cuts = toxicity.fit_cumulative((at, column, dense[at, column]), 6, grade, 4)
    assert list(np.argsort(weights)) == [4, 3, 5, 2, 1, 0] and (np.diff(cuts) > 0).all()


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    rows = toxicity.score(docs, model).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "truth"), "doc_id").collect()
    caught = [r["toxic"] for r in rows if r["truth"] == 1]
    blamed = [r["toxic"] for r in rows if r["truth"] == 0]
    assert sum(caught) / len(caught) > 0.9 and sum(blamed) / len(blamed) < 0.01
    assert all(0 <= r["expected_severity"] <= 3 for r in rows)


def test_severities_by_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 3000"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    assert len(weight) > 10
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for r in docs.where("doc_id % 10 = 0").collect():
        count = Counter()
        for word in (r["text"] or "").encode().lower().split():
            for k, h in enumerate(prefix_hashes(word, toxicity.PREFIXES)):
                assert len(h) == 1
                count[int(h.view(np.int64)[0])] += 1
        score = sum(weight[h] * math.log(1 + n) for h, n in count.items() if h in weight)
        p = [1 / (1 + math.exp(min(max(c - score, -50), 50))) for c in model.cuts]
        assert abs(rows[r["doc_id"]]["expected_severity"] - sum(p)) < 1e-6 and rows[r["doc_id"]]["toxic"] == (p[0] >= toxicity.REJECT)


def test_repeated_ids_are_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {k % 3}") for k in range(50)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert sorted(r["doc_id"] for r in toxicity.labelled_sample(docs, labels, 10).collect()) == [1, 2]


def test_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 1), (6, 1, 0), (1, 1, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("toxic = 0"), labels.limit(0)):
        model = toxicity.fit(odd(spark), known)
        rows = toxicity.score(odd(spark), model).collect()
        assert len(rows) == len(ODD) and not any(r["toxic"] for r in rows if r["doc_id"] in (1, 2, 3))
        assert toxicity.without_toxic(odd(spark), model).count() == sum(not r["toxic"] for r in rows)
    assert toxicity.score(none(spark), model).count() == 0
