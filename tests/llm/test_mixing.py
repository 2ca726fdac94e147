import re

import pytest
from pyspark.sql import functions as F

from reelyard.llm import mixing
from tests.llm.cases import ODD, none, odd


def filled(sizes):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 2.0 * sizes[s] for s in capped} | {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 63, 64, 65, 200])
def test_permutation_and_inverse(spark, n):
    rows = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p"))
    rows = rows.withColumn("back", mixing.permuted(F.col("p"), F.lit(n).cast("long"), F.lit(5), back=True)).collect()
    assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_targets_and_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.when(F.col("source") != "src3", F.col("source")).alias("source"))
    documents, pieces = mixing.mix(docs)
    rows, sizes = documents.collect(), {}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in rows:
        sizes[source[r["doc_id"]]] = sizes.get(source[r["doc_id"]], 0) + r["size"]
    want, taken = filled(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    got = {r["row"]: r["n"] for r in pieces.groupBy("row").agg(F.sum("n_words").alias("n")).collect()}
    assert got == {r["row"]: r["taken"] for r in rows if r["taken"]}
    assert pieces.select("shard").distinct().count() > 10
    again = mixing.mix(docs.repartition(7))[0].select("doc_id", "taken").collect()
    assert sorted(again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_odd_rows(spark):
    rows = mixing.mix(odd(spark))[0].collect()
    assert len(rows) == len(ODD)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ODD}
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(none(spark))[0].count() == 0
