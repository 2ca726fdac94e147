import math
import random
import struct
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from reelyard.llm import quality
from reelyard.llm.words import mix, word_hashes
from tests.llm.cases import ODD, none, odd

SF = "/root/testdata/sf0.1"


def test_sample_prefers_target_text(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    even = labels.where("doc_id % 2 = 0")
    rows = quality.importance_sample(docs, even).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r["selected"] for r in rows if r["quality"] == 1]
    bad = [r["selected"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.3


def test_weights_are_sums_of_log_ratios(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c d"), (3, None)], "doc_id long, text string")
    counts = quality.model_counts(docs, docs.where("doc_id = 1").select("doc_id"), 64)
    raw, aim = sum(len(quality.buckets(t, 64)) for t in ("a b a", "c d")), len(quality.buckets("a b a", 64))
    assert counts.sum(axis=1).tolist() == [raw, aim]
    ratios = quality.log_ratios(counts)
    got = {r["doc_id"]: r["log_weight"] for r in quality.log_weights(docs, ratios).collect()}
    assert got == {1: round(ratios[quality.buckets("a b a", 64)].sum(), 9), 2: round(ratios[quality.buckets("c d", 64)].sum(), 9), 3: 0.0}


def test_sample_by_brute_force(spark):
    draw = random.Random(2)
    texts = [(i, " ".join(draw.choice(("a", "bb", "ccc", "Dd", "e5") if i % 3 else ("x", "yy", "a")) for _ in range(draw.randint(0, 30)))) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    word = lambda w: int(word_hashes(w.encode())[0])
    raw, aim, grams = Counter(), Counter(), {}
    for i, text in texts:
        h = [word(w) for w in text.split()]
        pairs = [int(mix(np.array([(x + 3 * y) % 2**64], np.uint64))[0]) for x, y in zip(h, h[1:], strict=False)]
        grams[i] = [g % quality.BUCKETS for g in h + pairs]
        raw.update(grams[i])
        if i % 2 == 0 and i % 3:
            aim.update(grams[i])
    total = [sum(c.values()) + quality.BUCKETS for c in (raw, aim)]
    ratio = lambda g: math.log((aim[g] + 1) / total[1]) - math.log((raw[g] + 1) / total[0])

    def noise(i):
        seed = xxhash.xxh64_intdigest(struct.pack("<i", quality.SEED), seed=42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", i), seed=seed)
        unit = ((h if h < 2**63 else h - 2**64) % 2**52 + 0.5) / 2.0**52
        return -math.log(-math.log(unit))

    weight = {i: round(sum(map(ratio, g)), 9) for i, g in grams.items()}
    best = sorted(weight, key=lambda i: (-(weight[i] + noise(i)), i))
    rows = {r["doc_id"]: r for r in quality.importance_sample(docs, labels, keep_share=0.3).collect()}
    assert all(abs(rows[i]["log_weight"] - w) < 1e-6 for i, w in weight.items())
    assert {i for i, r in rows.items() if r["selected"]} == set(best[:60]) and [rows[i]["place"] for i in best] == list(range(1, 201))


def test_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.importance_sample(odd(spark), labels, keep_share=0.5).collect()
    assert len(rows) == len(ODD) and sum(r["selected"] for r in rows) == 7
    assert sorted(r["place"] for r in rows) == list(range(1, len(ODD) + 1))
    assert quality.importance_sample(none(spark), labels.limit(0)).count() == 0
    assert quality.importance_sample(odd(spark), labels.limit(0)).where("selected").count() == len(ODD)


def test_gumbel_top_k_follows_the_weights(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    mean = ids.select(F.avg(quality.gumbel(3)).alias("m"), F.stddev(quality.gumbel(3)).alias("s")).first()
    assert abs(mean["m"] - 0.5772) < 0.03 and abs(mean["s"] - 1.2825) < 0.04
