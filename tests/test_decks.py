from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelyard.operators import decks
from reelyard.operators.rank import global_rank, running_total


def test_ranks_and_totals(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7).repartition(5)
    assert sorted((r["id"], r["rank"]) for r in global_rank(df, F.col("id").desc()).collect()) == [(i, 999 - i) for i in range(1000)]
    rows = running_total(df, [F.col("id")], F.col("v")).collect()
    assert {r["id"]: r["before"] for r in rows}[500] == sum(i % 7 for i in range(500))
    assert running_total(df.limit(0), [F.col("id")], F.col("v")).count() == 0


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_decks_are_even_repeatable_and_seeded(spark, seed):
    cards = spark.range(1500).withColumn("s", F.when(F.col("id") % 3 == 0, "x"))
    deal = lambda s: {r["id"]: (r["s"], r["c"]) for r in decks.even_deck(cards, list("abcdefg"), "cam", "c", ["s"], s).collect()}
    first = deal(seed)
    for stratum, n in (("x", 500), (None, 1000)):
        counts = Counter(c for s, c in first.values() if s == stratum)
        assert sum(counts.values()) == n and max(counts.values()) - min(counts.values()) <= 1
    assert first == deal(seed) and first != deal(seed + 1)


def test_places_are_unique_pairs(spark):
    cards = spark.range(600)
    regions, kinds = (spark.createDataFrame([(f"{p}{i}",) for i in range(n)], "value string") for p, n in (("r", 25), ("k", 40)))
    rows = decks.deal_places(cards, regions, kinds).collect()
    assert len({(r["region"], r["archetype"]) for r in rows}) == 600
    assert set(Counter(r["region"] for r in rows).values()) == {24} and set(Counter(r["archetype"] for r in rows).values()) == {15}
    with pytest.raises(ValueError):
        decks.deal_places(spark.range(601), regions, kinds)


def test_exact_sample(spark):
    rows = decks.exact_sample(spark.range(100), 15, "close", where=F.col("id") % 2 == 0).collect()
    assert sum(r["chosen"] for r in rows) == 15 and all(r["id"] % 2 == 0 for r in rows if r["chosen"])
