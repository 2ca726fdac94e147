from collections import Counter

from pyspark.sql import functions as F

from reelyard import catalog
from reelyard.operators import cards

SF = "/root/testdata/sf0.001"


def test_assignment_is_legal_and_balanced(spark):
    fit = cards.eligible_families(catalog._cards(spark, SF), catalog.FAMILIES).where(F.size("families") > 0).select("id", "families")
    rows = cards.assign_least_used(fit).collect()
    assert len(rows) == fit.count() and all(r["action_family"] in r["families"] for r in rows)
    free = spark.range(100).select("id", F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("families"))
    counts = Counter(r["action_family"] for r in cards.assign_least_used(free).collect())
    assert sorted(counts.values()) == [33, 33, 34]
