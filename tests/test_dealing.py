import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelyard.operators import cards as card_rules
from reelyard.operators import dealing
from reelyard.operators.rank import hash_key

N = 2000
FLOORS = ["wooden floor", "concrete floor", "deep sand", "short grass", "polished tiles", "frozen lake ice", "wet cobbles"]
AXES = {
    "regions": [f"region {i}" for i in range(20)], "person_count_plan": {"1": 500, "2": 500, "3": 400, "4": 300, "5": 200, "6": 100}, "small_venue_max_people": 3,
    "weather_outdoor": [{"name": n, "hostile": h} for n, h in (("sun", False), ("cloud", False), ("dusk", False), ("rain", True), ("snow", True), ("fog", True))],
    "lighting_indoor": ["tungsten", "window", "neon"], "env_motion": [{"name": n, "where": w} for n, w in (("leaves", "outdoor"), ("flags", "both"), ("curtains", "indoor"), ("smoke", "both"))],
    "motion_ranges": {"in_place": 0.3, "short_range": 0.4, "long_range": 0.3}, "long_range_sizes": ["large"], "shares": {"hostile_weather_cap": 0.2, "still_env": 0.4, "crowd": 0.2, "close_approach": 0.15},
    "cameras": ["static", "pan", "dolly", "orbit"], "vibes": ["calm", "tense", "festive"], "holdout_suffixes": ["49", "99"], "bounce_ground_keywords": ["floor", "tiles"], "no_bounce_keywords": ["sand"],
    "action_families": [
        {"name": "stand", "ranges": ["in_place"], "small_ok": True, "ice_ok": True}, {"name": "stroll", "ranges": ["short_range", "long_range"], "small_ok": True, "ice_ok": True},
        {"name": "skate", "ranges": ["long_range", "short_range"], "ice_only": True}, {"name": "dribble", "ranges": ["in_place", "short_range"], "needs_hard_surface": True, "small_ok": True},
        {"name": "sprint", "ranges": ["long_range"], "large_only": True, "outdoor_only": True}, {"name": "lift", "ranges": ["in_place"], "min_people": 2, "needs_headroom": True},
        {"name": "dig", "ranges": ["in_place", "short_range"], "ground_any": ["sand"], "small_ok": True}, {"name": "tumble", "ranges": ["short_range"], "dry_only": True, "needs_space": True},
    ],
}


def vocabulary(spark, seed):
    draw = random.Random(seed)
    names = [f"place {i:03d}" for i in range(162)]
    archetypes = [(n, draw.choice(FLOORS)) for n in names]
    tags = [(n, draw.random() < 0.3, draw.choice(["small", "medium", "medium", "large", "large", "large", "large"]), draw.random() < 0.4, draw.choice(["normal"] * 6 + ["reflective", "ice", "water"]), draw.random() < 0.1) for n in [*names, "surplus"]]
    return spark.createDataFrame(archetypes, "name string, ground string"), spark.createDataFrame(tags, "name string, indoor boolean, size string, audience_natural boolean, surface string, low_ceiling boolean")


def check(rows, fits):
    """What holds for every deal."""
    ids = sorted(r["id"] for r in rows)
    assert ids == [f"c{i:04d}" for i in range(N)] and len({(r["region"], r["archetype"]) for r in rows}) == N
    count = lambda k: Counter(r[k] for r in rows)
    assert set(count("region").values()) == {N // 20} and max(count("archetype").values()) - min(count("archetype").values()) <= 1
    assert count("person_count") == {int(k): v for k, v in AXES["person_count_plan"].items()}
    assert count("motion_range") == {"in_place": 600, "short_range": 800, "long_range": 600}
    assert not any(r["motion_range"] == "long_range" and r["size"] != "large" for r in rows)
    assert all(r["person_count"] <= 3 for r in rows if r["size"] == "small")
    assert len(count("action_family")) == len(AXES["action_families"]) and all(r["action_family"] in fits[r["id"]] for r in rows)
    assert 799 <= count("env_motion")["still"] <= 801
    outside = {w["name"]: w["hostile"] for w in AXES["weather_outdoor"]}
    for r in rows:
        assert r["lighting"] in (AXES["lighting_indoor"] if r["indoor"] else outside)
        assert r["env_motion"] in ["still", *dealing.allowed_motion(AXES, "indoor" if r["indoor"] else "outdoor")]
        assert not r["crowd"] or r["audience_natural"]
        assert not r["close_approach"] or r["motion_range"] != "in_place"
    out = [r for r in rows if not r["indoor"]]
    assert sum(outside[r["lighting"]] for r in out) == round(0.2 * len(out))
    assert sum(r["close_approach"] for r in rows) == 300 and sum(r["holdout"] for r in rows) == 40
    assert sum(r["crowd"] for r in rows) == min(400, sum(r["audience_natural"] for r in rows))
    assert set(count("camera").values()) == {N // 4} and max(count("vibe").values()) - min(count("vibe").values()) <= 1


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_deals(spark, seed):
    archetypes, tags = vocabulary(spark, seed)
    deal = lambda s: dealing.deal_cards(dealing.card_ids(spark, N), AXES, archetypes, tags, s)
    dealt = deal(seed)
    rows = dealt.collect()
    check(rows, {r["id"]: r["families"] for r in card_rules.eligible_families(dealt, AXES["action_families"]).collect()})
    if seed == 1:
        assert sorted(rows) == sorted(deal(seed).collect()) and sorted(rows) != sorted(deal(7).collect())


def test_plans_that_cannot_be_kept(spark):
    archetypes, tags = vocabulary(spark, 1)
    ids = dealing.card_ids(spark, N)
    with pytest.raises(ValueError, match="person_count_plan"):
        dealing.deal_decks(ids, AXES | {"person_count_plan": {"1": 5}}, archetypes, tags)
    with pytest.raises(ValueError, match="people"):
        dealing.deal_decks(ids, AXES | {"person_count_plan": {"1": 10, "9": 1990}}, archetypes, tags)
    with pytest.raises(ValueError, match="motion ranges"):
        dealing.deal_decks(ids, AXES | {"motion_ranges": {"in_place": 0.01, "short_range": 0.01, "long_range": 0.98}}, archetypes, tags)
    with pytest.raises(Exception, match="place 007"):
        dealing.deal_decks(ids, AXES, archetypes, tags.where("name <> 'place 007'")).collect()


def test_largest_remainder():
    assert dealing.largest_remainder({"a": 1, "b": 1, "c": 1}, 4) == {"a": 2, "b": 1, "c": 1}
    assert dealing.largest_remainder({"a": 3, "b": 4, "c": 3}, 7) == {"a": 2, "b": 3, "c": 2}
    assert dealing.largest_remainder({}, 0) == {} and dealing.largest_remainder({"a": 0.3, "b": 0.7}, 0) == {"a": 0, "b": 0}


def cards(spark, n=400):
    archetypes, tags = vocabulary(spark, 2)
    at = (F.regexp_extract("id", "[0-9]+", 0).cast("int") % 162).alias("at")
    named = dealing.card_ids(spark, n).select("id", F.concat(F.lit("place "), F.lpad(at.cast("string"), 3, "0")).alias("name"))
    base = named.join(archetypes, "name").join(tags, "name").withColumnRenamed("name", "archetype")
    fixed = {"person_count": 2, "lighting": "old", "env_motion": "old", "motion_range": "long_range", "hard_ground": False, "action_family": "old", "camera": "old", "vibe": "calm", "crowd": True, "close_approach": True}
    return base.withColumns({k: F.lit(v) for k, v in fixed.items()})


def test_redeal_keeps_the_rules_of_a_card(spark):
    base = cards(spark)
    flags = base.where("right(id, 1) in ('3', '7')").select("id", F.when(F.expr("right(id, 1) = '3'"), "The CROWD is odd").alias("reason"))
    out = dealing.redeal_flagged(base, flags, AXES, 5, 1)
    fits = {r["id"]: r["families"] for r in card_rules.eligible_families(out, AXES["action_families"]).collect()}
    old, rows = ({r["id"]: r for r in df.collect()} for df in (base, out))
    assert out.columns == base.columns and len(rows) == len(old)
    drawn = [r for i, r in rows.items() if i[-1] in "37"]
    assert all(rows[i] == old[i] for i in rows if i[-1] not in "37")
    for r in drawn:
        assert r["lighting"] in (AXES["lighting_indoor"] if r["indoor"] else [w["name"] for w in AXES["weather_outdoor"]])
        assert r["env_motion"] in ["still", *dealing.allowed_motion(AXES, "indoor" if r["indoor"] else "outdoor")]
        assert r["camera"] in AXES["cameras"] and r["action_family"] in fits[r["id"]] and r["vibe"] == "calm"
        assert r["motion_range"] != "long_range" or r["size"] == "large"
        assert r["close_approach"] == (r["motion_range"] != "in_place")
        assert r["crowd"] == (r["audience_natural"] and r["id"][-1] == "7")
    assert len({r["camera"] for r in drawn}) == 4 and len({r["motion_range"] for r in drawn}) == 3
    assert sorted(out.collect()) == sorted(dealing.redeal_flagged(base, flags, AXES, 5, 1).collect())
    assert sorted(out.collect()) != sorted(dealing.redeal_flagged(base, flags, AXES, 5, 2).collect())


def test_a_card_that_nothing_fits_in_its_range_stays_in_place(spark):
    base = cards(spark, 60)
    only = AXES | {"action_families": [{"name": "stand", "ranges": ["in_place"], "small_ok": True, "ice_ok": True}]}
    rows = dealing.redeal_flagged(base, base.select("id", F.lit("x").alias("reason")), only).collect()
    assert {(r["motion_range"], r["action_family"], r["close_approach"]) for r in rows} == {("in_place", "stand", False)}
    with pytest.raises(Exception, match="no action family fits"):
        dealing.redeal_flagged(base, base.select("id", F.lit("x").alias("reason")), AXES | {"action_families": []}).collect()


def test_precheck_ends_and_logs(spark):
    base, seen = cards(spark, 50), []

    def responses(df, round_):
        seen.append(round_)
        rows = {1: [(1, 0, "c0001", "first"), (2, 0, "c0001", "later"), (1, 1, "c0002", "dark"), (1, 2, "gone", "no such card"), (3, 0, None, "no id")], 2: [(1, 0, "c0002", "again")]}
        return spark.createDataFrame(rows.get(round_, []), "batch int, item int, id string, reason string")

    out, log = dealing.precheck(base, responses, AXES, seed=3)
    old, rows = ({r["id"]: r for r in df.collect()} for df in (base, out))
    assert seen == [1, 2] and {i for i in rows if rows[i] != old[i]} == {"c0001", "c0002"}
    assert sorted(tuple(r) for r in log.collect()) == [(1, "c0001", "later"), (1, "c0002", "dark"), (1, "gone", "no such card"), (2, "c0002", "again")]
    calm, log = dealing.precheck(base, lambda df, r: responses(df, 9), AXES)
    assert sorted(calm.collect()) == sorted(base.collect()) and log.count() == 0 and seen[-1] == 9
    assert dealing.precheck(base, responses, AXES, rounds=1)[1].count() == 3


def test_cuts_by_keys_are_those_of_the_ranks(spark):
    """A deck of exact counts compares keys with those at the counts' ends; strata are uneven, one is null, cuts lie at and beyond the ends."""
    rows = spark.range(700).select("id", F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 5 == 0).alias("s"))
    groups = dealing.hash_groups(rows, {"deck": F.col("s"), "other": F.lit(True)}, 3)
    order = lambda code: sorted((hashlib.md5(f"3|deck|{i}".encode()).hexdigest(), i) for i in range(700) if (2 if i % 11 == 0 else int(i % 5 == 0)) == code)
    want = {i: (code, at) for code in (0, 1, 2) for at, (_, i) in enumerate(order(code))}
    ranked = dealing.hashed_rank(rows, groups, "deck", F.col("s"), 3, "rank").collect()
    assert {r["id"]: r["rank"] for r in ranked} == {i: at for i, (_, at) in want.items()}
    cuts = {code: [0, 1, 17, 40, len(order(code)) - 1, len(order(code)), 10_000] for code in (0, 1, 2)}
    below = dealing.ranks_below(rows, groups, "deck", F.col("s"), 3, cuts)
    keyed = rows.withColumn("_deck_key", hash_key(3, "deck", "id"))
    got = keyed.select("id", *[c.alias(f"{code}_{at}") for (code, at), c in below.items()]).collect()
    assert all(r[f"{code}_{at}"] == (want[r["id"]][1] < at) for r in got for code, at in below if want[r["id"]][0] == code)
