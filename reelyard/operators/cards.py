"""Which action families fit a card, and a balanced choice among them."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelyard.operators.decks import stratum_rank
from reelyard.operators.rank import hash_key


def hard_ground(ground: Column, bounce: list[str], no_bounce: list[str]) -> Column:
    """A no-bounce keyword in the ground's text: false; else whether a bounce keyword is in it."""
    has = lambda words: F.coalesce(*[F.when(F.lower(ground).contains(w), True) for w in words], F.lit(False)) if words else F.lit(False)
    return ~has(no_bounce) & has(bounce)


def _whole_word(text: Column, words: list[str]) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1), F.array(*map(F.lit, words)))


def _within(text: Column, words: list[str]) -> Column:
    return F.coalesce(*[F.when(F.lower(text).contains(w), True) for w in words], F.lit(False))


def eligible(family: dict) -> Column:
    """Whether a card may show a family (a vocabulary entry; what it doesn't name is null or false)."""
    get = family.get
    surface, size, indoor, ice_ok = F.col("surface"), F.col("size"), F.col("indoor"), bool(get("ice_ok"))
    rules = [F.col("motion_range").isin(get("ranges")), F.col("person_count") >= (get("min_people") or 1)]
    if get("ice_only"):
        rules.append(surface == "ice")
    elif not ice_ok:
        rules.append(surface != "ice")
    if (get("needs_hard_surface") or get("dry_only")) and not ice_ok:
        rules.append(~surface.isin("ice", "water"))
    if get("large_only"):
        rules.append(size == "large")
    if get("needs_hard_surface"):
        rules.append(F.col("hard_ground"))
    if not get("small_ok"):
        rules.append(size != "small")
    if get("needs_space"):
        rules.append(size != "small")
    if get("outdoor_only"):
        rules.append(~indoor)
    if get("needs_headroom"):
        rules.append(~indoor | ((size == "large") & ~F.col("low_ceiling")))
    if get("ground_any") or get("surface_any"):
        rules.append((_whole_word(F.col("ground"), get("ground_any")) if get("ground_any") else F.lit(False)) | (surface.isin(get("surface_any")) if get("surface_any") else F.lit(False)))
    if get("ground_none"):
        rules.append(~_whole_word(F.col("ground"), get("ground_none")))
    if get("archetype_any"):
        rules.append(_within(F.col("archetype"), get("archetype_any")))
    if get("archetype_none"):
        rules.append(~_within(F.col("archetype"), get("archetype_none")))
    out = rules[0]
    for rule in rules[1:]:
        out = out & rule
    return out


def eligible_families(cards: DataFrame, families: list[dict]) -> DataFrame:
    """cards with `families`: the sorted names of those that fit, from one map over the cards."""
    return cards.withColumn("families", F.array_sort(F.array_compact(F.array(*[F.when(eligible(f), f["name"]) for f in families]))))


def assign_least_used(cards: DataFrame, salt: str = "family", seed=0) -> DataFrame:
    """cards (id, families) with action_family: one that fits, counts balanced; cards without any are an error.

    Only the number of cards of each set of families reaches the driver, which depends on the vocabulary alone; quotas fill
    the least used family first, the smallest sets first; inside a set cards take families in seeded order."""
    counted = cards.groupBy("families").agg(F.count(F.lit(1)).alias("n")).collect()
    if any(not r["families"] for r in counted):
        raise ValueError("cards without an eligible family")
    used: dict[str, int] = {}
    ranges = []
    for r in sorted(counted, key=lambda r: (len(r["families"]), r["families"])):
        heap = [(used.get(f, 0), f) for f in r["families"]]
        heapq.heapify(heap)
        left = r["n"]
        while left:  # raise the least used up to the next level at once
            low = [heapq.heappop(heap)]
            while heap and heap[0][0] == low[0][0]:
                low.append(heapq.heappop(heap))
            step = min(left, (heap[0][0] - low[0][0]) * len(low) if heap else left)
            for k, (n, f) in enumerate(low):
                heapq.heappush(heap, (n + step // len(low) + (k < step % len(low)), f))
            left -= step
        at = 0
        for n, f in sorted(heap, key=lambda x: x[1]):
            if n > used.get(f, 0):
                ranges.append((list(r["families"]), f, at, at + n - used.get(f, 0)))
                at += n - used.get(f, 0)
                used[f] = n
    table = cards.sparkSession.createDataFrame(ranges, "families array<string>, action_family string, low long, high long")
    keyed = cards.withColumn("_key", F.concat_ws("|", "families"))
    ranked = stratum_rank(keyed, ["_key"], [hash_key(seed, salt, "id"), F.col("id")], "_r")
    table = table.select(F.concat_ws("|", "families").alias("_key"), "action_family", "low", "high")
    return ranked.join(F.broadcast(table), ["_key"]).where("_r >= low and _r < high").drop("_key", "_r", "low", "high")


# The fields of a card that a prompt shows.
CARD_FIELDS = ["id", "person_count", "region", "archetype", "ground", "indoor", "size", "lighting", "env_motion", "vibe", "motion_range", "action_family", "camera", "crowd", "close_approach"]


def card_view(cards: DataFrame) -> DataFrame:
    """id, card: the JSON line of the fields that a prompt shows, those that the cards have; nulls stay in it."""
    return cards.select("id", F.to_json(F.struct(*[c for c in CARD_FIELDS if c in cards.columns]), {"ignoreNullFields": "false"}).alias("card"))


def attach_tags(archetypes: DataFrame, tags: DataFrame) -> DataFrame:
    """The archetypes with their tags, by name; one without tags is an error, tags of no archetype are left out."""
    marked = archetypes.join(tags.withColumn("_tagged", F.lit(True)), "name", "left")
    found = F.when(F.col("_tagged"), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("archetype without tags: "), F.coalesce("name", F.lit("null")))))
    return marked.withColumn("name", found).drop("_tagged")


def assemble_captions(seeds: DataFrame, accepted: DataFrame) -> DataFrame:
    """The cards that have an accepted caption, with its columns; writers order them by id."""
    return seeds.join(accepted, "id")


def first_n(df: DataFrame, n: int) -> DataFrame:
    """The n rows of the smallest ids, for a trial run."""
    return df.orderBy("id").limit(n)
