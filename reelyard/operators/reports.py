"""Reports on dealt cards, on accepted captions and on the quality records of a run's shards."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelyard.functions.text import word_count
from reelyard.operators.captions import repair_round
from reelyard.operators.cards import eligible
from reelyard.operators.dealing import LONG
from reelyard.storage import keep

AXES = ("person_count", "motion_range", "env_motion", "lighting", "action_family", "camera", "vibe", "size", "indoor", "surface")


def axis_histograms(cards: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """axis, value, cards, percent, place: each axis's values, the most frequent first, then by text. One pass over the cards:
    a card becomes a row for each axis, which is added up before the shuffle; ranks are over values, not cards. A card
    without a value counts as null."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes]))
    counts = cards.select(each.alias("v")).groupBy("v.axis", "v.value").agg(F.count(F.lit(1)).alias("cards"))
    of, order = Window.partitionBy("axis"), Window.partitionBy("axis").orderBy(F.col("cards").desc(), F.col("value"))
    return counts.select("axis", "value", "cards", (100 * F.col("cards") / F.sum("cards").over(of)).alias("percent"), F.row_number().over(order).alias("place"))


def _violations(axes: dict, families: bool) -> dict[str, Column]:
    """What no card may do, by name."""
    small, reach = F.col("size") == "small", F.col("size").isin(list(axes.get("long_range_sizes", ["medium", "large"])))
    rules = {
        "long_range_outside_its_sizes": ~reach & (F.col("motion_range") == LONG),
        "crowded_small_venues": small & (F.col("person_count") > axes.get("small_venue_max_people", 3)),
        "crowds_where_none_is_natural": F.col("crowd") & ~F.col("audience_natural"),
    }
    if families:
        fits = reduce(lambda found, f: found.when(F.col("action_family") == f["name"], eligible(f)), axes["action_families"], F.when(F.lit(False), F.lit(False)))
        rules["families_that_do_not_fit"] = ~F.coalesce(fits, F.lit(False))
    return rules


def coverage_checks(cards: DataFrame, axes: dict) -> DataFrame:
    """figure, value: the checks of a deal. Pairs of region and archetype; the least and most cards of a region, an archetype and
    a family, and how many of these occur; violations, which must be 0; outdoor cards, those with hostile weather and their
    percentage; surfaces that aren't normal; crowds, close approaches and held out cards. Families count where the cards have
    them. Cards are added up by region and archetype first, so only vocabularies meet in the rest."""
    families = "action_family" in cards.columns
    bad = _violations(axes, families)
    hostile = [w["name"] for w in axes["weather_outdoor"] if w["hostile"]]
    flags = bad | {"outdoor": ~F.col("indoor"), "hostile_outdoor": ~F.col("indoor") & F.col("lighting").isin(hostile), "odd_surfaces": F.col("surface") != "normal", "crowds": F.col("crowd"), "close_approaches": F.col("close_approach"), "held_out": F.col("holdout")}
    sums = [F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()]]
    by = ["region", "archetype"]
    pairs = keep(cards.groupBy(*by).agg(*sums), "pairs")
    total = pairs.agg(F.sum("n").alias("cards"), F.count(F.lit(1)).alias("pairs"), *[F.sum(k).alias(k) for k in flags])
    share = F.round(100 * F.try_divide("hostile_outdoor", "outdoor"), 4)
    wide = F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), F.col(k).cast("double").alias("value")) for k in ("cards", "pairs", *flags)], F.struct(F.lit("hostile_percent").alias("figure"), share.alias("value"))))
    rows = total.select(wide.alias("f")).select("f.figure", "f.value")
    counted = [(pairs, c, F.sum("n")) for c in by] + ([(cards, "action_family", F.count(F.lit(1)))] if families else [])
    for source, name, n in counted:
        ends = source.groupBy(name).agg(n.alias("n")).agg(F.count(F.lit(1)).alias("used"), F.min("n").alias("least"), F.max("n").alias("most"))
        rows = rows.unionByName(ends.select(F.explode(F.array(*[F.struct(F.lit(f"{name}.{k}").alias("figure"), F.col(k).cast("double").alias("value")) for k in ("used", "least", "most")])).alias("f")).select("f.figure", "f.value"))
    return rows


def acceptance_figures(accepted: DataFrame, rejects: DataFrame, plans: dict[str, dict]) -> DataFrame:
    """figure, value, detail: accepted and rejected cards, the least and most words of an accepted caption, each unresolved id
    with its reason, and how far each planned share is from the accepted cards' (percentage points, by axis and value).

    accepted: id, caption and the planned axes; rejects: id, reason; plans: axis to {value: share or count}."""
    none = F.lit(None).cast("string")
    words = accepted.agg(F.count(F.lit(1)).alias("accepted"), F.min(word_count(F.col("caption"))).alias("fewest_words"), F.max(word_count(F.col("caption"))).alias("most_words"))
    rows = words.select(F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), F.col(k).cast("double").alias("value")) for k in words.columns])).alias("f")).select("f.figure", "f.value", none.alias("detail"))
    rows = rows.unionByName(rejects.agg(F.lit("rejected").alias("figure"), F.count(F.lit(1)).cast("double").alias("value"), none.alias("detail")))
    rows = rows.unionByName(rejects.select(F.concat(F.lit("unresolved:"), F.col("id").cast("string")).alias("figure"), F.lit(None).cast("double").alias("value"), F.col("reason").alias("detail")))
    planned = [(axis, str(v), 100.0 * s / sum(p.values())) for axis, p in plans.items() for v, s in p.items()]
    if planned:
        table = accepted.sparkSession.createDataFrame(planned, "axis string, value string, planned double")
        found = axis_histograms(accepted, tuple(plans)).select("axis", "value", "percent")
        off = F.round(F.coalesce("percent", F.lit(0.0)) - F.col("planned"), 6)
        rows = rows.unionByName(table.join(found, ["axis", "value"], "left").select(F.concat(F.lit("share:"), "axis", F.lit("="), "value").alias("figure"), off.alias("value"), none.alias("detail")))
    return rows


def repair(accepted: DataFrame, rejects: DataFrame, rewrite: Callable[[DataFrame, int], DataFrame], judge: Callable[[DataFrame, int], DataFrame], rounds: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejects, history) after at most `rounds` rounds of captions.repair_round(); a round without rejects ends them.

    rewrite(rejects, round) gives new captions of the rejected ids, judge(rewritten, round) the verdicts on them. history has a
    row for each round: round, rows_in, accepted, still_rejected. What a round leaves is written, so later rounds repeat
    nothing."""
    accepted, history = accepted.select("id", "scene", "action", "family", "caption"), None
    for round_ in range(1, rounds + 1):
        if rejects.isEmpty():
            break
        written = keep(rewrite(rejects, round_), "rewrites")
        accepted, rejects, told = repair_round(accepted, rejects, written, judge(written, round_))
        accepted, rejects, told = keep(accepted, "accepted"), keep(rejects, "rejects"), keep(told.select(F.lit(round_).alias("round"), "*"), "history")
        history = told if history is None else history.unionByName(told)
    if history is None:
        history = accepted.sparkSession.createDataFrame([], "round int, rows_in long, accepted long, still_rejected long")
    return accepted, rejects, history


def union_reports(*shards: DataFrame) -> DataFrame:
    """The records of all shards of a run, error rows included: a column that a shard lacks is null in its rows. Of records of one
    id the last shard's stays, and of one shard's any that isn't an error."""
    marked = [s.withColumn("_shard", F.lit(i)) for i, s in enumerate(shards)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    rows = rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))
    best = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "_shard")]), F.struct("_shard", F.col("error").isNull())).alias("_r"))
    return best.select("id", "_r.*")


def motion_labels(meta: DataFrame, motion: DataFrame, captions: DataFrame) -> DataFrame:
    """id, label, path, rot_deg, static of the clips in meta (id): the measured motion (clip_id, path, rot_deg, static) beside the
    camera that was asked for, the seed card's (seed.camera) or, where a caption has no seed, its own (camera)."""
    asked = F.coalesce(F.col("seed.camera"), F.col("camera")).alias("label")
    return meta.select("id").join(motion.withColumnRenamed("clip_id", "id"), "id").join(captions.select("id", asked), "id", "left").select("id", "label", "path", "rot_deg", "static")
